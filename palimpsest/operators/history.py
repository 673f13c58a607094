"""Operators on history: commits (sha, parents, commit_ts, ...) and the files of their trees (sha, path, mode, oid).

Closures walk on the driver where the graph's arrays fit there, some 200 bytes a commit, which is checked; beyond that
history is cut into chains, by joins that follow the logarithm of the longest chain, and what is reached is a place a chain.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

DRIVER_GRAPH = 3_000_000  # commits whose graph is walked on the driver
REGULAR = 0o100000
KIND = 0o170000


def shared_folder(spark, name: str) -> str:
    """A new folder's path where the driver and all executors see it; a temporary one only in local mode, where one
    machine is all."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{base.removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = shared_folder(df.sparkSession, "checkpoints")
        context.setCheckpointDir(f"file://{folder}" if folder.startswith("/") else folder)
    return df.checkpoint()


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet: for wide tables, of which a checkpoint holds every row in full.

    What was shuffled on the way goes once df is written, as nothing reads it again; else it stays until the driver's
    garbage is collected, and the levels of a deep history add up.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "stored")
    folder = f"file://{folder}" if folder.startswith("/") else folder
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(folder)  # a plan of its own: that of df may be run again
    finally:
        spark.conf.set(DROP_SHUFFLES, before) if before is not None else spark.conf.unset(DROP_SHUFFLES)
    return spark.read.parquet(folder)


def counted(df: DataFrame, which: Column, keep=checkpointed) -> tuple[DataFrame, int]:
    """df written to the shared folder, and how many of its rows are such; the writing itself counts them."""
    seen = Observation()
    done = keep(df.observe(seen, F.count_if(which).alias("n")))
    return done, seen.get["n"]


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the rank of each row, from 1, in a total order: a range-partitioned sort, and offsets of its partitions."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = checkpointed(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": within}))
    sizes = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())  # a number a partition
    offsets, n = [], 1
    for part, size in sizes:
        offsets.append((part, n))
        n += size
    starts = df.sparkSession.createDataFrame(offsets, "__part int, __from long")
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__from") + F.col("__at")).drop("__part", "__at", "__from")


class Graph:
    """Commits and their parents as arrays on the driver: places in sha order, and the known parents of each place."""

    def __init__(self, commits: DataFrame):
        import numpy as np
        import pyarrow.compute as pc

        dated = "commit_ts" in commits.columns
        rows = commits.select("sha", "parents",
            F.unix_micros("commit_ts").alias("ts") if dated else F.lit(0).cast("long").alias("ts")).toArrow().combine_chunks()
        self.shas = rows.column("sha").combine_chunks()
        lists = pc.fill_null(rows.column("parents").combine_chunks(), [])
        places = pc.index_in(lists.flatten(), value_set=self.shas)
        self.parents = pc.fill_null(places, -1).to_numpy(zero_copy_only=False).tolist()  # -1: a commit that is not here
        self.ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int).tolist()
        self.dates = pc.fill_null(rows.column("ts").combine_chunks(), -(1 << 62)).to_numpy(zero_copy_only=False).tolist()

    def places(self, shas: Iterable[str]) -> list[int]:
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(pa.array(list(shas), self.shas.type), value_set=self.shas)
        return [p for p in found.to_pylist() if p is not None]

    def known_parents(self, place: int, first_parent: bool = False) -> list[int]:
        at, end = self.ends[place], self.ends[place + 1]
        return [p for p in self.parents[at:min(end, at + 1) if first_parent else end] if p >= 0]

    def reach(self, start: Iterable[int], first_parent: bool = False) -> bytearray:
        """A byte a place: 1 where it is reached from the start, itself included."""
        seen, todo = bytearray(len(self.shas)), list(start)
        while todo:
            place = todo.pop()
            if not seen[place]:
                seen[place] = 1
                todo += [p for p in self.known_parents(place, first_parent) if not seen[p]]
        return seen

    def taken(self, seen) -> list[str]:
        """The shas of marked places, as an Arrow array."""
        import numpy as np
        import pyarrow as pa

        return self.shas.take(pa.array(np.flatnonzero(np.frombuffer(bytes(seen), dtype=np.uint8))))

    def nth_ancestor(self, place: int, n: int) -> tuple[int, int]:
        """(the place after n first parents, or where history ends; how many steps that was)."""
        for k in range(n):
            up = self.known_parents(place, True)
            if not up:
                return place, k
            place = up[0]
        return place, n

    @cached_property
    def skewed(self) -> bool:
        """Whether any commit is older than a parent of its."""
        return any(self.dates[p] > d for place, d in enumerate(self.dates) for p in self.known_parents(place))

    def walk(self, start: Iterable[int], excluded=None, first_parent: bool = False) -> list[int]:
        """The order in which a heap by date pops commits: a parent enters it only behind its child. Ties go by sha."""
        seen = bytearray(excluded) if excluded is not None else bytearray(len(self.shas))
        heap: list[tuple] = []

        def push(place: int) -> None:
            if not seen[place]:
                seen[place] = 1
                heapq.heappush(heap, (-self.dates[place], self.shas[place].as_py(), place))

        for place in start:
            push(place)
        out = []
        while heap:
            place = heapq.heappop(heap)[2]
            out.append(place)
            for p in self.known_parents(place, first_parent):
                push(p)
        return out


def fits_driver(commits: DataFrame) -> bool:
    return commits.count() <= DRIVER_GRAPH


def edges(commits: DataFrame, first_parent: bool = False) -> DataFrame:
    """(child, parent) rows; only the first parent of each commit where asked."""
    parents = F.slice("parents", 1, 1) if first_parent else F.col("parents")
    return commits.select(F.col("sha").alias("child"), F.explode(parents).alias("parent"))


def _table(spark, shas) -> DataFrame:
    """(sha) of names; of a table, the table."""
    import pyarrow as pa

    if isinstance(shas, DataFrame):
        return shas.select("sha")
    return spark.createDataFrame(pa.table({"sha": shas if isinstance(shas, pa.Array) else pa.array(list(shas), pa.string())}))


def _names(shas: Iterable[str] | DataFrame) -> Iterable[str]:
    return shas.select("sha").toArrow().column("sha").to_pylist() if isinstance(shas, DataFrame) else shas


def ancestors(commits: DataFrame, start: Iterable[str] | DataFrame, first_parent: bool = False) -> DataFrame:
    """(sha): the commits among `commits` that are reached from the start, it included. Unknown parents are not followed.

    The start is names, or a table of them, which comes to the driver only where the graph is there.
    """
    spark = commits.sparkSession
    if fits_driver(commits):
        graph = Graph(commits)
        return _table(spark, graph.taken(graph.reach(graph.places(_names(start)), first_parent)))
    return ancestors_by_joins(commits, _table(spark, start), first_parent)


class Chains:
    """History cut into chains: each commit goes on to its first parent, unless a child with a smaller sha does so already.

    A commit's place is its chain, named by the commit at its end, and how far from there it is; places are found by
    doubling. All other ways to a parent are turns, from a place to a place. So what a start reaches is the highest place
    of each chain, and a round is needed only for each time that a path turns. What is found is written to the shared
    folder, so neither plans nor recomputation grow with history.
    """

    def __init__(self, commits: DataFrame, first_parent: bool = False):
        parents = F.slice("parents", 1, 1) if first_parent else F.col("parents")
        self.known = checkpointed(commits.select("sha", parents.alias("parents")).dropDuplicates(["sha"]))
        own = self.known.select(F.col("sha").alias("parent"))
        self.steps = checkpointed(self.known.select(F.col("sha").alias("child"), F.posexplode("parents").alias("k", "parent")).join(own, "parent", "left_semi"))

    @cached_property
    def places(self) -> DataFrame:
        """(sha, chain, place)."""
        following = self.steps.where("k = 0").groupBy("parent").agg(F.min("child").alias("sha"))
        rows = self.known.select("sha").join(following, "sha", "left").select("sha", F.coalesce("parent", "sha").alias("chain"),
            F.col("parent").isNotNull().cast("long").alias("place"))
        rows = checkpointed(rows)
        while True:
            # A commit whose chain's name is not the end's yet takes twice the way.
            ends = rows.select(F.col("sha").alias("chain"), F.col("chain").alias("farther"), F.col("place").alias("more"))
            open_ = F.col("more") > 0
            rows, n = counted(rows.join(ends, "chain").select("sha", F.col("farther").alias("chain"), (F.col("place") + F.col("more")).alias("place"),
                open_.alias("went")), F.col("went"))
            rows = rows.drop("went")
            if not n:
                return rows

    @cached_property
    def turns(self) -> DataFrame:
        """(chain, place, to, at), from a place to one of another chain."""
        of = lambda c, chain, place: self.places.select(F.col("sha").alias(c), F.col("chain").alias(chain), F.col("place").alias(place))
        ways = self.steps.select("child", "parent").distinct().join(of("child", "chain", "place"), "child").join(of("parent", "to", "at"), "parent")
        return checkpointed(ways.where("chain <> to").groupBy("chain", "place", "to").agg(F.max("at").alias("at")))

    def reached(self, start: DataFrame) -> DataFrame:
        """(sha): what is reached from the start, it included."""
        start = checkpointed(start.select("sha").distinct())
        childless = self.known.select("sha").join(self.steps.select(F.col("parent").alias("sha")), "sha", "left_anti")
        if childless.join(start, "sha", "left_anti").isEmpty():
            return self.known.select("sha")  # every commit is reached from one without children
        new = self.places.join(start, "sha", "left_semi").groupBy("chain").agg(F.max("place").alias("top"))
        reach, new = None, checkpointed(new.withColumn("low", F.lit(-1).cast("long")))
        while True:
            # new: chains that are reached higher than before, from above `low` up to `top`.
            reach = new.drop("low") if reach is None else checkpointed(reach.unionByName(new.drop("low")).groupBy("chain").agg(F.max("top").alias("top")))
            step = self.turns.join(new, "chain").where("place > low AND place <= top").groupBy(F.col("to").alias("chain")).agg(F.max("at").alias("top"))
            had = reach.select("chain", F.col("top").alias("low"))
            new, n = counted(step.join(had, "chain", "left").select("chain", "top", F.coalesce("low", F.lit(-1)).alias("low")).where("top > low"), F.lit(True))
            if not n:
                return self.places.join(reach, "chain").where("place <= top").select("sha")


def ancestors_by_joins(commits: DataFrame, start: DataFrame, first_parent: bool = False) -> DataFrame:
    """The same for graphs of any size, by chains."""
    return Chains(commits, first_parent).reached(start)


def nth_ancestors(commits: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """(start, sha): the n-th first parent of each commit (sha) of the start that has one, by joins, two at most a bit of n."""
    known = commits.select(F.col("sha").alias("parent")).distinct()
    here = start.select("sha").distinct().join(known.select(F.col("parent").alias("sha")), "sha", "left_semi").select(F.col("sha").alias("start"), "sha")
    way = edges(commits, True).distinct().join(known, "parent", "left_semi").select("child", "parent")
    while n:
        if n & 1:
            here = here.join(way.withColumnRenamed("child", "sha"), "sha").select("start", F.col("parent").alias("sha"))
        n >>= 1
        if n:
            farther = way.select(F.col("child").alias("parent"), F.col("parent").alias("farther"))
            way = checkpointed(way.join(farther, "parent").select("child", F.col("farther").alias("parent")))
    return here


def rev_range(commits: DataFrame, include: Iterable[str] | DataFrame, exclude: Iterable[str] | DataFrame, first_parent: bool = False,
              graph: Graph | None = None) -> DataFrame:
    """Commits reached from include but not from exclude, each names or a table of them; exclusion follows every parent."""
    spark = commits.sparkSession
    if graph or fits_driver(commits):
        graph = graph or Graph(commits)
        gone = graph.reach(graph.places(_names(exclude)))
        seen = graph.reach(graph.places(_names(include)), first_parent)
        if all(seen) and not any(gone):
            return commits
        return commits.join(_table(spark, graph.taken(bytes(a & ~b & 1 for a, b in zip(seen, gone)))), "sha", "left_semi")
    chains = Chains(commits)
    wanted = (Chains(commits, True) if first_parent else chains).reached(_table(spark, include))
    if isinstance(exclude, DataFrame) or exclude:
        wanted = wanted.join(chains.reached(_table(spark, exclude)), "sha", "left_anti")
    return commits.join(wanted, "sha", "left_semi")


def nth_ancestor(commits: DataFrame, sha: str, n: int, graph: Graph | None = None) -> str:
    """The n-th first parent; raises if the history is too short."""
    if graph or fits_driver(commits):
        graph = graph or Graph(commits)
        start = graph.places([sha])
        place, steps = graph.nth_ancestor(start[0], n) if start else (0, 0)
        if n and steps < n:
            raise ValueError(f"history of {sha} is shorter than {n}: no parent after {steps}")
        return graph.shas[place].as_py() if start else sha
    if not n:
        return sha
    row = nth_ancestors(commits, _table(commits.sparkSession, [sha]), n).first()
    if row is None:
        raise ValueError(f"history of {sha} is shorter than {n}")
    return row.sha


def commit_filter(since=None, until=None, author: str = "", committer: str = "") -> Column:
    """Filters on commits that traversal has reached; they do not stop it."""
    from palimpsest.functions import linear

    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("commit_ts") >= F.lit(since))
    if until is not None:
        keep = keep & (F.col("commit_ts") <= F.lit(until))
    for pattern, who in ((author, "author"), (committer, "committer")):
        if pattern:
            found = lambda c: linear.search(F.col(c), pattern, multiline=False, ignore_case=True)  # noqa: E731, B023
            keep = keep & (found(who) | found(f"{who}_name") | found(f"{who}_email"))
    return keep


def walk_order(commits: DataFrame) -> DataFrame:
    """Adds walk_seq, newest first, then by sha. Exact where no parent is newer than its child, so that a heap pops by
    date; Graph.walk() is for histories with skewed clocks."""
    return numbered(commits, "walk_seq", F.desc("commit_ts"), F.asc("sha"))


def heap_order(graph: Graph, spark, start: Iterable[str], exclude: Iterable[str] = (), first_parent: bool = False) -> DataFrame:
    """(sha, walk): the commits that a heap by date pops from the start, numbered from 1 in that order."""
    import pyarrow as pa

    order = graph.walk(graph.places(start), graph.reach(graph.places(exclude)), first_parent)
    return spark.createDataFrame(pa.table({"sha": graph.shas.take(pa.array(order, pa.int64())), "walk": pa.array(range(1, len(order) + 1), pa.int64())}))


def regular_blobs(files: DataFrame) -> DataFrame:
    """Without symlinks, submodules and trees."""
    return files.where(F.col("mode").bitwiseAND(F.lit(KIND)) == REGULAR)


def expand_trees(entries: DataFrame, roots: DataFrame, max_depth: int = 256) -> DataFrame:
    """tree entries (tree_oid, mode, name, oid) and root trees (tree_oid) -> (root, path, mode, oid) of all files.

    Each distinct root once; a level is one join on the tree's oid. Subtrees that several roots share are joined per
    root, as their paths are part of the result.
    """
    level = roots.select("tree_oid").distinct().select(F.col("tree_oid").alias("root"), F.lit("").alias("prefix"), "tree_oid")
    out = None
    for _ in range(max_depth):
        here = level.join(entries, "tree_oid").select("root", F.concat("prefix", "name").alias("path"), "mode", "oid")
        is_tree = F.col("mode").bitwiseAND(F.lit(KIND)) == 0o040000
        files = here.where(~is_tree)
        out = files if out is None else out.unionByName(files)
        level = checkpointed(here.where(is_tree).select("root", F.concat("path", F.lit("/")).alias("prefix"), F.col("oid").alias("tree_oid")))
        if level.isEmpty():
            return out
    raise ValueError(f"trees are nested deeper than {max_depth}, or contain themselves")


def find_entry(files: DataFrame, root: str, path: str) -> DataFrame:
    return files.where((F.col("root") == root) & (F.col("path") == path))


def tree_diff(commits: DataFrame, files: DataFrame, expand_commits: bool = False, history: DataFrame | None = None) -> DataFrame:
    """(sha, path, mode, oid): regular files of each commit that its first parent lacks or has with another oid.

    commits: (sha, tree_oid, parents); files: (root, path, mode, oid) by tree; history: all commits, where `commits` are
    some of them. Root commits, commits whose parent is unknown, and all commits under expand_commits give their whole
    tree. Deletions and changes of mode alone give nothing. Commits with their parent's very tree drop out before any
    tree is joined.
    """
    own = commits.select("sha", "tree_oid", F.try_element_at("parents", F.lit(1)).alias("parent"))
    if expand_commits:
        pairs = own.withColumn("parent_tree", F.lit(None).cast("string"))
    else:
        trees = (commits if history is None else history).select(F.col("sha").alias("parent"), F.col("tree_oid").alias("parent_tree"))
        pairs = own.join(trees, "parent", "left").where("parent_tree IS NULL OR parent_tree <> tree_oid")
    child = pairs.join(regular_blobs(files).withColumnRenamed("root", "tree_oid"), "tree_oid")
    if expand_commits:
        return child.select("sha", "path", "mode", "oid")
    old = files.select(F.col("root").alias("parent_tree"), F.col("path"), F.col("oid"))
    return child.join(old, ["parent_tree", "path", "oid"], "left_anti").select("sha", "path", "mode", "oid")


def suppress_merged(diff: DataFrame, commits: DataFrame, files: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Drops from merges what any other parent has at the same path with the same oid.

    Only what the first parent's diff left of merges is looked up in the other parents' trees, by tree, path and oid.
    """
    merges = commits.where(F.size("parents") > 1).select("sha", F.explode(F.slice("parents", 2, 0x7FFFFFFF)).alias("other"))
    roots = (commits if history is None else history).select(F.col("sha").alias("other"), F.col("tree_oid").alias("root"))
    wanted = diff.join(merges.join(roots, "other").select("sha", "root").distinct(), "sha").select("sha", "root", "path", "oid")
    had = wanted.join(files.select("root", "path", "oid"), ["root", "path", "oid"], "left_semi").select("sha", "path", "oid")
    return diff.join(had, ["sha", "path", "oid"], "left_anti")


def file_changes(commits: DataFrame, files: DataFrame) -> DataFrame:
    """tree_diff() of all commits with suppress_merged() of the merges among them, which alone are dealt by commit for it."""
    merge = F.size("parents") > 1
    one = tree_diff(commits.where(~merge), files, history=commits)
    merges = commits.where(merge)
    return one.unionByName(suppress_merged(tree_diff(merges, files, history=commits), merges, files, commits))


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """Of each (blob, path), the occurrence that the walk meets first, by walk_seq."""
    keys = ["blob_oid", "path"]
    rest = [c for c in occurrences.columns if c not in keys]
    best = occurrences.groupBy(*keys).agg(F.min_by(F.struct(*rest), "walk_seq").alias("o"))
    return best.select(*keys, *[F.col("o")[c].alias(c) for c in rest]).select(*occurrences.columns)
