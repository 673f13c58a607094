"""What commits change, as a recursion over distinct pairs of trees.

A commit's changes are the difference of its tree and a parent's. Most commits share most subtrees, and so do the pairs
of trees below them: a level of the recursion opens each distinct pair (new tree, old tree) once, for all commits that
meet it there, drops entries that are equal, and goes on with the distinct pairs of subtrees that are left. Paths are
composed as it descends, for distinct pairs of root trees; commits come in at the end.

How a pair is opened is a function of a table of pairs: joins with a table of tree entries, or reads of a repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.history import KIND, REGULAR, counted, stored

TREE = 0o040000
NONE = ""  # stands for the tree that a commit without a known parent is compared with
MAX_DEPTH = 256

# (new, old), distinct, and how many they are at most -> (new, old, name, mode, oid, had): entries of `new` that `old` has
# not, or with another oid; `had` is that oid, or NONE. A tree and a file of one name are different entries. Or a row a
# pair, (new, old, changed), with an array of those entries.
Opener = Callable[[DataFrame, int], DataFrame]


def _changed(mine: Column, theirs: Column) -> Column:
    """The entries (name, mode, oid, had) of `mine` that are not in `theirs`: both sorted as one, where what has one name
    stands side by side, so the time follows the entries and not their pairs."""
    def told(side: int) -> Callable[[Column], Column]:
        is_tree = lambda e: e["mode"].bitwiseAND(F.lit(KIND)) == TREE
        return lambda e: F.struct(e["name"].alias("name"), is_tree(e).alias("is_tree"), F.lit(side).alias("side"), e["mode"].alias("mode"), e["oid"].alias("oid"))

    def compared(every: Column) -> Column:
        def beside(e: Column, i: Column) -> Column:
            after = F.get(every, i + 1)
            same = (after["side"] == 1) & (after["name"] == e["name"]) & (after["is_tree"] == e["is_tree"])
            had = F.coalesce(F.when(same, after["oid"]), F.lit(NONE))
            # Without a mode: what is of the old tree, and what that has with the same oid.
            return F.struct(e["name"].alias("name"), F.when((e["side"] == 0) & (e["oid"] != had), e["mode"]).alias("mode"), e["oid"].alias("oid"), had.alias("had"))

        return F.filter(F.transform(every, beside), lambda e: e["mode"].isNotNull())

    every = F.sort_array(F.concat(F.transform(mine, told(0)), F.transform(theirs, told(1))))
    return F.element_at(F.transform(F.array(every), compared), 1)  # sorted once, however often it is named


def by_trees(trees: DataFrame) -> Opener:
    """Opens pairs by joins with a table of trees (tree_oid, held: array of mode, name and oid), a row a tree; one that is not
    there is empty.

    A pair is dealt by its new tree, where distinct pairs are too, then by its old one, with what the new one holds; the
    trees are dealt once for both. A pair without an old tree stays with its new one, as all of these would else meet in
    one partition.
    """
    trees = trees.select("tree_oid", "held")

    def opened(pairs: DataFrame, n: int) -> DataFrame:
        mine = pairs.join(trees, F.col("new") == F.col("tree_oid")).select("new", "old", F.col("held").alias("mine"))
        at = F.when(F.col("old") == NONE, F.col("new")).otherwise(F.col("old"))
        both = mine.join(trees, (at == F.col("tree_oid")) & (F.col("old") != NONE), "left")
        return both.select("new", "old", _changed(F.col("mine"), F.coalesce("held", F.array().cast(trees.schema["held"].dataType))).alias("changed"))

    def whole(placed: DataFrame) -> DataFrame:
        held = placed.join(trees, F.col("tree") == F.col("tree_oid")).select(*placed.columns, F.inline("held"))
        return held.select(*placed.columns, "name", "mode", "oid", F.lit(NONE).alias("had"))

    opened.whole = whole
    return opened


def by_joins(entries: DataFrame) -> Opener:
    """The same of a table of tree entries (tree_oid, mode, name, oid), which are gathered by tree; of whole trees they are
    joined as they are."""
    opened = by_trees(entries.groupBy("tree_oid").agg(F.collect_set(F.struct("mode", "name", "oid")).alias("held")))

    def whole(placed: DataFrame) -> DataFrame:
        return placed.join(entries.select(F.col("tree_oid").alias("tree"), "name", "mode", "oid"), "tree").withColumn("had", F.lit(NONE))

    opened.whole = whole
    return opened


def pair_changes(pairs: DataFrame, opened: Opener, n: int, whole: bool = False) -> DataFrame:
    """(new, old) of root trees, distinct and unequal -> (new, old, path, mode, oid): regular files of `new` that `old` lacks
    at their path or has with another oid. n: how many pairs there are at most. whole: every `old` is NONE, so that nothing
    is compared, and an opener that can join a level with entries at once does so.

    Each level is written down, so a lost executor costs one level; of it, only the number of subtrees comes back.
    """
    placed, out = None, None
    for _ in range(MAX_DEPTH):
        if whole and hasattr(opened, "whole"):
            top = pairs.select("new", "old", F.col("new").alias("tree"), F.lit("").alias("prefix"))
            found = opened.whole(top if placed is None else placed)
        elif placed is None:  # each pair of roots is where it was met
            found = opened(pairs, n).withColumn("prefix", F.lit(""))
        else:
            level = placed.select(F.col("tree").alias("new"), F.col("before").alias("old")).repartition("new").distinct()
            found = placed.join(opened(level, n).withColumnsRenamed({"new": "tree", "old": "before"}), ["tree", "before"])
        if "changed" in found.columns:
            # Outer, as Spark else asks for the size of what is changed first, and works it out once more for that.
            found = found.select("new", "old", "prefix", F.inline_outer("changed")).where("mode IS NOT NULL")
        is_tree = F.col("mode").bitwiseAND(F.lit(KIND)) == TREE
        here, n = counted(found.select("new", "old", F.concat("prefix", "name").alias("path"), "mode", "oid", "had"), is_tree, stored)
        files = here.where(F.col("mode").bitwiseAND(F.lit(KIND)) == REGULAR).select("new", "old", "path", "mode", "oid")
        out = files if out is None else out.unionByName(files)
        if not n:
            return out
        placed = here.where(is_tree).select("new", "old", F.col("oid").alias("tree"), F.col("had").alias("before"), F.concat("path", F.lit("/")).alias("prefix"))
    raise ValueError(f"trees are nested deeper than {MAX_DEPTH}, or contain themselves")


def compared(commits: DataFrame, history: DataFrame, expand_commits: bool = False, first_parent: bool = False) -> DataFrame:
    """commits' columns but those of its tree and parents, and (new, old, merge) for each parent that a commit is compared
    with; merge tells whether they may be several.

    The first parent always counts, as NONE where there is none or its tree is unknown; other parents count where their
    trees are known, unless first parents alone do. With expand_commits a commit is compared with nothing.
    """
    own = [F.col(f"`{c}`") for c in commits.columns if c not in ("tree_oid", "parents")]
    new = F.col("tree_oid").alias("new")
    if expand_commits:
        return commits.select(*own, new, F.lit(NONE).alias("old"), F.lit(False).alias("merge"))
    parents = F.slice("parents", 1, 1) if first_parent else F.col("parents")
    each = commits.select(*own, new, F.coalesce(F.size(parents) > 1, F.lit(False)).alias("merge"), F.posexplode_outer(parents).alias("k", "parent"))
    trees = history.select(F.col("sha").alias("parent"), F.coalesce("tree_oid", F.lit(NONE)).alias("old"))
    each = each.join(trees, "parent", "left").withColumn("old", F.coalesce("old", F.lit(NONE)))
    return each.where((F.coalesce("k", F.lit(0)) == 0) | (F.col("old") != NONE)).select(*own, "new", "old", "merge")


def tree_changes(commits: DataFrame, opened: Opener, history: DataFrame | None = None, expand_commits: bool = False, first_parent: bool = False,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(sha, path, mode, oid): regular files that a commit (sha, tree_oid, parents) has and its parent lacks or has with
    another oid; of a merge, only what holds of every parent, for what another parent has was told on its side.

    history: all commits, where `commits` are some of them. Root commits, those whose first parent is unknown, and all
    with expand_commits give their whole tree; deletions and changes of mode alone give nothing. Rows of one sha count as
    one commit. Of no commits, no rows come. keep: further columns of commits that their rows have, behind those four.
    """
    told = ("sha", "path", "mode", "oid", *keep)
    one = commits.select("sha", "tree_oid", "parents", *keep).dropDuplicates(["sha"])
    differ = F.col("new") != F.col("old")
    sides, n = counted(compared(one, commits if history is None else history, expand_commits, first_parent), differ, stored)
    if not n:
        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in commits.select(*keep).schema] if keep else []
        return commits.sparkSession.createDataFrame([], ", ".join(["sha string, path string, mode int, oid string", *kept]))
    changes = pair_changes(sides.where(differ).select("new", "old").repartition("new").distinct(), opened, n, expand_commits)
    alone = sides.where(~F.col("merge")).drop("merge").join(changes, ["new", "old"]).select(*told)
    if expand_commits or first_parent:
        return alone
    merges = sides.where("merge").withColumn("parents", F.expr("count(*) OVER (PARTITION BY sha)").cast("int"))
    merged = merges.join(changes, ["new", "old"]).groupBy(*told).agg(F.count("*").alias("sides"), F.first("parents").alias("parents"))
    return alone.unionByName(merged.where("sides = parents").select(*told))
