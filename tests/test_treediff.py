"""The recursion over pairs of trees against trees written out as files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import history, treediff
from palimpsest.options import SearchOptions
from palimpsest.plans.engine import Source, occurrences

MODES = {"f": 0o100644, "x": 0o100755, "l": 0o120000, "m": 0o160000}


def store(tree, entries):
    """The oid of a tree of nested dictionaries, whose entries are noted."""
    rows = [(0o040000, n, store(v, entries)) if isinstance(v, dict) else (MODES[v[0]], n, v[1]) for n, v in sorted(tree.items())]
    oid = hashlib.sha1(repr(rows).encode()).hexdigest()
    entries.update((oid, *r) for r in rows)
    return oid


def flat(tree, prefix=""):
    out = {}
    for n, v in tree.items():
        out |= flat(v, f"{prefix}{n}/") if isinstance(v, dict) else {prefix + n: v}
    return out


def edited(tree, rnd):
    """A copy of a tree with a few entries set, taken away, or turned from a file into a folder and back."""
    out = {n: edited(v, rnd) if isinstance(v, dict) and rnd.random() < 0.3 else v for n, v in tree.items()}
    for _ in range(rnd.choice((0, 1, 2))):
        n = rnd.choice("abcd")
        what = rnd.random()
        if what < 0.2:
            out.pop(n, None)
        elif what < 0.4:
            out[n] = edited({}, rnd)
        else:
            out[n] = (rnd.choice("fffxlm"), f"o{rnd.randrange(6)}")
    return out


def made(seed, n=40):
    """Commits (sha, parents, tree) with merges and parents that are not known."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        parents = rnd.sample(range(i), min(i, rnd.choice((1, 1, 1, 2, 3)))) if rnd.random() < 0.95 else []
        tree = edited(out[parents[0]][2] if parents else {"a": {"b": {"c": ("f", "o1")}}}, rnd)
        for p in parents[1:]:
            tree |= {k: v for k, v in out[p][2].items() if rnd.random() < 0.5}
        out.append((f"c{i}", [f"c{p}" if rnd.random() < 0.95 else "gone" for p in parents], tree))
    return out


def plain(commits, expand=False, first=False):
    trees, out = {s: flat(t) for s, _, t in commits}, set()
    for sha, parents, _ in commits:
        others = [] if expand else parents[:1] if first else parents
        before = [trees.get(p, {}) for p in others[:1]] + [trees[p] for p in others[1:] if p in trees]
        for path, (kind, oid) in trees[sha].items():
            if kind in "fx" and all(b.get(path, ("", ""))[1] != oid for b in before):
                out.add((sha, path, MODES[kind], oid))
    return out


def tables(spark, commits):
    entries = set()
    rows = [(s, store(t, entries), p) for s, p, t in commits]
    return (spark.createDataFrame(rows, "sha string, tree_oid string, parents array<string>"),
        spark.createDataFrame(sorted(entries), "tree_oid string, mode int, name string, oid string"))


def rows(df):
    got = [tuple(r) for r in df.select("sha", "path", "mode", "oid").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
def test_equals_trees_written_out(spark, seed):
    commits = made(seed)
    c, e = tables(spark, commits)
    for options in ({}, {"expand_commits": True}, {"first_parent": True}):
        want = plain(commits, options.get("expand_commits", False), options.get("first_parent", False))
        assert rows(treediff.tree_changes(c, treediff.by_joins(e), **options)) == want and len(want) > 10
    some = c.where("sha > 'c2'")  # parents that are not selected count all the same
    assert rows(treediff.tree_changes(some, treediff.by_joins(e), c)) == {r for r in plain(commits) if r[0] > "c2"}


def test_a_pair_is_opened_once_for_all_commits(spark):
    """A hundred branches of one commit change one file among thousands, all alike but for a file on top."""
    base = {f"d{i}": {f"e{j}": {f"f{k}": ("f", f"{i}.{j}.{k}") for k in range(10)} for j in range(10)} for i in range(10)}
    changed = base | {"d3": base["d3"] | {"e4": base["d3"]["e4"] | {"f5": ("f", "new")}}}
    commits = [("root", [], base)] + [(f"b{i}", ["root"], changed | {"top": ("f", f"t{i}")}) for i in range(100)]
    c, e = tables(spark, commits)
    levels = []

    def counted(pairs, n):
        levels.append(pairs.count())
        assert levels[-1] <= n
        return treediff.by_joins(e)(pairs, n)

    got = rows(treediff.tree_changes(c.where("sha <> 'root'"), counted, c))
    assert got == {r for r in plain(commits) if r[0] != "root"} and len(got) == 200
    assert levels == [100, 1, 1]  # of 111 trees below the root, two pairs


def test_whole_trees_are_not_compared(spark):
    commits = made(3)
    c, e = tables(spark, commits)

    def opened(pairs, n):
        raise AssertionError("compared")

    opened.whole = treediff.by_joins(e).whole
    assert rows(treediff.tree_changes(c, opened, expand_commits=True)) == plain(commits, expand=True)


def test_lists_of_files_change_as_in_one_table(spark):
    commits = made(5)
    c, e = tables(spark, commits)
    files = history.expand_trees(e, c)
    want = rows(history.suppress_merged(history.tree_diff(c, files), c, files).select("sha", "path", "mode", "oid"))
    assert rows(history.file_changes(c, files)) == want and len(want) > 10


def test_no_commits_same_trees_and_loops(spark):
    c, e = tables(spark, [("a", [], {"x": ("f", "1")}), ("b", ["a"], {"x": ("f", "1")}), ("c", ["lost", "a"], {"x": ("f", "1")}), ("d", ["b"], {})])
    opened = treediff.by_joins(e)
    assert rows(treediff.tree_changes(c, opened)) == {("a", "x", 0o100644, "1")}  # c has it from its other parent
    assert rows(treediff.tree_changes(c.unionByName(c), opened)) == {("a", "x", 0o100644, "1")}
    assert rows(treediff.tree_changes(c.limit(0), opened)) == set() == rows(treediff.tree_changes(c.where("sha = 'd'"), opened, c))
    loop = spark.createDataFrame([("t", 0o040000, "d", "t")], "tree_oid string, mode int, name string, oid string")
    one = spark.createDataFrame([("a", "t", [])], "sha string, tree_oid string, parents array<string>")
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError):
        m.setattr(treediff, "MAX_DEPTH", 3)
        treediff.tree_changes(one, treediff.by_joins(loop))


def test_a_search_takes_entries(spark):
    commits = made(7)
    c, e = tables(spark, commits)
    dated = c.withColumns({"commit_ts": F.timestamp_seconds(F.substr("sha", F.lit(2)).cast("long")), **{k: F.lit("n") for k in ("author", "author_name")}})
    found = {(r.commit_sha, r.path, r.blob_oid) for r in occurrences(Source(dated, entries=e), SearchOptions(("x",))).collect()}
    want = {}
    for sha, path, _, oid in plain(commits):
        want[oid, path] = max(want.get((oid, path), -1), int(sha[1:]))
    assert found == {(f"c{n}", path, oid) for (oid, path), n in want.items()}


def test_trees_as_rows(spark):
    """A tree in a row, roots without parents among them, and entries that are told twice."""
    commits = made(11)
    c, e = tables(spark, commits)
    trees = e.groupBy("tree_oid").agg(F.collect_list(F.struct("mode", "name", "oid")).alias("held"))
    for options in ({}, {"expand_commits": True}, {"first_parent": True}):
        want = plain(commits, options.get("expand_commits", False), options.get("first_parent", False))
        assert rows(treediff.tree_changes(c, treediff.by_trees(trees), **options)) == want and len(want) > 10
    assert rows(treediff.tree_changes(c, treediff.by_joins(e.unionByName(e)))) == plain(commits)


def test_levels_leave_no_shuffles(spark):
    """What a level shuffled is gone once it is written: only the sides' and the last join's would be left."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in (a.apply(i) for a in [files.getAllFiles()] for i in range(a.size())) if f.getName().startswith("shuffle_")}
    c, e = tables(spark, made(12))
    held = history.stored(e)
    before = shuffled()
    changes = treediff.tree_changes(c, treediff.by_joins(held))
    assert shuffled() <= before and rows(changes)


def test_columns_that_rows_keep(spark):
    commits = made(13)
    c, e = tables(spark, commits)
    told = c.withColumn("n", F.substr("sha", F.lit(2)).cast("int"))
    kept = treediff.tree_changes(told, treediff.by_joins(e), keep=("n",))
    assert kept.columns == ["sha", "path", "mode", "oid", "n"] and rows(kept) == plain(commits) and not kept.where("sha <> concat('c', n)").count()
    assert treediff.tree_changes(told.limit(0), treediff.by_joins(e), keep=("n",)).dtypes == kept.dtypes
