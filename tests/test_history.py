from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import attribution, history

T0 = datetime(2023, 1, 15)


def commits(spark, *rows):
    """(sha, parents, day, tree)"""
    return spark.createDataFrame([(s, p, T0 + timedelta(days=d), t, f"{s} <{s}@x.org>", s, f"{s}@x.org", "bot", "bot", "") for s, p, d, t in rows],
                                 "sha string, parents array<string>, commit_ts timestamp, tree_oid string, author string, author_name string, author_email string, committer string, committer_name string, committer_email string")


def files(spark, *rows):
    return spark.createDataFrame([(r, p, m, o) for r, p, m, o in rows], "root string, path string, mode int, oid string")


def shas(df):
    return {r.sha for r in df.collect()}


DIAMOND = [("m", ["a", "b"], 3, "tm"), ("a", ["r"], 1, "ta"), ("b", ["r"], 2, "tb"), ("r", [], 0, "tr"), ("x", ["gone"], 4, "tx")]


@pytest.mark.parametrize("joins", [False, True])
def test_closures(spark, joins):
    c = commits(spark, *DIAMOND)
    reach = (lambda start, **k: shas(history.ancestors_by_joins(c, spark.createDataFrame([(s,) for s in start], "sha string"),
        **k))) if joins else lambda start, **k: shas(history.ancestors(c, start, **k))
    assert reach(["m"]) == {"m", "a", "b", "r"} and reach(["m"], first_parent=True) == {"m", "a", "r"} and reach(["x", "unknown"]) == {"x"}
    assert shas(history.rev_range(c, ["m"], ["a"])) == {"m", "b"}


def test_long_history(spark):
    chain = [(str(i), [str(i - 1)] if i else [], i % 50, "t") for i in range(5000)]
    assert history.ancestors(commits(spark, *chain), ["4999"]).count() == 5000


def test_tilde(spark):
    c = commits(spark, *DIAMOND)
    assert history.nth_ancestor(c, "m", 2) == "r" and history.nth_ancestor(c, "m", 0) == "m"
    with pytest.raises(ValueError):
        history.nth_ancestor(c, "m", 3)


def test_filters(spark):
    """Both ends of the dates count; patterns look at any part of a name, in either case."""
    days = {"Wren": 3, "wrenfield": 40, "Plover": 41, "Dunlin": 90}
    c = commits(spark, *[(s, [], d, "t") for s, d in days.items()])
    got = lambda **k: shas(c.where(history.commit_filter(**k)))
    for low in (0, 3, 40, 91):
        for high in (2, 40, 41, 400):
            since, until = (F.lit(T0 + timedelta(days=d)) for d in (low, high))
            assert got(since=since, until=until) == {s for s, d in days.items() if low <= d <= high}
            assert got(since=since) == {s for s, d in days.items() if low <= d} and got(until=until) == {s for s, d in days.items() if d <= high}
    assert got(author="wren") == {"Wren", "wrenfield"} and got(author="^wren$") == {"Wren"} and got(author="(?:n@|r@)x") == {"Wren", "Dunlin", "Plover"}
    assert got(committer="^bot$", author="plov") == {"Plover"} and got(committer="plov") == set()


def test_walk_orders(spark):
    c = commits(spark, ("m", ["a", "b"], 9, "t"), ("a", ["r"], 1, "t"), ("b", ["r"], 8, "t"), ("r", [], 5, "t"), ("x", ["m"], 7, "t"))
    graph = history.Graph(c)
    walked = lambda *a, **k: [r.sha for r in history.heap_order(graph, spark, *a, **k).orderBy("walk").collect()]
    assert graph.skewed and walked(["m"]) == ["m", "b", "r", "a"]  # r is newer than its child a, but waits for b only
    assert walked(["x"]) == ["x", "m", "b", "r", "a"] and walked(["m"], first_parent=True) == ["m", "a", "r"] and walked(["m"], ["b"]) == ["m", "a"]
    assert not history.Graph(commits(spark, *DIAMOND)).skewed
    assert [(r.sha, r.walk_seq) for r in history.walk_order(c.repartition(3)).orderBy("walk_seq").collect()] == [("m", 1), ("b", 2), ("x", 3), ("r", 4),
        ("a", 5)]


def test_closures_by_jump_tables(spark):
    """Lines, merges that turn off again and again, and unknown parents, against a plain search."""
    import random

    rnd = random.Random(2)
    rows = [(f"c{i}", [f"c{rnd.randrange(i)}" for _ in range(rnd.choice((1, 1, 1, 2, 3)))] if i else [], i, "t") for i in range(120)]
    rows += [(f"l{i}", [f"l{i - 1}"] if i else ["gone"], i, "t") for i in range(70)]
    c = commits(spark, *rows)
    parents = {r[0]: r[1] for r in rows}

    def plain(start, first=False):
        seen, todo = set(), list(start)
        while todo:
            s = todo.pop()
            if s in parents and s not in seen:
                seen.add(s)
                todo += parents[s][:1] if first else parents[s]
        return seen
    for start in (["c119"], ["c60", "l69"], ["l5", "nowhere"]):
        for first in (False, True):
            got = shas(history.ancestors_by_joins(c, spark.createDataFrame([(s,) for s in start], "sha string"), first))
            assert got == plain(start, first) == shas(history.ancestors(c, start, first))


def test_ancestry_by_jump_tables(spark, monkeypatch):
    c = commits(spark, *[(str(i), [str(i - 1)] if i else [], i % 50, "t") for i in range(40)])
    monkeypatch.setattr(history, "DRIVER_GRAPH", 10)
    assert history.nth_ancestor(c, "39", 37) == "2" and history.nth_ancestor(c, "39",
        0) == "39" and shas(history.rev_range(c, ["20"], ["15"])) == {str(i) for i in range(16, 21)}
    with pytest.raises(ValueError):
        history.nth_ancestor(c, "39", 40)


def test_diff(spark):
    c = commits(spark, ("c1", [], 0, "t1"), ("c2", ["c1"], 1, "t2"), ("c3", ["c2"], 2, "t2"), ("c4", ["lost"], 3, "t2"))
    f = files(spark, ("t1", "a", 0o100644, "x"), ("t1", "b", 0o100644, "y"), ("t1", "l", 0o120000, "z"), ("t2", "a", 0o100755, "x"),
        ("t2", "b", 0o100644, "w"), ("t2", "l", 0o100644, "z"), ("t2", "s", 0o160000, "q"))
    got = {(r.sha, r.path) for r in history.tree_diff(c, f).collect()}
    # a changed its mode alone; l was a link with the same oid; c3 has its parent's tree; c4's parent is unknown
    assert got == {("c1", "a"), ("c1", "b"), ("c2", "b"), ("c4", "a"), ("c4", "b"), ("c4", "l")}
    assert history.tree_diff(c, f, expand_commits=True).count() == 2 + 3 * 3


def test_diff_of_some_commits(spark):
    """Parents that are not selected are still what their children are compared with."""
    c = commits(spark, ("c1", [], 0, "t1"), ("c2", ["c1"], 1, "t2"))
    f = files(spark, ("t1", "a", 0o100644, "x"), ("t2", "a", 0o100644, "x"), ("t2", "b", 0o100644, "y"))
    assert [r.path for r in history.tree_diff(c.where("sha = 'c2'"), f, False, c).collect()] == ["b"]


def test_met_order(spark):
    o = occurrences(spark, ("b1", "p", "s1", 1, "x"), ("b2", "a", "s9", 9, "x"), ("b2", "z", "s0", 0, "x"), ("b3", "q", "s5", 5, "x"))
    assert [(r.blob_oid, r.path) for r in attribution.as_met(o).collect()] == [("b2", "a"), ("b2", "z"), ("b3", "q"), ("b1", "p")]


def test_merges(spark):
    c = commits(spark, ("m", ["a", "b"], 3, "tm"), ("a", [], 1, "ta"), ("b", [], 2, "tb"))
    f = files(spark, ("tm", "p", 0o100644, "1"), ("tm", "q", 0o100644, "2"), ("ta", "p", 0o100644, "0"), ("tb", "p", 0o100644, "1"), ("tb", "q", 0o100644, "3"))
    diff = history.tree_diff(c, f)
    kept = {(r.sha, r.path) for r in history.suppress_merged(diff, c, f).collect()}
    assert ("m", "q") in kept and ("m", "p") not in kept and ("m", "p") in {(r.sha, r.path) for r in diff.collect()}


def test_expand(spark):
    e = spark.createDataFrame([("r", 0o40000, "d", "t1"), ("r", 0o100644, "a", "x"), ("t1", 0o40000, "e", "t2"), ("t1", 0o100644, "b", "y"),
        ("t2", 0o120000, "l", "z")], "tree_oid string, mode int, name string, oid string")
    roots = spark.createDataFrame([("r",), ("t1",), ("r",)], "tree_oid string")
    got = {(r.root, r.path, r.oid) for r in history.expand_trees(e, roots).collect()}
    assert got == {("r", "a", "x"), ("r", "d/b", "y"), ("r", "d/e/l", "z"), ("t1", "b", "y"), ("t1", "e/l", "z")}
    loop = spark.createDataFrame([("r", 0o40000, "d", "r")], "tree_oid string, mode int, name string, oid string")
    with pytest.raises(ValueError):
        history.expand_trees(loop, roots.limit(1), max_depth=3)


def occurrences(spark, *rows):
    return spark.createDataFrame([(b, p, s, T0 + timedelta(days=d), a) for b, p, s, d, a in rows],
        "blob_oid string, path string, commit_sha string, commit_ts timestamp, author string")


def test_attribution(spark):
    o = occurrences(spark, ("b", "f", "sha3", 3, "Cid"), ("b", "f", "sha1", 1, "Bob"), ("b", "f", "sha2", 2, "Ann"), ("b", "g", "sha2", 2, "Ann"))
    assert {(r.path, r.commit_sha, r.author) for r in attribution.introducing(o).collect()} == {("f", "sha1", "Bob"), ("g", "sha2", "Ann")}
    assert attribution.select_occurrences(o, True).count() == 4
    tie = occurrences(spark, ("b", "f", "s2", 1, "x"), ("b", "f", "s1", 1, "y"))
    assert attribution.introducing(tie).first().commit_sha == "s1"


def test_order(spark):
    o = occurrences(spark, ("b1", "old", "s1", 0, "a"), ("b2", "new", "s2", 9, "a"), ("b3", "old", "s3", 5, "a"), ("b3", "old", "s4", 5, "a"))
    assert [(r.path, r.commit_sha) for r in attribution.in_order(o).collect()] == [("new", "s2"), ("old", "s4"), ("old", "s3"), ("old", "s1")]
    ranks = {(r.path, r.commit_sha): (r.file_rank, r.commit_rank) for r in attribution.ranked(o).collect()}
    assert ranks == {("new", "s2"): (1, 1), ("old", "s4"): (2, 1), ("old", "s3"): (2, 2), ("old", "s1"): (2, 3)}
    assert tuple(attribution.totals(o).first()) == (4, 2) and tuple(attribution.totals(o.limit(0)).first()) == (0, 0)


def test_tildes_of_many_starts_by_joins(spark, monkeypatch):
    monkeypatch.setattr(history, "Graph", None)
    chain = [(f"{line}-{i}", [f"{line}-{i - 1}", "a-0"] if i else ["gone"], i, "t") for line in "abc" for i in range(12)]
    c, start = commits(spark, *chain), spark.createDataFrame([("a-11",), ("b-5",), ("c-4",), ("none",)], "sha string")
    for n, want in ((0, {("a-11", "a-11"), ("b-5", "b-5"), ("c-4", "c-4")}), (5, {("a-11", "a-6"), ("b-5", "b-0")}), (11, {("a-11", "a-0")}), (12, set())):
        assert {(r.start, r.sha) for r in history.nth_ancestors(c, start, n).collect()} == want


def test_refs_as_a_table_beyond_the_driver(spark, monkeypatch):
    """What a table of refs selects is what their names do, without a graph or a list of refs on the driver."""
    from palimpsest.options import SearchOptions
    from palimpsest.plans.engine import Source, select_commits

    c = commits(spark, *DIAMOND, ("n", ["m"], 5, "tn"))
    refs = {"HEAD": "n", "refs/heads/a": "a", "refs/heads/x": "x"}
    told = [SearchOptions(("p",), **o) for o in ({"all": True}, {"branches": ("x", "none")}, {"rev_range": "HEAD~1..HEAD"}, {"rev_range": "a"})]
    want = [shas(select_commits(Source(c, refs=refs), o)) for o in told]
    assert want == [{"n", "m", "a", "b", "r", "x"}, {"n", "m", "a", "b", "r", "x"}, {"n"}, {"a", "r"}]
    monkeypatch.setattr(history, "DRIVER_GRAPH", 0)
    monkeypatch.setattr(history, "Graph", None)
    table = spark.createDataFrame(list(refs.items()), "name string, oid string")
    assert [shas(select_commits(Source(c, refs=table), o)) for o in told] == want
