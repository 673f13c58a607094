import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import text
from palimpsest.options import SearchOptions


def blobs(spark, *contents):
    return spark.createDataFrame([(f"b{i}", c) for i, c in enumerate(contents)], "blob_oid string, content string")


def nums(df):
    return sorted((r.blob_oid, r.line_num) for r in df.collect())


def search(spark, content, *patterns, **options):
    return [r.line_num for r in text.match_lines(blobs(spark, content), SearchOptions(patterns, **options)).orderBy("line_num").collect()]


def test_matching(spark):
    poem = "Roses (red)\nviolets [blue]\nROSES again\nprimroses\n"
    assert search(spark, poem, "(red)", fixed_strings=True) == [1] and search(spark, poem, r"\[b\w+\]") == [2]
    assert search(spark, poem, "roses", smart_case=True) == [1, 3, 4] and search(spark, poem, "Roses", smart_case=True) == [1] and search(spark, poem,
        "roses", ignore_case=True) == [1, 3, 4]
    assert search(spark, poem, "roses", word_regexp=True) == [] and search(spark, poem, "roses", word_regexp=True, ignore_case=True) == [1, 3]
    assert search(spark, poem, "e", invert_match=True) == [3] and search(spark, poem, "again", "blue") == [2, 3]
    log = "ok\nerr\nok\nerr\nok\n"
    assert search(spark, log, "ok", max_count=2) == [1, 3] and search(spark, log, "ok", max_count=0) == [1, 3, 5] and search(spark, log, "ok",
        invert_match=True, max_count=1) == [2]


def test_two_stages(spark):
    assert search(spark, "foo\r\nfoo\r\n", "foo$") == []  # the whole blob has no line that ends in foo
    assert search(spark, "foo\r\nfoo\nfoo\r\n", "foo$") == [1, 2, 3]
    assert search(spark, "a\nb\n", "a\nb") == [] and search(spark, "b\nb", r"\Ab") == [1, 2]


def test_lines(spark):
    got = {c: [r.line_text for r in text.split_lines(blobs(spark, c)).orderBy("line_num").collect()] for c in ("", "\n", "a", "a\n", "a\r\nb\r\r\n",
        "a\n\n", "\r\n")}
    assert got == {"": [], "\n": [""], "a": ["a"], "a\n": ["a"], "a\r\nb\r\r\n": ["a", "b\r"], "a\n\n": ["a", ""], "\r\n": [""]}


def groups(hits, n, before, after, most=0):
    """[(group, line, whether it is a match)] of n lines: ranges around the first matches, joined where they touch."""
    counted = hits[:most] if most else hits
    near = [i for i in range(1, n + 1) if any(h - before <= i <= h + after for h in counted)]
    out = []
    for i in near:
        new = not out or i > out[-1][1] + 1 or not before and not after
        out.append((out[-1][0] + new if out else 1, i, i in counted))
    return out


@pytest.mark.parametrize("before,after,most", [(0, 0, 0), (1, 1, 0), (2, 0, 0), (0, 2, 0), (3, 1, 2), (0, 3, 1), (9, 9, 0)])
def test_context(spark, before, after, most):
    texts = [[1], [2, 3, 9, 17], [4, 8, 12, 13, 20], [20], []]
    df = blobs(spark, *["".join(f"{'otter' if i in hits else 'heron'} {i}\n" for i in range(1, 21)) for hits in texts])
    rows = text.context_lines(df, SearchOptions(("otter",), before_context=before, after_context=after, max_count=most)).orderBy("blob_oid", "line_num").collect()
    for k, hits in enumerate(texts):
        assert [(r.group_id, r.line_num, r.is_match) for r in rows if r.blob_oid == f"b{k}"] == groups(hits, 20, before, after, most)


def test_binary(spark):
    df = spark.createDataFrame([(1, b"a" * 7999 + b"\0"), (2, b"a" * 8000 + b"\0"), (3, b"")], "i int, d binary")
    assert [r.b for r in df.orderBy("i").select(text.is_binary(F.col("d")).alias("b")).collect()] == [True, False, False]


@pytest.mark.parametrize("line,pattern,expected", [
    ("héllo wörld", "[lo]+", None), ("abcabc", "b", [(1, 2), (4, 5)]), ("baaac", "a*", [(0, 0), (1, 4), (5, 5)]), ("éé", "é", [(0, 2), (2, 4)]),
        ("", "x*", [(0, 0)]), ("aaa", "a", [(0, 1), (1, 2), (2, 3)]), ("xay", "(a)|(b)", [(1, 2)]),
])
def test_spans(spark, line, pattern, expected):
    if expected is None:
        import re

        expected = [(len(line[:m.start()].encode()), len(line[:m.end()].encode())) for m in re.finditer(pattern, line)]
    row = spark.createDataFrame([(line,)], "l string").select(text.spans(F.col("l"), SearchOptions((pattern,))).alias("s")).first()
    assert [(s.start, s.end) for s in row.s] == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab\n\r.é", max_size=30), st.text(alphabet="ab.é", min_size=1, max_size=3))
def test_literals(spark, content, literal):
    df = blobs(spark, content)
    options = SearchOptions((literal,), fixed_strings=True)
    lines = {r.line_num: r.line_text for r in text.split_lines(df).collect()}
    hit = {n for _, n in nums(text.match_lines(df, options))}
    assert hit == {n for n, t in lines.items() if literal in t}
    inverted = {n for _, n in nums(text.match_lines(df, options.with_(invert_match=True)))}
    assert len(hit) + len(inverted) == len(lines)
