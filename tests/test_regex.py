import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import linear
from palimpsest.functions.regex import PatternError, quote, translate
from palimpsest.operators import text
from palimpsest.options import SearchOptions

TEXTS = ["", "foo", "foo\r", "a foo b\nbar", "étion nation", "É é K k ſ", "x\x0by z", "a.b[c]{2}", "\u0085 ", "ab\n", "[x]&&y", "tab\there", "0123456789",
    "aaa{,2}", "über Straße", "\n", "A-Z_9", "istanbul", "\u0131stanbul", "\u0130STANBUL", "\u0131x \u0130x ix", "\u212a \u017f"]
PATTERNS = [
    r"\bfoo\b", r"foo$", r"(?i)é", r"\btion\b", r"\Btion", r"x\sy", r"[\s\d]", r"[[:alpha:]]+\s", r"[^[:space:]]", r"(?P<n>fo+)", r"a{2}", r"a{,2}",
        r"[a&&b]y", r"[[x]\]", r"\Qa.b[\E", r"^$", r"^b", r"(?U)a+b", r"\x{e9}", r"\pL+", r"\p{Greek}|\p{Lu}",
    r"(?-m)foo$", r"(?s)foo.*bar", r"a.*?b", r"\v", r"[\v\S]x", r"]", r"}", r"\z", r"\Aa", r"(?i:K)", r"x|", r"\W", r"[A-Z_]", r"\101|\x41", r"ſ",
        "istanbul", "[a-z]+x", "^[^i]", r"\x69s", r"\Qi\E", "[[:alpha:]]x", r"^\w", r"^\W", "\u0131", "[\u0131]", "[^\u0130]x", r"\151", "(?i)I", "(?i:i)x",
]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_agrees_with_re2(spark, ignore_case):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", *[F.col("t").rlike(translate(p, ignore_case=ignore_case)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).orderBy("i").collect()
    for k, p in enumerate(PATTERNS):
        want = pc.match_substring_regex(pa.array(TEXTS), pattern=("(?mi)" if ignore_case else "(?m)") + p).to_pylist()
        assert [r[f"p{k}"] for r in rows] == want, p


PIECES = ["i", "I", "\u0131", "\u0130", "k", "s", "\u017f", "[a-z]", "[^a-z]", "[i-k]", "[^iS]", r"\w", r"\W", r"[\w-]", ".", r"\x49", "x", "é", "[É-Í]",
    "(?:i|x)", "[[:lower:]]", r"\d", "$", "^", "i*", "[hi]+"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=3).map("".join), min_size=8, max_size=8),
    st.lists(st.text(alphabet="iI\u0131\u0130kK\u212asS\u017faxéÉ1-\n", max_size=5), min_size=30, max_size=30), st.booleans())
def test_random_patterns_agree_with_re2(spark, patterns, texts, ignore_case):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[F.col("t").rlike(translate(p, ignore_case=ignore_case)).alias(f"p{k}") for k, p in enumerate(patterns)]).orderBy("i").collect()
    for k, p in enumerate(patterns):
        want = pc.match_substring_regex(pa.array(texts), pattern=("(?mi)" if ignore_case else "(?m)") + p).to_pylist()
        assert [r[f"p{k}"] for r in rows] == want, p


@pytest.mark.parametrize("pattern", ["(a|b", "x)", "[q", "?y", "a|*", "b{7,3}", r"\x{zz}", r"\p{Klingon}", "(?<=a)b", "(?!b)", r"(.)\1", "x*+", "c{2000}",
    "d??*", r"\8"])
def test_rejects(pattern):
    with pytest.raises(PatternError):
        translate(pattern)


def test_quote(spark):
    text = r"a.b*c[d](e){f}|^$\?+"
    assert spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(translate(quote(text)))).count() == 1


@pytest.mark.parametrize("pattern,hands_over", [("plain", False), (r"\bword\b", False), ("a+b", True), ("(?:x)?y?", False), ("(x|y)", False), ("[)]", False), (r"\)?x", False),
    (r"\Q(a)\E?", False), ("a{3}b{2}", False), ("(ab)+", True), ("(?:ab)*c", True), ("(a|b){2,}", True), ("(ab){3}", True), ("(?i:x)+", True), (".*x.*y", True), ("a{60}b{0,70}", True)])
def test_what_is_handed_to_the_automaton(pattern, hands_over):
    assert linear.backtracks(pattern) is hands_over


def found(spark, texts, patterns, **flags):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return df.select("i", *[linear.search(F.col("t"), p, **flags).alias(f"p{k}") for k, p in enumerate(patterns)]).orderBy("i").collect()


def test_long_texts_in_linear_time(spark):
    texts = ["word " * 20_000, "word " * 20_000 + "!", "ab" * 50_000 + "c", "ab" * 50_000, '"' + 'x\\"' * 33_000 + '"', '"' + 'x\\"' * 33_000, "a" * 100_000, None]
    patterns = [r"(\w+\s)+$", "(a|b)*c", r'"([^"\\]|\\.)*"', "(a+)+$", "(a+)+!", ".*b.*c.*d"]
    for k, p in enumerate(patterns):
        want = pc.match_substring_regex(pa.array(texts), pattern="(?m)" + p).to_pylist()
        assert [r[f"p{k}"] for r in found(spark, texts, patterns)] == want, p


GROUPS = ["(?:i|x)+", "(a|b)*", "(?:[a-z]\\s?)+", "(\\w+ )+", "(?:é|E)*x", "(x+x+)+y", "(?:^|a)+", "(?i:K|s)+", "(ab?){2,3}", "(a*)*$", "(?:b|)+", ".*i.*"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(GROUPS), st.sampled_from(PIECES)).map("".join), min_size=6, max_size=6),
    st.lists(st.tuples(st.text(alphabet="iI\u0131kK\u212asabxé 1\n", max_size=6), st.sampled_from([1, 3, 4000])).map(lambda p: p[0] * p[1]), min_size=20, max_size=20),
    st.booleans(), st.booleans())
def test_random_repeated_groups_agree_with_re2(spark, patterns, texts, ignore_case, multiline):
    rows = found(spark, texts, patterns, ignore_case=ignore_case, multiline=multiline)
    flags = "m" * multiline + "i" * ignore_case
    for k, p in enumerate(patterns):
        want = pc.match_substring_regex(pa.array(texts), pattern=(f"(?{flags})" if flags else "") + p).to_pylist()
        assert [r[f"p{k}"] for r in rows] == want, p


def spans_of(line, pattern):
    """Ranges by bytes, a byte for the character that stands for a broken one; an empty match right behind another is none."""
    raw = line.replace(text.BAD, "\x00")
    ends, out = [0], []
    for c in raw:
        ends.append(ends[-1] + len(c.encode()))
    for m in re.finditer(pattern.replace(text.BAD, "\x00"), raw, re.M):
        if m.start() != m.end() or not out or out[-1][1] != ends[m.start()]:
            out.append((ends[m.start()], ends[m.end()]))
    return out


def test_spans(spark):
    lines = ["", "foo bar foo", "é foo\ufdd3foo", "aaa", "b a c", "x", "ééé\ufdd3\ufdd3a", "abab ab", "foo" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, None, "\ufdd0 a \ufdd1"])], "i int, t string").coalesce(2)
    for p in ("foo", "(?:foo)+", "a*", "(ab)+", "x|", "(?:é)+", "[^ ]+ *[^ ]+", "(?:\ufdd3|a)+", "^", "$", "é|b"):
        rows = df.select("i", text.spans(F.col("t"), SearchOptions((p,))).alias("s")).orderBy("i").collect()
        assert [[tuple(s) for s in r.s] for r in rows[:len(lines)]] == [spans_of(t, p) for t in lines], p
        assert rows[-2].s is None and all(s.end <= 9 for s in rows[-1].s)  # what marks matches may be in a text


def test_arrays_of_texts(spark):
    df = spark.createDataFrame([(1, ["ab ab", None, "x"]), (2, []), (3, None), (4, ["ab"])], "i int, t array<string>").coalesce(1)
    for p in ("(ab ?)+$", "ab"):
        assert [r.h for r in df.select("i", linear.search_each(F.col("t"), p).alias("h")).orderBy("i").collect()] == [[True, None, False], [], None, [True]]
