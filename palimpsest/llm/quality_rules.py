"""Quality rules: a table of thresholds over length, symbol, stop-word and line ratios, compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WHITE_CLASS, WORD, let, renamed, text_of, words

# Frequent function words, by language; a language that is not listed is not held to the stop-word rule.
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "a", "in", "that", "have", "with", "for", "is", "on", "it", "as", "was", "by", "at", "this", "are", "from", "or",
        "an"),
    "de": ("der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als",
        "auch", "es", "an"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne",
        "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más"),
}

# The rules: a measure of the projection below, and the least and most that it may be.
RULES = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)


def repeated_windows(w: Column) -> Column:
    """Words of an array that lie in a 3-word window found twice or more, the first included.

    Windows go by a 64-bit hash. Where all hashes differ, which one pass shows, nothing is sorted; else windows are
    sorted by hash, and neighbours that are equal give the positions.
    """
    shifted = lambda n: F.slice(w, F.lit(1 + n), F.greatest(F.size(w) - 2, F.lit(0)))
    hashes = F.transform(F.arrays_zip(shifted(0).alias("a"), shifted(1).alias("b"), shifted(2).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    def covered(sorted_: Column) -> Column:
        n = F.size(sorted_)
        pairs = F.zip_with(F.slice(sorted_, F.lit(1), n - 1), F.slice(sorted_, F.lit(2), n - 1), lambda a,
            b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
        return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)))).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, base measures, ratios) for every row; null text counts as empty, whose measures are all 0."""
    d = renamed(docs, doc_id=id_col, text=text_col, lang=lang_col).select("doc_id", "lang", text_of(F.col("text")).alias("text"))
    d = d.withColumns({"w": words(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))})
    stop = F.lit(None).cast("array<string>")
    for lang, listed in STOP_WORDS.items():
        stop = F.when(F.col("lang") == lang, F.array(*map(F.lit, listed))).otherwise(stop)
    n_lines = F.size("lines")
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WHITE_CLASS + "+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_windows(F.col("w")).alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        let(stop, lambda s: F.when(s.isNotNull(), F.size(F.filter("w", lambda x: F.array_contains(s, x))))).cast("long").alias("n_stop"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(…|\.\.\.)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipses"),
    )


RATIOS = {
    "mean_word_chars": lambda: _ratio(F.col("word_chars"), F.col("n_words")),
    "symbol_ratio": lambda: _ratio(F.col("n_symbols"), F.col("n_words")),
    "stop_ratio": lambda: _ratio(F.col("n_stop"), F.col("n_words")),
    "dup_line_ratio": lambda: _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    "repeat_ratio": lambda: _ratio(F.col("n_repeat_words"), F.col("n_words")),
    "bullet_line_ratio": lambda: _ratio(F.col("n_bullets"), F.col("n_lines")),
    "ellipsis_line_ratio": lambda: _ratio(F.col("n_ellipses"), F.col("n_lines")),
}


def verdict(rules=RULES) -> Column:
    """True if every rule holds; a measure that is null, such as stop words of a language without a list, passes."""
    kept = F.lit(True)
    for name, least, most in rules:
        value = RATIOS[name]() if name in RATIOS else F.col(name)
        for bound, ok in ((least, value >= F.lit(least)), (most, value <= F.lit(most))):
            if bound is not None:
                kept = kept & F.coalesce(ok, F.lit(True))
    return kept


def apply_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The measures of every row with base_failed and kept. Nothing is dropped; callers filter by kept.

    Each row is judged by itself: repeated rows, null and repeated ids give a row each; of no rows, no rows come. Null
    and empty texts have measures of 0 and fail the base; very long texts are measured whole. A null language has no
    stop-word rule. Other columns are left out, whatever their names. A measure that equals its bound passes.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col, lang_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def digest(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _list(items) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


SQL = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  CASE lang {' '.join(f"WHEN '{k}' THEN len(list_filter(w, lambda x: list_contains({_list(v)}, x)))" for k, v in STOP_WORDS.items())} END AS n_stop,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
  len(list_filter(lines, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 12.0 AND n_symbols / n_words <= 0.1
  AND coalesce(n_stop / n_words >= 0.02, true) AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5
  AND n_bullets / n_lines <= 0.9 AND n_ellipses / n_lines <= 0.3 AS kept
FROM f
"""
