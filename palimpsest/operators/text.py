"""Operators on blobs and their lines: dedup, prefilter, matching, spans, limits, context, binaries.

A blob table has blob_oid and content (text), and may have data (bytes) and error. Matching runs partition by partition,
in generated code, or in Arrow's RE2 kernels where a pattern could backtrack without bound; only limits and context need a
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import linear
from palimpsest.options import SearchOptions

BINARY_PREFIX = 8000
# Noncharacters that mark where matches begin and end; in the text itself they stand replaced by their like.
OPEN, CLOSE, LIKE = "\ufdd0", "\ufdd1", "\ufdd2"
# Another that stands for a byte that is not UTF-8: one character, and one byte wide.
BAD = "\ufdd3"


def matches(text: Column, options: SearchOptions) -> Column:
    """Whether the text has a match. A plain literal is looked up without a regex."""
    literal = options.literal()
    return F.contains(text, F.lit(literal)) if literal is not None else linear.search(text, options.pattern(), ignore_case=options.folds_case())


def matches_each(texts: Column, options: SearchOptions) -> Column:
    """Whether each text of an array has a match."""
    literal = options.literal()
    if literal is not None:
        return F.transform(texts, lambda t: F.contains(t, F.lit(literal)))
    return linear.search_each(texts, options.pattern(), ignore_case=options.folds_case())


def blob_matches(content: Column, options: SearchOptions) -> Column:
    """The blob-level verdict: inverted, a blob matches if no part of it does."""
    found = matches(content, options)
    return ~found if options.invert_match else found


def prefilter(blobs: DataFrame, options: SearchOptions) -> DataFrame:
    """Blobs that can have matching lines, judged on the raw content; inverted searches keep all."""
    return blobs if options.invert_match else blobs.where(matches(F.col("content"), options))


def is_binary(data: Column) -> Column:
    """A NUL in the first 8000 bytes."""
    return F.contains(F.substring(data, 1, BINARY_PREFIX), F.lit(b"\0"))


def distinct_blobs(blobs: DataFrame) -> DataFrame:
    """Each content once, however many commits hold it."""
    return blobs.dropDuplicates(["blob_oid"])


def line_array(content: Column) -> Column:
    """Lines without their line feed and one carriage return before it; a final line feed starts no further line."""
    ended = F.when(content.endswith("\n"), F.substr(content, F.lit(1), F.length(content) - 1)).otherwise(content)
    lines = F.transform(F.split(ended, "\n", -1), lambda x: F.when(x.endswith("\r"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.when(content == "", F.array().cast("array<string>")).otherwise(lines)


def split_lines(blobs: DataFrame) -> DataFrame:
    """Adds line_num, from 1, and line_text, in place of content and data."""
    keep = [c for c in blobs.columns if c not in ("content", "data")]
    return blobs.select(*keep, F.posexplode(line_array(F.col("content"))).alias("pos", "line_text")).select(*keep, (F.col("pos") + 1).alias("line_num"),
        "line_text")


def match_lines(blobs: DataFrame, options: SearchOptions) -> DataFrame:
    """One row a matching line, at most max_count lines a blob: (blob's columns, line_num, line_text).

    Blobs are filtered on their whole content before they are split, so what a pattern says of the whole blob, such as
    its ends or a line feed, must hold there too.
    """
    lines = split_lines(prefilter(blobs, options))
    hit = matches(F.col("line_text"), options)
    return first_matches(lines.where(~hit if options.invert_match else hit), options.max_count)


def first_matches(lines: DataFrame, max_count: int) -> DataFrame:
    """The first max_count rows of each blob; 0 is no limit. Ranks are limited before they are computed for all rows."""
    if max_count <= 0:
        return lines
    rank = F.expr("row_number() OVER (PARTITION BY blob_oid ORDER BY line_num)")
    return lines.withColumn("__rank", rank).where(F.col("__rank") <= max_count).drop("__rank")


def spans(line: Column, options: SearchOptions) -> Column:
    """Byte ranges of a line's matches, leftmost and not overlapping, as an array of (start, end), end exclusive.

    Matches are marked by a replacement, and the marks' places tell the ranges. An empty match right behind another is none.
    """
    if options.invert_match:
        return F.array().cast("array<struct<start:int,end:int>>")
    free = F.translate(line, OPEN + CLOSE, LIKE + LIKE)
    return linear.spans(free, options.pattern(), (OPEN, CLOSE, BAD), ignore_case=options.folds_case())


def match_counts(lines: DataFrame) -> DataFrame:
    """(blob_oid, n_matches) of matching lines."""
    return lines.groupBy("blob_oid").agg(F.count("*").alias("n_matches"))


def context_lines(blobs: DataFrame, options: SearchOptions) -> DataFrame:
    """(blob_oid, group_id, line_num, line_text, is_match): matching lines with the lines around them, in groups.

    Ranges around matches merge where they touch; with no context asked for, each match is its own group. Lines behind
    the last counted match are context even if they match. All windows are per blob: one shuffle, on what they share.
    """
    before, after = options.before_context, options.after_context
    lines = split_lines(prefilter(blobs, options)).select("blob_oid", "line_num", "line_text")
    hit = matches(F.col("line_text"), options)
    marked = lines.withColumn("hit", ~hit if options.invert_match else hit)
    if options.max_count > 0:
        marked = marked.withColumn("hit", F.col("hit") & (F.expr("sum(cast(hit AS int)) OVER (PARTITION BY blob_oid ORDER BY line_num)") <= options.max_count))
    w = "PARTITION BY blob_oid ORDER BY line_num"
    near = marked.select(
        "*",
        F.expr(f"max(CASE WHEN hit THEN line_num END) OVER ({w} ROWS BETWEEN {after} PRECEDING AND CURRENT ROW)").alias("back"),
        F.expr(f"min(CASE WHEN hit THEN line_num END) OVER ({w} ROWS BETWEEN CURRENT ROW AND {before} FOLLOWING)").alias("ahead"),
    ).where("back IS NOT NULL OR ahead IS NOT NULL")
    starts = F.lit(True) if before == 0 and after == 0 else F.coalesce(F.expr(f"line_num > 1 + lag(line_num) OVER ({w})"), F.lit(True))
    return near.withColumn("new", starts.cast("int")).select(
        "blob_oid", F.expr(f"sum(new) OVER ({w})").cast("int").alias("group_id"), "line_num", "line_text", F.col("hit").alias("is_match"))


def exists(df: DataFrame) -> bool:
    """Whether there is any row; partitions are tried a few at a time."""
    return not df.isEmpty()

