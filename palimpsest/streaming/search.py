"""Searching blobs as they arrive: the operators of a batch search that need no state, and dedup of what came before.

An extension of the batch search: matches are told as soon as their blob is read, in no order, and attributed against a
static table of occurrences. A micro-batch that fails is run again as a whole; sinks get each batch with its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import text
from palimpsest.options import SearchOptions

BLOBS = "blob_oid string, content string, arrived timestamp"


def read_blobs(spark: SparkSession, path: str, format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream of blobs from files that are added to a folder."""
    reader = spark.readStream.format(format).schema(BLOBS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def first_arrivals(blobs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each content once within the delay; what is remembered of it is bounded by the delay."""
    return blobs.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["blob_oid"])


def stream_matches(blobs: DataFrame, options: SearchOptions, occurrences: DataFrame | None = None, delay: str = "1 day") -> DataFrame:
    """Matching lines of arriving blobs, with their occurrences where a table of them is given.

    A limit of matches a blob and context need the lines of one blob only, so they are taken from its array of lines.
    """
    options.validate()
    once = first_arrivals(blobs, delay)
    lines = text.line_array(F.col("content"))
    placed = F.transform(F.arrays_zip(lines.alias("line"), text.matches_each(lines, options).alias("hit")),
        lambda s, i: F.struct((i + 1).alias("line_num"), s["line"].alias("line_text"), s["hit"].alias("hit")))
    found = F.transform(F.filter(placed, lambda s: s["hit"] != F.lit(options.invert_match)), lambda s: F.struct(s["line_num"], s["line_text"]))
    if options.max_count > 0:
        found = F.slice(found, 1, options.max_count)
    rows = text.prefilter(once, options).select("blob_oid", F.inline(found))
    return rows if occurrences is None else rows.join(occurrences, "blob_oid")


def aggregate_channel(matches: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feeds each micro-batch of matches to a sink as counts per blob; stop() of what is returned cancels."""
    keys = [c for c in ("blob_oid", "path", "commit_sha") if c in matches.columns]
    writer = matches.writeStream.foreachBatch(lambda df, n: sink(df.groupBy(*keys).agg(F.count("*").alias("n_matches")), n)).option("checkpointLocation",
        checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
