"""What the operators of this subpackage share: text primitives, table reading, cutting lineage."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shipping import ship

# The white space that separates words, and ASCII case.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. lower() is the fast way where every character is one byte."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(col: Column) -> Column:
    """The words of a text without nulls, as an array: maximal runs outside WHITE."""
    trimmed = F.btrim(col, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode, where one machine is all."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not urlparse(found).scheme and found.startswith("/"):
        found = "file://" + found
    return found


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """What is run inside has this setting; the one before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there, so that lost executors cost no recomputation.

    What was shuffled on the way goes once df is written, as nothing reads it again; else it stays until the driver's
    garbage is collected, and many short steps fill the disk.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with setting(df.sparkSession, DROP_SHUFFLES, "true"):
        return df.select("*").checkpoint()  # a plan of its own: that of df may be run again


def file_system(uri: str):
    """(file system, path) of a URI of any store that pyarrow knows."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def blocked(docs: DataFrame) -> DataFrame:
    """docs with __block, the split of the input that a row lies in: the same each time that the rows are read.

    Rows of files are told by the file and the split's start. Others, such as those behind a shuffle, are written to
    the shared folder first, with the partition they are in.
    """
    name = F.input_file_name()
    if docs.where(name == "").isEmpty():
        return docs.withColumn("__block", F.xxhash64(name, F.input_file_block_start()))
    return cut(docs.withColumn("__block", F.spark_partition_id().cast("long")))


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """What is run inside hands so many rows at most to Python at once, for rows of kilobytes: both sides hold a batch or two."""
    before = spark.conf.get(BATCH_ROWS)
    with setting(spark, BATCH_ROWS, before if 0 < int(before) <= rows else str(rows)):
        yield


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names: what other columns are called cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


NO_ID = -(1 << 63)


def id_key(col: Column, kind: str) -> Column:
    """An id as a key that is never null and sorts as the id does, null first: a number, or a struct of other types."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(col.cast("long"), F.lit(NO_ID))
    return F.struct(col.isNotNull().alias("known"), col.alias("id"))


FILTER_BITS = 27  # 16 MB at most, however many keys there are


def narrowed(df: DataFrame, key: Column, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of df whose key may be among the first column of keys: none that is there is lost, few others stay.

    A bitmap of the keys' hashes, of bounded size, is broadcast in pieces of 2^15 bits, so that a join behind it need
    not shuffle what it has no use for. With more keys than bits all rows stay, and the join does the whole work.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit("narrowed"), c), F.lit(1 << bits))
    held = keys.select(place(keys[keys.columns[0]]).alias("p")).groupBy(F.shiftright("p", 15).alias("__piece")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("__bits"))
    placed = df.withColumn("__place", place(key))
    found = placed.join(F.broadcast(held), F.shiftright("__place", 15) == F.col("__piece"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast((__place & 32767) >> 3 AS int) + 1, 1)")), 16, 10).cast("int")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(__place & 7 AS int))")) != 0).select(*[F.col(f"`{c}`") for c in df.columns])
