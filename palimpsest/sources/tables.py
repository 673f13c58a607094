"""Parquet tables as history: which columns stand for blobs, commits, trees and paths, by fixed formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions of derived paths, by doc_id modulo 7.
EXTENSIONS = (".go", ".py", ".md", ".json", ".rs", ".sql", ".txt")
PARTITION_ROWS = 250_000  # rows of a table for each partition that it is dealt to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of documents by their hash."""
    return table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "UTF-8")).alias("blob_oid"),
        F.col("text").alias("content")).dropDuplicates(["blob_oid"])


def edge_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of which a fifth ends in a carriage return and line feed, and a fifth in a line feed."""
    n = F.pmod(F.length("content"), F.lit(5))
    return blobs(spark, sf_dir).withColumn("content", F.when(n == 0, F.concat("content", F.lit("\r\n"))).when(n == 1,
        F.concat("content", F.lit("\n"))).otherwise(F.col("content")))


def long_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a source joined to one line, twenty documents' numbers each, as minified files are."""
    line = F.translate("text", "\n\r", "  ")
    docs = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 20).alias("k"), F.struct("doc_id", line.alias("line")).alias("d"))
    lines = docs.groupBy("source", "k").agg(F.array_sort(F.collect_list("d")).alias("d"))
    lines = lines.select(F.array_join(F.transform("d", lambda d: d["line"]), " ").alias("content"))
    return lines.select(F.sha1(F.encode("content", "UTF-8")).alias("blob_oid"), "content").dropDuplicates(["blob_oid"])


def document_path() -> Column:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    return F.concat("source", F.lit("/m"), (F.floor(F.col("doc_id") / 20) % 10).cast("string"), ext)


def document_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(blob_oid, path, commit_sha, commit_ts, author_name): a document occurs in the commit of the event of its number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("blob_oid"), document_path().alias("path"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("commit_ts"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("author_name"))
    return docs.join(events, F.col("doc_id") == F.col("event_id")).select(
        "blob_oid", "path", F.sha1(F.col("doc_id").cast("string")).alias("commit_sha"), "commit_ts", "author_name")


def document_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those commits as a commits table, without trees or parents."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("user_"), F.col("user_id"))
    mail = F.concat(name, F.lit("@example.com"))
    who = F.concat(name, F.lit(" <"), mail, F.lit(">"))
    return e.select(
        F.sha1(F.col("event_id").cast("string")).alias("sha"), F.lit(None).cast("string").alias("tree_oid"),
            F.array().cast("array<string>").alias("parents"), F.col("ts").cast("timestamp").alias("commit_ts"),
        who.alias("author"), name.alias("author_name"), mail.alias("author_email"), F.concat(F.lit("bot "), F.col("event_type")).alias("committer"),
            F.concat(F.lit("bot "), F.col("event_type")).alias("committer_name"), F.lit("").alias("committer_email"))


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: the parent is the customer's order before; every fifth order also merges a neighbour's first.

    (sha, parents, commit_ts, cust, author...), sha the order's key as text.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("commit_ts"))
    before = o.withColumn("parent", F.expr("lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY commit_ts, o_orderkey)"))
    firsts = o.groupBy((F.col("o_custkey") + 1).alias("o_custkey")).agg(F.min("o_orderkey").alias("other"))
    joined = before.join(firsts, "o_custkey", "left")
    merge = (F.col("o_orderkey") % 5 == 0) & F.col("parent").isNotNull() & F.col("other").isNotNull()
    name = F.concat(F.lit("cust_"), F.col("o_custkey"))
    return joined.select(
        F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderkey").cast("string").alias("tree_oid"),
        F.filter(F.array(F.col("parent").cast("string"), F.when(merge, F.col("other").cast("string"))), lambda p: p.isNotNull()).alias("parents"),
        "commit_ts", F.col("o_custkey").alias("cust"), name.alias("author"), name.alias("author_name"),
            F.concat(name, F.lit("@example.com")).alias("author_email"))


def _parts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, path, f: mode and oid), dealt once by order, as keys and quantities; what follows by order, and joins with its
    name as a tree, are not dealt again.

    Partitions are as many as the rows ask for, so what a task holds does not grow with the table.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("order"), "l_partkey", "l_quantity")
    one = li.repartition(1 + li.count() // PARTITION_ROWS, "order").groupBy("order", "l_partkey").agg(F.min("l_quantity").alias("q"))
    part = F.col("l_partkey") % 40
    oid = F.sha1(F.concat(part.cast("string"), F.lit(":"), (F.col("q") % 3).cast("int").cast("string")))
    one = one.select("order", part.alias("part"), F.struct(F.when(F.col("l_partkey") % 10 == 0, 0o120000).otherwise(0o100644).alias("mode"), oid.alias("oid")).alias("f"))
    return one.groupBy("order", "part").agg(F.min("f").alias("f")).select("order", F.concat(F.lit("part/"), F.col("part").cast("string"),
        F.lit(".txt")).alias("path"), "f")


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path, mode, oid): the parts of an order, a tenth of them symlinks; the oid is of the part and half its quantity's class."""
    return _parts_of_orders(spark, sf_dir).select(F.col("order").alias("root"), "path", "f.mode", "f.oid")


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_oid, held: array of mode, name and oid): those files as trees, named by order on top and below by what is in them.

    What orders hold is derived once and written down.
    """
    from palimpsest.operators.history import stored

    files = _parts_of_orders(spark, sf_dir).select("order", F.element_at(F.split("path", "/"), 2).alias("name"), "f.mode", "f.oid")
    told = F.sort_array(F.collect_list(F.concat_ws(" ", F.col("mode").cast("string"), "name", "oid")))
    tops = stored(files.groupBy("order").agg(F.collect_list(F.struct("mode", "name", "oid")).alias("held"), F.sha1(F.array_join(told, "\n").cast("binary")).alias("sub")))
    folder = F.array(F.struct(F.lit(0o040000).alias("mode"), F.lit("part").alias("name"), F.col("sub").alias("oid")))
    # Of equal trees, one is told.
    return tops.select(F.col("order").alias("tree_oid"), folder.alias("held")).unionByName(
        stored(tops.select(F.col("sub").alias("tree_oid"), "held").repartition("tree_oid").dropDuplicates(["tree_oid"])))


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_oid, mode, name, oid): the entries of those trees."""
    return order_trees(spark, sf_dir).select("tree_oid", F.inline("held"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as snapshots: (conv_id, turn, path, oid), path the role."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("path"), F.sha1(F.encode("text", "UTF-8")).alias("oid"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: (page_id, path, content), path the address without its scheme."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("content"))
