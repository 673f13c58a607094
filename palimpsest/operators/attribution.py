"""From matches to commits: which commit a blob's matches belong to, and in what order they are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.history import numbered


def author(name: Column, identity: Column) -> Column:
    """The author's name, or the whole identity where there is no name."""
    return F.coalesce(F.nullif(name, F.lit("")), identity)


def introducing(occurrences: DataFrame) -> DataFrame:
    """Of each blob at each path, the occurrence in the earliest commit; the smaller sha among equals.

    min_by keeps one row a group on the map side already, so a blob that many commits hold is no hot key.
    """
    keys = ["blob_oid", "path"]
    rest = [c for c in occurrences.columns if c not in keys]
    best = occurrences.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("commit_ts", "commit_sha")).alias("o"))
    return best.select(*keys, *[F.col("o")[c].alias(c) for c in rest]).select(*occurrences.columns)


def select_occurrences(occurrences: DataFrame, expand_commits: bool) -> DataFrame:
    return occurrences if expand_commits else introducing(occurrences)


def attribute(matches: DataFrame, occurrences: DataFrame, unique: bool = False) -> DataFrame:
    """Each match with each selected occurrence of its blob. A commit has one blob at a path; if told two, the first wins.

    unique: occurrences come from trees, which have one blob at a path.
    """
    if unique:
        return matches.join(occurrences, "blob_oid")
    one = occurrences.groupBy("path", "commit_sha").agg(F.min_by(F.struct(*[c for c in occurrences.columns if c not in ("path", "commit_sha")]),
        "blob_oid").alias("o"))
    one = one.select("path", "commit_sha", "o.*")
    return matches.join(one, "blob_oid")


def ranked(files: DataFrame) -> DataFrame:
    """(path, commit_sha, commit_ts) of matches -> with file_rank, commit_rank: files by newest commit, then path; commits newest first.

    Ranks of files come from a range-partitioned sort, those of commits from a window within a file.
    """
    commits = files.select("path", "commit_sha", "commit_ts").distinct()
    newest = commits.groupBy("path").agg(F.max("commit_ts").alias("newest"))
    order = numbered(newest, "file_rank", F.desc("newest"), F.asc("path"))
    in_file = commits.withColumn("commit_rank", F.expr("row_number() OVER (PARTITION BY path ORDER BY commit_ts DESC, commit_sha DESC)"))
    return in_file.join(order, "path").select("path", "commit_sha", "commit_ts", "newest", "file_rank", "commit_rank")


def in_order(rows: DataFrame, *last: str) -> DataFrame:
    """Rows with path, commit_ts, commit_sha in the order of the report: a range-partitioned sort, of any size."""
    newest = rows.groupBy("path").agg(F.max("commit_ts").alias("__newest"))
    return rows.join(newest, "path").orderBy(F.desc("__newest"), "path", F.desc("commit_ts"), F.desc("commit_sha"), *last).drop("__newest")


def first_met(rows: DataFrame) -> DataFrame:
    """(blob_oid, __met): where a walk, newest commit first, meets each blob first."""
    seq = ("walk_seq",) if "walk_seq" in rows.columns else ((-F.unix_micros("commit_ts")).alias("newest"), "commit_sha")
    return rows.groupBy("blob_oid").agg(F.min(F.struct(*seq, "path")).alias("__met"))


def as_met(rows: DataFrame, *last: str) -> DataFrame:
    """Rows in the order in which the walk meets their blobs; each occurrence of a blob together."""
    within = [F.asc("walk_seq")] if "walk_seq" in rows.columns else [F.desc("commit_ts"), F.asc("commit_sha")]
    return rows.join(first_met(rows), "blob_oid").orderBy("__met", "blob_oid", *within, "path", *last).drop("__met")


def totals(rows: DataFrame) -> DataFrame:
    """(total_matches, total_files): a binary hit counts one."""
    per = rows.groupBy("path").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), F.count("*").alias("total_files"))
