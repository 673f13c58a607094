"""Line dedup: lines that recur across documents stay in one document only.

Lines are exploded under their normalised key, keys are hashed to 128 bits, distinct documents are counted per
hash, and lines over the threshold go; the rest of each document is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WHITE, ascii_lower, cut, id_key, let, renamed, text_of

MIN_CHARS = 20
MIN_DOCUMENTS = 3
# Columns that are added to the caller's; no others can clash with them.
LINES, KEPT, GONE, DOC, BODY = "__line_dedup_lines", "__line_dedup_kept", "__line_dedup_gone", "__line_dedup_doc", "__line_dedup_body"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, body, pos, h1, h2) for each line whose key is long enough.

    doc and body (a hash of the text) name a row by its content, so rows that share a doc_id keep apart.
    """
    exploded = docs.select("doc", "body", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # A key is never longer than its line, so short lines go before the costly steps.
    keyed = exploded.where(F.length("line") >= min_chars).select("doc", "body", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with two more columns: LINES, all lines of the text, and KEPT, the positions (from 0) that stay.

    A key of min_chars or more that occurs in min_documents or more distinct ids loses all its lines except those in
    the largest id that holds it. Null or empty text is one empty line. Ids are of any type that sorts; a null id
    counts as one id below all others. Of no rows, no rows come; very long texts are split like any other.
    Repeated rows with one id count as one document. Other columns, whatever their names, pass through.
    The counts are by (hash, document) and then by hash, so a line that a third of all documents share arrives
    pre-aggregated; where lines meet the drop list, the join is one that Spark splits when a key is hot.
    """
    slim = renamed(docs, doc=id_col, text=text_col).select(
        id_key(F.col("doc"), dict(docs.dtypes)[id_col]).alias("doc"), text_of(F.col("text")).alias("text")
    ).withColumn("body", F.xxhash64("text"))
    lines = _lines(slim, min_chars)
    # Written down, so that the join below shuffles both of its sides, which is what lets Spark split a hot key.
    drop = cut(
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keep"))
        .where(F.col("n") >= min_documents)
        .select(F.col("h1").alias("d1"), F.col("h2").alias("d2"), "keep")
    )
    gone = (
        lines.join(drop, (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2")) & (F.col("doc") != F.col("keep")))
        .groupBy(F.col("doc").alias(DOC), F.col("body").alias(BODY))
        .agg(F.collect_set("pos").alias(GONE))
    )
    own = id_key(F.col(f"`{id_col}`"), dict(docs.dtypes)[id_col])
    text = text_of(F.col(f"`{text_col}`"))
    joined = docs.join(gone, (own == F.col(DOC)) & (F.xxhash64(text) == F.col(BODY)), "left")
    return joined.withColumns({
        LINES: F.split(text, "\n", -1),
        KEPT: F.array_except(
            F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))),
            F.coalesce(F.col(GONE), F.array().cast("array<int>")),
        ),
    }).drop(DOC, BODY, GONE)


def kept_text() -> Column:
    """The text of the lines that mark_lines() keeps."""
    return let(F.col(LINES), lambda lines: F.array_join(F.transform(KEPT, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with its columns, the text without the dropped lines; rows that lose no line keep their text as it is."""
    marked = mark_lines(docs, id_col, text_col, min_chars, min_documents)
    text = F.when(F.size(KEPT) == F.size(LINES), F.col(f"`{text_col}`")).otherwise(kept_text())
    return marked.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return mark_lines(docs).select(
        "doc_id",
        F.size(LINES).cast("long").alias("n_lines"),
        (F.size(LINES) - F.size(KEPT)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


SQL = """
WITH l AS (
  SELECT doc_id, p AS pos, line, lower_az(line) AS k FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p
    FROM documents)
), d AS (
  SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (d.k IS NOT NULL AND d.keep <> l.doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.k IS NULL OR d.keep = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN d ON l.k = d.k GROUP BY l.doc_id
""".replace("lower_az(line)",
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
