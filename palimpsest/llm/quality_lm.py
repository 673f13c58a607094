"""Quality classifier: an n-gram model of trusted text, perplexity per document, and quantiles per language as limits.

The model (see char_lm) is an interpolated modified Kneser-Ney model of code points whose count tables are sharded and
joined with the grams of documents, block by block. A document is kept if

* its perplexity is within its language's quantile of trusted documents that the model has not seen, and
* its charge, the loss a character plus the redundancy of the text, is within that of such documents of its length and
  language. Text that repeats itself has low perplexity but high redundancy.

Limits of a language move smoothly from those of all languages to its own with the number of held-out documents, and
those of a length from twice the worst charge seen in the same way, so there is one rule at every size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import char_lm
from palimpsest.llm.common import blocked, cut, renamed, shared_dir, ship, small_batches, table, text_of

HELD_OUT = 5  # one trusted document of so many sets limits instead of training
QUANTILE = 0.99  # of the held-out documents' perplexity
MARGIN = 1.4  # times the quantile
WEIGHT = 20  # held-out documents' worth of all languages' limit in a language's
CHARGE_QUANTILE, STRETCH = 0.95, 3.0  # a limit of the charge is the median and so many times the way to the quantile
ACCURACY = 10_000  # of approximate quantiles: their rank is off by one part in so many at most
PRIOR = 100  # characters' worth of all held-out texts' loss that a text is scored with
BROADCAST_IDS = 2_000_000  # trusted ids of 8 bytes that are broadcast; more are joined by a shuffle
SLICE = 500  # rows of a batch whose texts are held as strings at once


def trusted_ids(labels: DataFrame, label_id: str = "doc_id", quality: str = "quality") -> tuple[DataFrame, bool]:
    """(label_id) of what labels call good, each once, and whether they are few; where labels disagree, a document is not trusted."""
    good = renamed(labels, label_id=label_id, quality=quality).groupBy("label_id").agg(F.min("quality").alias("q"))
    good = good.where("q = 1").select("label_id")
    return good, good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def trusted_documents(docs: DataFrame, good: DataFrame, few: bool) -> DataFrame:
    """The rows of docs (id, ...) whose ids are trusted."""
    return docs.join(F.broadcast(good) if few else good, F.col("id") == F.col("label_id"), "left_semi")


def bucket(n: Column) -> Column:
    """Texts of comparable length: their number of characters to the power of two."""
    return F.floor(F.log2(n)).cast("int")


def scorer(model: char_lm.Model | None):
    """(text, split, characters) -> loss (nats), n and redundancy, as a function of columns.

    All rows of a split must come, for its blocks are counted off by their characters; a null text is not scored. A task
    holds the tables of one block.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, held = None, None
        runs = char_lm.Runs(model.run if model else char_lm.RUN)
        for texts, splits, sizes in batches:
            out = [np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))]
            blocks = runs.blocks(splits.to_numpy(), sizes.to_numpy())
            wanted = texts.is_valid().to_numpy(zero_copy_only=False)
            for block in dict.fromkeys(blocks.tolist()):  # in the order that they come in
                places = np.flatnonzero((blocks == block) & wanted)
                for begin in range(0, len(places), SLICE):
                    here = places[begin:begin + SLICE]
                    part = texts.take(pa.array(here)).to_pylist()
                    if model and any(part) and at != block:
                        held = None  # let go before the next is read
                        at, held = block, char_lm.Block(model, block)
                    for column, values in zip(out, char_lm.measure(part, held if model and any(part) else None)):
                        column[here] = values
            yield pa.StructArray.from_arrays([pa.array(-out[0]), pa.array(out[1]), pa.array(out[2])], names=["loss", "n", "redundancy"])

    score.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # Not deterministic, for it depends on the rows before: filters stay behind it.
    return arrow_udf(score, "struct<loss:double,n:long,redundancy:double>").asNondeterministic()


def _smoothed(m: Column, own: Column, other: Column) -> Column:
    return (m * own + WEIGHT * other) / (m + WEIGHT)


def limits(held: DataFrame) -> tuple[DataFrame, DataFrame, float | None, float]:
    """Of held-out scores (lang, loss, n, redundancy): limits of perplexity by language, of the charge by length and
    language (null: other languages), the loss a character of all, and the limit of the charge at other lengths.

    They are tables of languages and lengths.
    """
    mean = held.agg((F.sum("loss") / F.sum("n")).alias("m")).first()["m"]
    scored = cut(held.select("lang", bucket(F.col("n")).alias("bucket"), perplexity(mean).alias("ppl"), charge(mean).alias("charge")))
    at = F.percentile_approx("ppl", F.lit(QUANTILE), F.lit(ACCURACY)) * MARGIN
    everywhere = scored.agg(at.alias("limit")).first()["limit"]
    languages = scored.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("m"), at.alias("own"))
    languages = languages.select("lang", _smoothed(F.col("m"), F.col("own"), F.lit(everywhere)).alias("limit"))
    languages = languages.unionByName(held.sparkSession.createDataFrame([(None, everywhere)], "lang string, limit double"))
    marks = F.percentile_approx("charge", F.array(F.lit(0.5), F.lit(CHARGE_QUANTILE)), F.lit(ACCURACY))
    own = (F.col("marks")[0] + (F.col("marks")[1] - F.col("marks")[0]) * STRETCH).alias("own")
    count = lambda *keys: scored.groupBy(*keys).agg(F.count("*").alias("m"), marks.alias("marks")).select(*keys, "m", own)
    # Twice the worst charge seen: the documents of a length pull its limit down from there.
    far = 2 * (scored.agg(F.max("charge").alias("c")).first()["c"] or math.inf)
    lengths = cut(count("bucket").select("bucket", ((F.col("m") * F.col("own") + F.lit(far)) / (F.col("m") + 1)).alias("limit")))
    both = count("lang", "bucket").where("lang IS NOT NULL").join(lengths, "bucket")
    both = both.select("lang", "bucket", _smoothed(F.col("m"), F.col("own"), F.col("limit")).alias("limit"))
    none = F.lit(None).cast("string")
    return cut(languages), cut(both.unionByName(lengths.select(none.alias("lang"), "bucket", "limit"))), mean, far


def perplexity(mean: float | None, score: str = "") -> Column:
    loss, n = F.col(f"{score}loss"), F.col(f"{score}n")
    return F.when(n > 0, F.exp((loss + PRIOR * (mean or 0.0)) / (n + PRIOR)))


def charge(mean: float | None, score: str = "") -> Column:
    loss, n = F.col(f"{score}loss"), F.col(f"{score}n")
    return F.when(n > 0, (loss + PRIOR * (mean or 0.0)) / (n + PRIOR) + F.col(f"{score}redundancy"))


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(10_001).count() <= 10_000 else df


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             run: int = char_lm.RUN) -> DataFrame:
    """docs with a column __quality: n_chars, perplexity, threshold, redundancy, charge, limit, kept.

    Null and empty texts have no perplexity and are rejected. A language without held-out documents, and a null one,
    has the limits of all; lengths that no held-out document has are held to twice the worst charge seen. With no trusted
    documents at all, every row with a text is kept. Rows that share an id or a text are scored alike, each by itself;
    trusted are all rows of a trusted id. Very long texts are scored whole, in pieces. Of no rows, no rows come. A
    document that is exactly at a limit is within it. Other columns pass, whatever their names but __block and those that
    begin with __quality.
    """
    spark = ship(docs.sparkSession)
    here = blocked(docs)
    slim = here.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (lang_col, "lang"), ("__block", "split"))],
        text_of(F.col(f"`{text_col}`")).alias("text"))
    slim = slim.select("id", F.col("lang").cast("string").alias("lang"), "split", "text")
    good, few = trusted_ids(labels)
    held = F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(HELD_OUT)) == 0
    tables = char_lm.train(trusted_documents(slim, good, few).where(~held), char_lm.shard_count(slim))
    folder = f"{shared_dir(spark).rstrip('/')}/quality-{uuid.uuid4().hex}"
    if tables:
        char_lm.write_answers(slim.where("text <> ''"), tables, folder, run)
    score = scorer(tables.model(folder, run) if tables else None)
    # Rows keep their place; where the ids are too many to go out, all held-out rows are scored and asked for theirs then.
    asked = slim.join(F.broadcast(good), F.col("id") == F.col("label_id"), "left") if few else slim.withColumn("label_id", F.col("id"))
    seen = asked.select("id", "lang", score(F.when(F.col("label_id").isNotNull() & held & (F.col("text") != ""), F.col("text")), "split",
        F.length("text").cast("long")).alias("s")).where("s.n > 0").select("id", "lang", "s.*")
    seen = (seen if few else trusted_documents(seen, good, few)).drop("id")
    with small_batches(spark):
        seen = cut(seen)
    by_lang, by_length, mean, far = limits(seen) if tables else (None, None, None, math.inf)

    body = text_of(F.col(f"`{text_col}`"))
    own = here.withColumn("__quality_score", score(body, F.col("__block"), F.length(body).cast("long")))
    at = "__quality_score."
    ppl, cost = perplexity(mean, at), charge(mean, at)
    limit = longest = F.lit(math.inf)
    if mean is not None:
        lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))
        size = bucket(F.col(f"{at}n"))
        other = lambda df, *keys: _near(df.where("lang IS NULL").select(*keys, F.col("limit").alias("__quality_other")))
        named = lambda df, *keys: _near(df.where("lang IS NOT NULL").select(F.col("lang").alias("__quality_lang"), *keys,
            F.col("limit").alias("__quality_limit")))
        everywhere = by_lang.where("lang IS NULL").first()["limit"]
        own = own.join(named(by_lang), lang == F.col("__quality_lang"), "left").withColumn("__quality_t",
            F.coalesce("__quality_limit", F.lit(everywhere))).drop("__quality_lang", "__quality_limit")
        key = F.col("bucket").alias("__quality_bucket")
        own = own.join(named(by_length, key), (lang == F.col("__quality_lang")) & (size == F.col("__quality_bucket")), "left").drop("__quality_bucket",
            "__quality_lang")
        own = own.join(other(by_length, key), size == F.col("__quality_bucket"), "left")
        limit, longest = F.col("__quality_t"), F.coalesce("__quality_limit", "__quality_other", F.lit(far))
    result = F.struct(
        F.col(f"{at}n").alias("n_chars"), ppl.alias("perplexity"), limit.alias("threshold"), F.col(f"{at}redundancy").alias("redundancy"),
            cost.alias("charge"), longest.alias("limit"),
        (F.coalesce(ppl <= limit, F.lit(False)) & F.coalesce(cost <= longest, F.lit(True))).alias("kept"))
    return own.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias("__quality"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with its columns, without the rows that classify() rejects; for odd rows see there."""
    return classify(docs, labels, **options).where("__quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "lang", "__quality.*")
