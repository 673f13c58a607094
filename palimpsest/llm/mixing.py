"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash of their id, which permutes them. A source's quota is a number
of whole copies of all its blocks plus the first blocks of the permutation, up to its target. The tree's root holds
the vector of quotas, one entry a source; each node splits its vector by the numbers of shards on its left and right,
drawing the left one without replacement (multivariate hypergeometric), down to the output shards, so quotas stay exact
at every level. A shard then draws its count of each source's permuted blocks, disjoint from every other shard's, and is
shuffled locally by a hash. What the mix takes of a document is what the shards draw of its block. All randomness is a
hash of the seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, cut, let, text_of

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SEED = 20
SHARDS = 16
BITS = 10  # blocks a source, and again parts of the block that the target falls into, as a power of two
BROADCAST_BLOCKS = 200_000  # rows of about 100 bytes
# Columns that are added to the caller's; no others can clash with them.
SOURCE, BLOCK, PLACE, SIZE, MIX = "__mix_source", "__mix_block", "__mix_place", "__mix_size", "__mix"


def log_factorial(x: Column) -> Column:
    """Stirling's series at x + 9, brought down by the eight factors between."""
    def series(y: Column) -> Column:
        between = y - 8
        for i in range(7):
            between = between * (y - 7 + i)
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(between)

    return let(x.cast("double") + 9, series)


def unit(*key: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Quantile u of the number of good ones among drawn ones, by the sum of its probabilities.

    What lies more than 12 standard deviations and 12 from the mean has no probability that a double can show.
    """
    def spread(a: Column) -> Column:
        t, g, d = (a[c].cast("double") for c in "tgd")
        mean = F.when(t == 0, F.lit(0.0)).otherwise(d * g / t)
        return F.struct(a["t"].alias("t"), a["g"].alias("g"), a["d"].alias("d"), mean.alias("mean"),
            (12 + 12 * F.sqrt(F.greatest(F.lit(0.0), F.when(t < 2, F.lit(0.0)).otherwise(d * g / t * (1 - g / t) * (t - d) / (t - 1))))).alias("by"))

    def bounds(a: Column) -> Column:
        least = F.greatest(F.lit(0).cast("long"), a["d"] - (a["t"] - a["g"]), F.floor(a["mean"] - a["by"]).cast("long"))
        most = F.least(a["g"], a["d"], F.ceil(a["mean"] + a["by"]).cast("long"))
        return F.struct(a["t"].alias("t"), a["g"].alias("g"), a["d"].alias("d"), least.alias("least"), most.alias("most"),
            F.floor(a["mean"]).cast("long").alias("middle"))

    def pick(a: Column) -> Column:
        log_p = lambda x: -(log_factorial(x) + log_factorial(a["g"] - x) + log_factorial(a["d"] - x) + log_factorial(a["t"] - a["g"] - a["d"] + x))
        weights = let(log_p(F.least(a["most"], F.greatest(a["least"], a["middle"]))), lambda top: F.transform(
            F.sequence(a["least"], a["most"]), lambda x: F.struct(x.alias("x"), F.exp(log_p(x) - top).alias("w"))))
        return let(weights, lambda ws: F.aggregate(
            ws,
            F.struct((u * F.aggregate(ws, F.lit(0.0), lambda s, w: s + w["w"])).alias("left"), a["least"].alias("x")),
            lambda s, w: F.when(s["left"] > 0, F.struct((s["left"] - w["w"]).alias("left"), w["x"].alias("x"))).otherwise(s),
            lambda s: s["x"],
        ))

    return let(F.struct(total.alias("t"), good.alias("g"), drawn.alias("d")), lambda a: let(let(spread(a), bounds), pick))


def _left(low: Column, n: Column, quotas: Column, seed: int) -> Column:
    """The quotas that go to the left half of a node's n shards, drawn without replacement, source by source.

    The left's share of all is by the number of its shards; what does not divide is rounded by a hash of the node.
    """
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    share = F.floor((total * F.floor(n / 2) + F.pmod(F.xxhash64(F.lit(seed), low, n), n)) / n).cast("long")
    zero = F.struct(F.array().cast("array<long>").alias("out"), total.alias("n"), F.least(total, share).alias("d"))

    def draw(acc: Column, item: Column) -> Column:
        x = hypergeometric(acc["n"], item["q"], acc["d"], unit(F.lit(seed), low, n, item["i"]))
        return let(x, lambda x: F.struct(F.concat(acc["out"], F.array(x)).alias("out"), (acc["n"] - item["q"]).alias("n"), (acc["d"] - x).alias("d")))

    return F.aggregate(F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i"))), zero, draw, lambda a: a["out"])


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, quota) for each source, ranks from 0 -> (shard, rank, n): n of the source's quota go to the shard.

    A node is a run of shards with a quota vector; it is split in two runs until each is one shard, for any number of
    shards. Shards' totals differ by the rounding of a node a level at most.
    """
    node = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "quota"))), lambda s: s["quota"].cast("long")).alias("q"))
    node = node.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("n"), "q")
    low, n = F.col("low"), F.col("n")
    half = F.floor(n / 2)
    for _ in range((shards - 1).bit_length()):
        node = node.select(F.inline(F.when(n == 1, F.array(F.struct("low", "n", "q"))).otherwise(let(_left(low, n, F.col("q"), seed), lambda left: F.array(
            F.struct(low.alias("low"), half.alias("n"), left.alias("q")),
            F.struct((low + half).alias("low"), (n - half).alias("n"), F.zip_with("q", left, lambda a, b: a - b).alias("q")),
        )))))
    return node.select(F.col("low").cast("int").alias("shard"), F.posexplode("q").alias("rank", "n"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with rank, weight, target. Ranks are by code point, null last.

    All sources together get SHARE of all sizes, by weight; what a source would get over CAP times its own size goes
    to the others by weight, again until none is above. Sorted by size over weight, the capped sources come first, and
    a source is capped if its share of what those before it leave is above its cap. Comparisons are of whole numbers.
    Sources are a list that weights are given for; their table, not the documents', is what the windows order.
    """
    ranked = sizes.select("*", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST) - 1").alias("rank"))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    order = "(ORDER BY source_size / weight, rank"
    share = weighted.select(
        "*",
        F.expr("sum(source_size) OVER ()").alias("all"),
        F.expr(f"coalesce(sum(source_size) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"),
        F.expr(f"sum(weight) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)").alias("rest"),
    ).withColumn("free", F.expr(f"{2 * CAP} * source_size * rest >= weight * ({int(2 * SHARE)} * all - {2 * CAP} * before)"))
    return share.select(
        "source", "source_size", "rank", "weight",
        F.expr(f"""CASE WHEN free THEN cast(weight AS double) * ({SHARE}D * all - {CAP} * coalesce(sum(CASE WHEN NOT free THEN source_size END) OVER (), 0))
                   / sum(CASE WHEN free THEN weight END) OVER () ELSE cast({CAP} * source_size AS double) END""").alias("target"),
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, size: Column | None) -> DataFrame:
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")), 64 - 2 * BITS).cast("int")
    return docs.withColumns({
        SOURCE: F.col(f"`{source_col}`"),
        SIZE: F.regexp_count(text_of(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long") if size is None else size,
        PLACE: place,
        BLOCK: F.shiftright(place, BITS),
    })


def _cumulated(df: DataFrame, key: str) -> DataFrame:
    """With upto, the words of the source's rows up to this one by key."""
    return df.withColumn("upto", F.expr(f"sum(words) OVER (PARTITION BY source ORDER BY {key})"))


def plan(slim: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Of placed documents: per (source, block) the source's figures and its draws, (copy, shard, cut) in order.

    A source's quota is of block slots: each copy of a block that the target covers, the last one up to a place in it,
    the cut. Shards draw slots; a document is in a slot if its place is under the slot's cut. Every window here is over
    at most 2^BITS rows a source: the block that a target falls into is looked into by 2^BITS parts of it.
    """
    blocks = cut(slim.groupBy(F.col(SOURCE).alias("source"), F.col(BLOCK).alias("block")).agg(F.sum(SIZE).alias("words")))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = cut(goal.withColumn("copies", F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(CAP),
        F.floor(F.col("target") / F.col("source_size")))).cast("int"))
               .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    summed = _cumulated(blocks, "block")
    summed = summed.join(goal.drop("weight"), same(summed, goal)).drop(goal["source"])
    edge = summed.where("upto > rest AND upto - words <= rest").select("source", "block", "rest", (F.col("upto") - F.col("words")).alias("base"))
    edge = cut(edge.groupBy("source").agg(F.min_by(F.struct("block", "rest", "base"), "block").alias("e")).select("source", "e.*"))
    parts = slim.join(F.broadcast(edge) if _few(edge, BROADCAST_BLOCKS) else edge, slim[SOURCE].eqNullSafe(edge["source"]) & (slim[BLOCK] == edge["block"]))
    parts = parts.groupBy("source", F.col("block"), "rest", "base", F.col(PLACE).alias("place")).agg(F.sum(SIZE).alias("words"))
    near = "base + upto <= rest OR (base + upto - words <= rest AND base + upto - rest < rest - (base + upto - words))"
    cutoff = _cumulated(parts, "place").groupBy("source").agg(
        F.max("block").alias("edge"), F.coalesce(F.max(F.when(F.expr(near), F.col("place") + 1)), F.lit(0)).alias("cutoff"))
    # rest is 0 or the words end where the target does: nothing is cut within a block.
    full = summed.join(cutoff.withColumnRenamed("source", "edge_source"), F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    full = cut(full.withColumn("cutoff", F.greatest(F.coalesce("cutoff", F.lit(0)), F.shiftleft(F.coalesce("edge", F.lit(0)), BITS)))
               .withColumn("n", F.col("copies") + (F.shiftleft("block", BITS) < F.col("cutoff")).cast("int")))
    # The slots of a source's quota, in the order of its permutation, and the shards that draw them.
    cut_of = F.when(F.col("copy") <= F.col("copies"), F.lit(1 << 2 * BITS)).otherwise(F.col("cutoff"))
    slots = full.where("n > 0").select("source", "rank", "block", "copies", "cutoff",
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).withColumn("cut", cut_of)
    slots = slots.withColumn("slot", F.expr("row_number() OVER (PARTITION BY rank ORDER BY copy, block) - 1"))
    quotas = goal.select("rank").join(slots.groupBy("rank").agg(F.count("*").alias("quota")), "rank", "left").select("rank",
        F.coalesce("quota", F.lit(0)).alias("quota"))
    drawn = cut(split_tree(quotas, shards, seed)).withColumn("upto", F.expr("sum(n) OVER (PARTITION BY rank ORDER BY shard)"))
    dealt = drawn.where("n > 0").select("rank", "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("slot"))
    draws = slots.join(dealt, ["rank", "slot"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "cut"))).alias("draws"))
    return full.join(draws, ["rank", "block"], "left").select("source", "block", "source_size", "target", "draws")


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with its columns and a struct MIX: size, source_size, target, taken, shards.

    size counts words (null text: 0); null is a source like any other, the last. Rows that share an id share a place
    in the permutation. Sources without words have target 0. Of no rows, no rows come. Columns of any other name pass.
    The join is by source and block, so a source with a third of all rows is spread over 2^BITS keys.
    """
    slim = cut(_placed(docs, id_col, text_col, source_col, seed, None).select(SOURCE, SIZE, PLACE, BLOCK))
    table = cut(plan(slim, shards, seed)).withColumnsRenamed({c: f"__mix_{c}_" for c in ("source", "block", "source_size", "target", "draws")})
    placed = _placed(docs, id_col, text_col, source_col, seed, None)
    table = F.broadcast(table) if _few(table, BROADCAST_BLOCKS) else table
    joined = placed.join(table, F.col(SOURCE).eqNullSafe(F.col("__mix_source_")) & (F.col(BLOCK) == F.col("__mix_block_")), "left")
    drawn = F.coalesce(F.transform(F.filter("__mix_draws_", lambda d: F.col(PLACE) < d["cut"]), lambda d: d["shard"]), F.array().cast("array<int>"))
    mix = let(drawn, lambda shards: F.struct(
        F.col(SIZE).alias("size"), F.col("__mix_source_size_").alias("source_size"), F.col("__mix_target_").alias("target"),
        (F.col(SIZE) * F.size(shards)).alias("taken"), shards.alias("shards"),
    ))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], mix.alias(MIX))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: docs, a row for each copy taken, with mix_copy, mix_shard and mix_order, the place within it.

    Nulls, empty texts, repeated rows and clashing names are as in plan_mix(); a column of docs that is called
    mix_copy, mix_shard or mix_order is replaced. Rows of one id and copy tie in mix_order.
    """
    planned = plan_mix(docs, id_col, text_col, source_col, shards, seed)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_copy", "mix_shard", "mix_order")]
    copies = planned.select(*own, F.col(f"`{id_col}`").alias("__mix_id"), F.posexplode(F.col(MIX)["shards"]).alias("mix_copy", "mix_shard"))
    return copies.withColumn("mix_order", F.xxhash64(F.lit(seed), F.lit("order"), F.col("mix_shard"), F.col("__mix_id"), F.col("mix_copy"))).drop("__mix_id")


PIECES = 4  # bits of mix_order that split a shard over tasks


def shuffled(mixed: DataFrame) -> DataFrame:
    """The rows of each shard in the order of their hashes, so that written files hold shuffled shards.

    A shard is up to 2^PIECES pieces by the first bits of mix_order; read in that order they are the whole shard.
    """
    return mixed.repartition(F.col("mix_shard"), F.shiftright("mix_order", 64 - PIECES)).sortWithinPartitions("mix_shard", "mix_order")


def digest(docs: DataFrame) -> DataFrame:
    return plan_mix(docs).select("doc_id", *[F.col(MIX)[c].alias(c) for c in ("size", "source_size", "target", "taken", "shards")])
