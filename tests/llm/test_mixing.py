from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing
from tests.llm.conftest import words


def targets(sizes):
    """The rule, step by step, in exact numbers."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_plan(make):
    rows = [(i, words(i, 20 + i * 7 % 90), "en", ("b", "a", "ä", "Z", None, "b", "b", "b")[i % 8]) for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, words(5, 3000), "en", "empty"), (1003, " ", "en", "none"), (7, words(7, 69), "en", "b")]
    df = make(*rows)
    got = mixing.plan_mix(df).select("doc_id", "source", "__mix.*").collect()
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want, taken, largest = targets(size), {}, {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - float(want[r.source])) < 1e-6 and r.taken <= 2 * r.size and r.taken == r.size * len(r.shards)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.plan_mix(df.repartition(3)).select("doc_id", "__mix.*").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.plan_mix(df).select("doc_id", "__mix.*").collect())
    shards = [x for r in got for x in r.shards]
    assert set(shards) <= set(range(mixing.SHARDS)) and max(map(shards.count, set(shards))) - min(map(shards.count, set(shards))) <= 8
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "mix_copy", "mix_shard", "mix_order"] and mixed.count() == sum(len(r.shards) for r in got)
    assert mixing.plan_mix(df.limit(0)).count() == 0


def test_all_empty(make):
    assert [r.taken for r in mixing.plan_mix(make((1, None), (2, ""))).select("__mix.taken").collect()] == [0, 0]


@pytest.mark.parametrize("total,good,drawn", [(10, 4, 5), (50, 3, 20), (7, 7, 3), (6, 0, 2), (1, 1, 1), (0, 0, 0), (300, 120, 77)])
def test_hypergeometric(spark, total, good, drawn):
    """Quantiles of evenly spread u have the exact distribution."""
    n = 2000
    longs = [F.lit(x).cast("long") for x in (total, good, drawn)]
    got = spark.range(n).select(mixing.hypergeometric(*longs, (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
    p = {x: comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn) for x in range(max(0, drawn - total + good), min(good, drawn) + 1)}
    counts = {r.x: r["count"] for r in got}
    assert set(counts) <= set(p)
    for x, q in p.items():
        assert abs(counts.get(x, 0) / n - q) <= 1 / n + 1e-9


@pytest.mark.parametrize("shards", [1, 3, 5, 8, 10])
def test_tree(spark, shards):
    quotas = spark.createDataFrame([(0, 100), (1, 0), (2, 7), (3, 61)], "rank long, quota long")
    rows = mixing.split_tree(quotas, shards, 1).collect()
    total = {}
    for r in rows:
        total[r.rank] = total.get(r.rank, 0) + r.n
    assert total == {0: 100, 1: 0, 2: 7, 3: 61} and {r.shard for r in rows} == set(range(shards)) and all(r.n >= 0 for r in rows)
    assert all(abs(sum(r.n for r in rows if r.shard == s) - 168 / shards) < 3 for s in range(shards))


@pytest.mark.parametrize("shards", [3, 5, 8])
def test_a_split_is_multivariate_hypergeometric(spark, shards):
    """The left part's joint distribution over three sources, given its size."""
    n, quotas = 6000, (3, 1, 2)
    longs = F.array(*[F.lit(q).cast("long") for q in quotas])
    got = spark.range(n).select(mixing._left(F.col("id"), F.lit(shards).cast("long"), longs, 9).alias("q")).groupBy("q").count().collect()
    by_size = {}
    for r in got:
        by_size.setdefault(sum(r.q), {})[tuple(r.q)] = r["count"]
    least = 6 * (shards // 2) / shards
    assert set(by_size) <= {int(least), int(least) + 1}
    for size, counts in by_size.items():
        m = sum(counts.values())
        for q, c in counts.items():
            p = comb(3, q[0]) * comb(1, q[1]) * comb(2, q[2]) / comb(6, size)
            assert abs(c / m - p) < 5 * (p * (1 - p) / m) ** 0.5 + 1e-9


def test_any_number_of_shards(make):
    df = make(*[(i, words(i, 30), "en", "ab"[i % 2]) for i in range(60)])
    for shards in (1, 3, 10):
        rows = mixing.plan_mix(df, shards=shards).select("__mix.*").collect()
        assert {x for r in rows for x in r.shards} == set(range(shards)) and all(r.taken == r.size * len(r.shards) for r in rows)


def test_shuffled(make, spark, tmp_path):
    """Each shard, read file by file in order, is in the order of the hashes, and is not the order of the ids."""
    mixed = mixing.mix(make(*[(i, words(i, 30), "en", "ab"[i % 2]) for i in range(200)]), shards=3)
    mixing.shuffled(mixed).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).select("mix_shard", "mix_order", "doc_id", F.input_file_name().alias("f"),
        F.shiftright("mix_order", 60).alias("piece")).collect()
    assert len(rows) == mixed.count()
    for shard in range(3):
        pieces = {}
        for r in (r for r in rows if r.mix_shard == shard):
            pieces.setdefault(r.piece, []).append(r)
        whole = [r for p in sorted(pieces) for r in pieces[p]]
        assert all(len({r.f for r in p}) == 1 for p in pieces.values())
        assert [r.mix_order for r in whole] == sorted(r.mix_order for r in whole) and [r.doc_id for r in whole] != sorted(r.doc_id for r in whole)
