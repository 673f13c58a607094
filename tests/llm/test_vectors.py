"""Hard negatives against all scores, whitening against whole-number arithmetic."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives, whitening
from palimpsest.llm.common import table

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(rows, scale=256, rule=hard_negatives.Mining()):
    """Rows (id, vector, label) by all scores."""
    good = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v], y) for i, v, y in rows
        if None not in (i, v, y) and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a in {i: (i, x, y) for i, x, y in sorted(((i, x, y) for i, x, y in good if i % 100 == 0), key=lambda r: (r[0], r[2], r[1]), reverse=True)}.values():
        score = lambda x: sum(p * q for p, q in zip(a[1], x))  # noqa: E731, B023
        ranked = sorted(((-score(x), i, y) for i, x, y in good))
        for s, p, _ in [r for r in ranked if r[2] == a[2] and r[1] != a[0]][:rule.positives]:
            band = [r for r in ranked if r[2] != a[2] and rule.low * -s <= 100 * -r[0] <= rule.high * -s][:rule.negatives]
            out += [(a[0], p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(band)]
    return sorted(out)


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, d=16, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, d))
    return [(i, [float(v) for v in centres[rnd.integers(6)] * 0.2 + rnd.normal(size=d) * spread], int(rnd.integers(4))) for i in range(n)]


@pytest.mark.parametrize("spread,rows,anchors", [(0.2, 4096, 4096), (1.0, 64, 3), (0.02, 100, 2)])
def test_mining_equals_all_scores(spark, monkeypatch, spread, rows, anchors):
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    data = vectors(1, 900, spread=spread)
    df = spark.createDataFrame(data, SCHEMA).repartition(5).withColumn("x", F.lit("x")).withColumn("id", F.lit(0)).withColumn("away", F.lit(None))
    got = result(hard_negatives.mine(df, F.expr("id % 100 = 0")))
    assert got == mined(data) and len(got) > 50


def test_mining_odd_rows(spark):
    data = vectors(2, 120)
    data += [(200, data[0][1], 1), (200, data[1][1], 1), (201, None, 1), (300, [1.0, None], 1), (400, [NAN] * 16, 1), (500, [INF] * 16, 1), (None, data[0][1], 1),
        (600, data[0][1], None), (700, [1.0, 0.5], 2), (800, [], 3), (7, data[3][1], 0), (7, data[3][1], 0), (8, data[3][1], data[3][2])]
    df = spark.createDataFrame(data, SCHEMA)
    assert result(hard_negatives.mine(df, F.expr("id % 100 = 0"))) == mined(data)
    for odd in (df.limit(0), df.where("label = 1"), df.where("vec_id % 100 <> 0"), df.where("vec_id = 800")):
        assert result(hard_negatives.mine(odd, F.expr("id % 100 = 0"))) == []


def test_mining_large_entries(spark):
    rnd = np.random.default_rng(4)
    data = [(i, [float(np.float32(v)) for v in rnd.integers(-(1 << 19), 1 << 19, 8) * 4], i % 3) for i in range(201)]
    df = spark.createDataFrame(data, SCHEMA)
    got = result(hard_negatives.mine(df, F.expr("id % 100 = 0")))
    assert got == mined(data) and max(abs(r[4]) for r in got) > 2**53


def test_brackets_hold():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-100, 100, (500, 8)).astype(float)
    norms = (x * x).sum(axis=1)
    pivots = hard_negatives._farthest(x, norms.max())
    away = hard_negatives._distances(x, norms, pivots, norms.max()).astype("<f4").astype(float)
    assert len(pivots) == hard_negatives.PIVOTS
    for q in x[:50]:
        low, high = hard_negatives.brackets(q, away, pivots, norms.max())
        assert ((low <= x @ q) & (x @ q <= high)).all()
        assert (high - low < 2 * np.sqrt(q @ q * norms.max())).any()  # tighter than what norms alone tell


def exact(rows):
    """(n, S, V as fractions) of the distinct whole vectors."""
    fit = sorted({tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for _, v, _ in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    off = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    return n, sums, [[Fraction(sum(o[i] * o[j] for o in off), n ** 3) for j in range(d)] for i in range(d)]


def test_whitening_equals_exact_arithmetic(spark):
    rows = vectors(5, 400, d=20, spread=0.5)
    rows += rows[:150] * 2  # copies count once in the fit
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("x", F.lit("x")).withColumn("id", F.lit(0)).withColumn("n", F.lit(1))
    n, sums, v = exact(rows)
    values, directions = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    values, directions = values[::-1], directions[:, ::-1]
    trace = float(sum(v[i][i] for i in range(20)))
    got = whitening.digest(df).collect()
    assert len(got) == len(rows) * 16
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for i, vec, _ in rows:
        x = [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in vec]
        y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for k in range(1, 17):
            r = by[i][k]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            want = y @ directions[:, k - 1] / np.sqrt(values[k - 1])
            sign = signs.setdefault(k, np.sign(r.whitened * want))
            assert abs(sign * r.whitened - want) < 1e-9 and abs(r.explained - values[k - 1] / trace) < 1e-12
            assert r.identity_error < 1e-10


def test_second_moments_are_exact_to_the_last_place(spark):
    rnd = np.random.default_rng(6)
    x = (rnd.integers(-3, 4, (3000, 3)) + 10**14).tolist()
    df = spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(6)
    n, sums = len(x), [sum(r[i] for r in x) for i in range(3)]
    got = whitening.second_moments(df, 3, whitening.mean_of(sums, n))
    want = [[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n * n)) for j in range(3)] for i in range(3)]
    assert got == want


def test_error_free_steps():
    rnd = np.random.default_rng(7)
    a, b = rnd.normal(size=500) * 10.0 ** rnd.integers(-9, 9, 500), rnd.normal(size=500) * 10.0 ** rnd.integers(-9, 9, 500)
    for op, f in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        for x, y, s, e in zip(a, b, *op(a, b)):
            assert Fraction(s) + Fraction(e) == f(Fraction(x), Fraction(y))


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [NAN, 1.0], 0), (5, [INF, 1.0], 0), (None, [2.0], None), (6, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = whitening.digest(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, k) for i in (1, 1, 0, 6) for k in (1, 2)) and {r.n for r in got} == {3}
    for odd in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 6"), df.where("vec_id IN (2, 3, 4, 5)")):
        assert whitening.digest(odd).count() == 0


def test_whole_tables(spark, sf):
    rows = table(spark, sf, "embeddings")
    assert whitening.digest(rows).count() == 16 * rows.count() and whitening.digest(rows).first().identity_error < 1e-10
