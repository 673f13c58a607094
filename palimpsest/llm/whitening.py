"""Embedding whitening: a compensated covariance of integer vectors, its eigenvectors, and rows projected on them.

Entries become integers on a fixed grid (see Grid), far from zero, so plain sums of products would lose most digits. The
covariance is of the distinct vectors, centred first: mean and centred values are double-doubles, each product of two of
them is split into its rounded value and its error (Dekker's product), and sums keep their errors (Knuth's sum), halving
a batch again and again. Tasks hand on the high and the low part of each matrix row; rows meet by their number and are
merged with both parts. Only the finished d x d matrix comes to the driver, where LAPACK's divide-and-conquer solver
(syevd: Householder tridiagonal form, then Cuppen's method) finds the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, map_batches, renamed

COMPONENTS = 16
CELLS = 1 << 18  # matrix cells that a task works on at once
RANK = 1e-12  # eigenvalues of at most this share of the largest are no direction to whiten


class Grid(NamedTuple):
    """x = floor(scale * c) + offset of an entry c."""

    scale: int = 64
    offset: int = 1_000_000


def integers(col: Column, grid: Grid = Grid()) -> Column:
    """The vector's entries as longs; null if the vector or an entry is null or an entry is not finite."""
    entry = lambda c: c.cast("double")
    good = F.forall(col, lambda c: F.coalesce(~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(col, lambda c: (F.floor(entry(c) * grid.scale) + grid.offset).cast("long")))


def two_sum(a, b):
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _split(a):
    t = 134217729.0 * a  # 2^27 + 1
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    """a * b and its rounding error."""
    p = a * b
    ah, al = _split(a)
    bh, bl = _split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a, b):
    """The sum of two double-doubles (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(parts):
    """The sum of double-doubles along the first axis, by halves."""
    import numpy as np

    high, low = parts
    while len(high) > 1:
        half = len(high) // 2
        s = add((high[:half], low[:half]), (high[half:2 * half], low[half:2 * half]))
        odd = len(high) % 2
        high, low = (np.concatenate([x, y[-1:]]) if odd else x for x, y in zip(s, (high, low)))
    return high[0], low[0]


def mean_of(sums: list[int], n: int):
    """Whole sums over n as double-doubles."""
    from fractions import Fraction

    import numpy as np

    high = [float(Fraction(s, n)) for s in sums]
    return np.array(high), np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, high)])


def centred(x, mean):
    """x (rows of doubles) minus a double-double mean, as double-doubles."""
    high, low = two_sum(x, -mean[0])
    return two_sum(high, low - mean[1])


def outer(y):
    """The sum of outer products of double-double rows, as a double-double matrix."""
    import numpy as np

    high, low = y
    d = high.shape[1]
    step, out = max(1, CELLS // (d * d)), None
    for at in range(0, len(high), step):
        h, l = high[at:at + step], low[at:at + step]  # noqa: E741
        p, e = two_product(h[:, :, None], h[:, None, :])
        e = e + (h[:, :, None] * l[:, None, :] + l[:, :, None] * h[:, None, :])
        part = total(two_sum(p, e))
        out = part if out is None else add(out, part)
    return out if out is not None else (np.zeros((d, d)), np.zeros((d, d)))


def _rows(column, d: int, kind=float):
    """Lists of d numbers as a matrix."""
    import numpy as np

    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, d).astype(kind)


def second_moments(vectors: DataFrame, d: int, mean) -> list[list[float]]:
    """The sum of outer products of the column `x` (arrays of d numbers) minus the mean, each cell rounded once."""
    row = "i int, high array<double>, low array<double>"

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            if batch.num_rows:
                part = outer(centred(_rows(batch.column("x"), d), mean))
                held = part if held is None else add(held, part)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "high": pa.array(list(held[0])), "low": pa.array(list(held[1]))})

    def merge(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                part = np.array(r["high"]), np.array(r["low"])
                held[r["i"]] = add(held[r["i"]], part) if r["i"] in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([list(h) for h, _ in held.values()], pa.list_(pa.float64())),
            pa.array([list(v) for _, v in held.values()], pa.list_(pa.float64()))], names=["i", "high", "low"])

    parts = map_batches(vectors.select("x"), gather, row)
    found = map_batches(parts.repartition("i"), merge, row).collect()  # d rows of d cells
    return [r.high for r in sorted(found, key=lambda r: r.i)]


class Whitening(NamedTuple):
    """n distinct vectors with their sums by dimension, and the directions (columns, by falling eigenvalue) to project on."""

    n: int
    sums: list[int]
    values: list[float]
    directions: list[list[float]]
    trace: float


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of distinct vectors (column x, array<long>, all of one length); None if no direction has any variance."""
    import numpy as np

    entry = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted(entry.collect(), key=lambda r: r.i)  # a row for each dimension
    if not found:
        return None
    n, sums = found[0].n, [int(r.s) for r in found]
    v = np.array(second_moments(vectors, len(sums), mean_of(sums, n))) / n
    values, directions = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")
    kept = [k for k in order[:components].tolist() if values[k] > RANK * values[order[0]] > 0]
    if not kept:
        return None
    return Whitening(n, sums, values[kept].tolist(), directions[:, kept].T.tolist(), float(np.trace(v)))


def _project(x, model: Whitening):
    """Whitened coordinates of rows x (whole numbers)."""
    import numpy as np

    high, low = centred(x.astype(float), mean_of(model.sums, model.n))
    return (high @ np.array(model.directions).T + low @ np.array(model.directions).T) / np.sqrt(model.values)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all vectors."""
    import numpy as np

    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_project(_rows(batch.column("x"), d, np.int64), model)), pa.list_(pa.float64()))], names=["x"])

    projected = map_batches(vectors.select("x"), run, "x array<double>")
    # Of a mean that is zero but for rounding, double sums tell enough.
    sums = projected.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
    mean = np.array([r.m for r in sorted(sums, key=lambda r: r.i)]), np.zeros(k)
    return float(np.abs(np.array(second_moments(projected, k, mean)) / model.n - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, x) -> (id, component, deviation, whitened, explained): a row for each component."""
    kind, d, k = dict(rows.dtypes)["id"], len(model.sums), len(model.values)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        share = np.array(model.values) / model.trace
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                x = _rows(b.column("x"), d, np.int64)
                # Whole numbers of any size; they fit machine words almost always.
                bound = max((max(abs(model.n * int(x[:, j].min()) - s), abs(model.n * int(x[:, j].max()) - s)) for j, s in enumerate(model.sums)), default=0)
                whole = np.int64 if len(x) and d * bound * bound < 2**62 and model.n * int(np.abs(x).max()) < 2**62 else object
                off = model.n * x.astype(whole) - np.array(model.sums, dtype=whole)
                deviation = [str(v) for v in (off * off).sum(axis=1).tolist()]
                take = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(deviation, pa.string()).take(take), pa.array(_project(x, model).reshape(-1)), pa.array(np.tile(share, len(x)))],
                    names=["id", "component", "deviation", "whitened", "explained"])

    out = map_batches(rows.select("id", "x"), run, f"id {kind}, component int, deviation string, whitened double, explained double")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, grid: Grid = Grid()) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row with a vector of finite entries.

    Rows whose vector is null or has a null or non-finite entry are left out. A vector of fewer entries than the longest
    has zeros in their place. Null ids and rows that share an id pass, each by itself; equal vectors count once in the
    fit. Components without variance are left out, so equal vectors, a single row, empty vectors and no rows give no
    rows. Other columns may have any names. Vectors of d entries take d x d cells of a task and the driver.
    """
    spark = rows.sparkSession
    slim = renamed(rows, id=id_col, vector=vector_col).select("id", integers(F.col("vector"), grid).alias("x")).where("x IS NOT NULL")
    d = slim.agg(F.max(F.size("x"))).first()[0] or 0
    slim = slim.withColumn("x", F.concat("x", F.array_repeat(F.lit(grid.offset).cast("long"), F.lit(d) - F.size("x"))))
    distinct = cut(slim.select("x").distinct())
    model = fit(distinct, components) if d else None
    if model is None:
        return spark.createDataFrame([], f"id {dict(slim.dtypes)['id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(distinct, model)
    return transform(slim, model).select("id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"))


def digest(rows: DataFrame) -> DataFrame:
    return whiten(rows).select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained",
        "identity_error")
