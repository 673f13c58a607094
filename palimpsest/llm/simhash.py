"""SimHash near-dedup: 64-bit fingerprints, multi-index hashing for links, connected components of links.

Fingerprints within 3 bits have a 32-bit half within 1. The table holds each distinct fingerprint under both halves;
probes enumerate the ball of radius 1 around each half, fetch what the table has there, and whole distances are
verified. A bucket with more than HOT fingerprints is not joined but indexed again by the halves of its other 32 bits,
then of the 16 that remain; a bucket there has 56 fixed bits and so at most 256 fingerprints. So a probe meets at most
HOT fingerprints at any level, however many copies a group has, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, map_batches, renamed, text_of

SHINGLE = 3
RADIUS = 3
HOT = 256
SEED = 42
CHUNK = 1 << 16
PART_ROWS = 1 << 16  # edges of a partition, from one round of the components to the next


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; a bit is 1 if it is set in over half of the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()  # on bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*[words[i:] for i in range(shingle)])), len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        size = min(CHUNK, n - at)
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s, _ in zip(shingles, range(size))), dtype="<u8", count=size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, body, fp) for every row; body is a hash of the text, which tells rows of one id apart.

    Null text is empty, and an empty one has fingerprint zero. Texts are taken whole, in steps of CHUNK shingles. Repeated
    rows are rows by themselves. Only the two columns named are looked at, so others may have any names. Of no rows, no
    rows come.
    """
    slim = renamed(docs, id=id_col, text=text_col).select("id", F.xxhash64(text_of(F.col("text"))).alias("body"), text_of(F.col("text")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), prints], names=["id", "body", "fp"])

    return map_batches(slim, run, f"id {dict(slim.dtypes)['id']}, body long, fp long")


def _halves(df: DataFrame, width: int, probe: bool, directed: bool) -> DataFrame:
    """Rows under each half of `rest`: (path, fp, rest), rest now being the other half. probe: with all values one bit away.

    directed: only bits that are 0 are turned, as the other of a pair with 1 there is found from this side.
    """
    half = width // 2
    ones = (1 << half) - 1
    low = F.col("rest").bitwiseAND(F.lit(ones))
    high = F.shiftrightunsigned("rest", half).bitwiseAND(F.lit(ones))

    def values(v: Column) -> Column:
        if not probe:
            return F.array(v)
        flips = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        if directed:
            flips = F.filter(flips, lambda b: v.bitwiseAND(b) == 0)
        return F.concat(F.array(v), F.transform(flips, lambda b: v.bitwiseXOR(b)))

    both = F.array(F.struct(F.lit(0).alias("side"), low.alias("v"), high.alias("other")), F.struct(F.lit(1).alias("side"), high.alias("v"), low.alias("other")))
    sides = df.select("path", "fp", F.inline(both)).select("path", "side", "fp", F.explode(values(F.col("v"))).alias("at"), F.col("other").alias("rest"))
    return sides.select(F.concat("path", F.array(F.col("side").cast("long"), F.col("at"))).alias("path"), "fp", "rest")


def _level(table: DataFrame, probes: DataFrame, width: int, radius: int, hot: int, directed: bool) -> DataFrame:
    stored = _halves(table, width, False, False)
    asked = _halves(probes, width, True, directed)
    full = None
    if width > 16:
        full = cut(stored.groupBy("path").count().where(F.col("count") > hot).select("path"))
        full = None if full.isEmpty() else full
    cold = stored if full is None else stored.join(full, "path", "left_anti")
    found = asked.select("path", F.col("fp").alias("a")).join(cold.select("path", F.col("fp").alias("b")), "path").where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if full is None:
        return found
    deeper = _level(stored.join(full, "path", "left_semi"), asked.join(full, "path", "left_semi"), width // 2, radius, hot, False)
    return found.unionByName(deeper)


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(fp) without repeats -> (a, b), a < b, each pair of fingerprints within radius (at most 3) once."""
    if not 0 <= radius <= 3:
        raise ValueError("halves cover a radius of 3 at most")
    rows = distinct.select(F.array().cast("array<long>").alias("path"), "fp", F.col("fp").alias("rest"))
    return _level(rows, rows, 64, radius, hot, True).distinct()


def following(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in partitions that follow them: PART_ROWS rows each, but a partition for each core at least.

    A shuffle writes files for each of the partitions it reads, however few rows they have.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): for each node with an edge, the smallest node that it reaches.

    Large star, then small star, until nothing changes; each round is written to the shared folder, and only a count
    and a checksum come to the driver. Joins are by sorting: a broadcast for each round would pass small tables through
    the driver again and again. No round has more edges than the one before, so its partitions follow their number.
    """
    def both(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.inline(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(c.alias("u"), d.alias("v"))))

    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges, before = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        edges = following(edges, state[0])
        if state == before or not state[0]:
            return edges.select(both(u, v, v, v)).distinct().select(u.alias("node"), v.alias("root"))
        before = state
        least = edges.select(both(u, v, v, u)).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(v.alias("u"), u.alias("v")).join(least.hint("merge"), "u").select(v.alias("u"), m.alias("v"))
        large = following(large, state[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(both(v, m, u, m)).where("u <> v")
        edges = cut(following(following(small, state[0]).distinct(), state[0]))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, body, fp, root, component) for every row; component is the smallest id of the group, root names the group.

    Null ids are members like any other but are not the smallest; a group of null ids alone has a null component.
    Copies share a fingerprint and meet as one node; repeated rows stay rows. For null, empty and very long texts and
    clashing names see fingerprints(). Of no rows, no rows come.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only groups of several fingerprints need their smallest id gathered.
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component"), "fp").select("id", "body", "fp", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with its columns, one row of each group: the one with the smallest id, nulls last.

    For null, empty and very long texts see groups(). Of rows that agree in id and text one remains. Of no rows, no
    rows come.
    """
    found = groups(docs, id_col, text_col, shingle, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("k")).select(
        F.col("k.id").alias("__simhash_id"), F.col("k.body").alias("__simhash_body"))
    body = F.xxhash64(text_of(F.col(f"`{text_col}`")))
    kept = docs.withColumn("__simhash_own", body).join(
        first, F.col(f"`{id_col}`").eqNullSafe(F.col("__simhash_id")) & (F.col("__simhash_own") == F.col("__simhash_body")))
    return kept.dropDuplicates(["__simhash_id", "__simhash_body"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
