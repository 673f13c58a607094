"""Near-duplicate stage: all pairs of texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Texts of which less than 0.8 is in other texts are similar to none and drop out first. Which hashes several texts have is
found from their first 40 bits, sorted and packed, so that the others are never shuffled. The rest get SimHash
fingerprints of five-word shingles, and multi-index hashing links those within three bits; each text's link to its most
central neighbour is verified on the texts. No radius of fingerprints has all similar pairs, so what the links do not
join is searched exactly: in any fixed order of shingles, two similar sets of n and m shingles share at least l of their
first n - ceil(0.8 n) + l and m - ceil(0.8 m) + l. The order is by how many texts have a shingle, then by hash. Texts that
share such a shingle are in one family, and so is every similar pair; a family's texts meet in one task, or large
families block by block, where common shingles are counted. The exact search makes no row for a pair and returns only
links that join two groups; the fingerprints' index makes one for each pair of distinct fingerprints within three bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, map_batches, narrowed, renamed, text_of
from palimpsest.llm.simhash import components, fingerprint, links

SHINGLE = 5
HOT = 32  # texts that have a shingle before it is ordered last
LATE = 200_000  # shingles that are ordered last at most; which ones is a matter of speed only
SPARE = 20  # one more common shingle is asked for with so many shingles
BLOCK = 1 << 20  # shingles of a family that meet in one task; of a larger one, every two blocks meet
SEED = 43
SHORT = 40  # first bits of a hash by which shingles that several texts begin with are found
FILTER_BITS = 27  # of the bitmap of those, 16 MB, however many there are
SHARD_CHARS = 16 << 20  # characters of text for each shard of that search
FEW = 1_000_000  # groups of equal texts, of 16 bytes each, that are broadcast; more are joined by a shuffle


def shingles(text: str):
    """The distinct 64-bit hashes of the shingles, sorted; a text of fewer words is one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8").view("<i8")
    n = len(words) - SHINGLE + 1
    runs = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)]))
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in runs), dtype="<u8", count=n).view("<i8"))


def similar(n: int, m: int, common: int) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    return 5 * common >= 4 * (n + m - common)


def _places(short):
    """The bits of the bitmap that stand for shortened hashes."""
    import numpy as np

    return (short * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def _common(texts: DataFrame, shards: int) -> DataFrame:
    """(short, c): the shortened hashes that c texts have, c being two or more.

    Each task packs what it reads, a sorted array a shard; a shard has all hashes with the same first bits.
    """
    bits = (shards - 1).bit_length()

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def packed(parts):
            s = np.sort(np.concatenate(parts))
            shard = (s >> np.uint64(SHORT - bits)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                steps = np.diff(s[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((int(shard[a]), int(b - a), pa.Codec("zstd").compress(np.ascontiguousarray(steps.T).tobytes(), asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                names=["shard", "size", "steps"])

        parts, n = [], 0
        for batch in batches:
            for t in batch.column("text"):
                parts.append(shingles(t.as_py()).view("<u8") >> np.uint64(64 - SHORT))
                n += len(parts[-1])
                if n > 4 << 20:
                    yield packed(parts)
                    parts, n = [], 0
        if n:
            yield packed(parts)

    def merge(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def found(parts):
            short, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(short[c > 1].astype(np.int64)), pa.array(c[c > 1])], names=["short", "c"])

        shard, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if parts and row["shard"] != shard:
                    yield found(parts)
                    parts = []
                shard = row["shard"]
                planes = np.frombuffer(pa.Codec("zstd").decompress(row["steps"], 5 * row["size"]), dtype=np.uint8).reshape(5, row["size"])
                steps = np.zeros((row["size"], 8), dtype=np.uint8)
                steps[:, :5] = planes.T
                parts.append(np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64))
        if parts:
            yield found(parts)

    rows = map_batches(texts.select("text"), pack, "shard long, size long, steps binary")
    return cut(map_batches(rows.repartition("shard").sortWithinPartitions("shard"), merge, "short long, c long"))


def _bitmap(common: DataFrame):
    """The bits that stand for the hashes, as an array of bounded size."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column("short").to_numpy().astype(np.uint64)).astype(np.int64))], names=["p"])

    pieces = map_batches(common.select("short"), run, "p long").groupBy(F.shiftright("p", 15).alias("piece")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((1 << (FILTER_BITS - 15), 4096), dtype=np.uint8)
    for r in pieces.toLocalIterator():
        out[r.piece, :len(r.bits)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out.reshape(-1)


def _prefixes(texts: DataFrame, late, bits) -> DataFrame:
    """(node, n, fp, prefix) of (node, text): the number of shingles, the fingerprint, and the shingles of the prefix that
    other texts have.

    A text of which less than 0.8 is in other texts is similar to none and is left out.
    """
    held = texts.sparkSession.sparkContext.broadcast((late, bits))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            late, bits = held.value
            rows, prefixes = [], []
            for node, t in zip(batch.column("node").to_pylist(), batch.column("text")):
                t = t.as_py()
                s = shingles(t)
                short = s.view("<u8") >> np.uint64(64 - SHORT)
                at = _places(short)
                shared = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                n = len(s)
                if 5 * int(shared.sum()) < 4 * n:
                    continue
                if late is not None:
                    keys, rank = late
                    place = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    order = np.argsort(np.where(keys[place] == short, rank[place], 0), kind="stable")
                    s, shared = s[order], shared[order]
                least = 1 + n // SPARE
                size = min(n, n + (-4 * n) // 5 + least)
                p = s[:size][shared[:size]]
                if len(p) >= min(least, n):
                    rows.append((node, n, fingerprint(t, SHINGLE)))
                    prefixes.append(p)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, "<i8")))
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 3]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["node", "n", "fp", "prefix"])

    return map_batches(texts, run, "node long, n long, fp long, prefix array<long>")


def neighbours(prints: DataFrame) -> DataFrame:
    """(node, fp) -> (node, mate): of the texts whose fingerprints link, the one that most link to; each node once at most.

    Of equal fingerprints, one text stands for the others.
    """
    heads = cut(prints.groupBy("fp").agg(F.min("node").alias("head")))
    pairs = cut(links(heads.select("fp")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("degree"))
    central = both.join(degree.select(F.col("a").alias("b"), "degree"), "b").groupBy("a").agg(F.max(F.struct("degree", "b")).alias("best"))
    central = central.join(degree, "a").where(F.col("best") > F.struct("degree", F.col("a").alias("b"))).select("a", F.col("best.b").alias("b"))
    mates = central.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("node")), "a").join(
        heads.select(F.col("fp").alias("b"), F.col("head").alias("mate")), "b").select("node", "mate")
    same = prints.join(heads, "fp").where("node <> head").select("node", F.col("head").alias("mate"))
    return mates.unionByName(same)


def families(prefixes: DataFrame) -> DataFrame:
    """(node, n, prefix) -> (node, root): similar texts have one root; texts that are similar to none may have none.

    Similar texts differ in size by a factor of 1.25 at most, so their classes of size differ by one at most. A text is
    in two buckets of a shingle, its class's and the next one's; a pair meets in that of the larger class.
    """
    size = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    rows = prefixes.select("node", size.alias("class"), F.explode("prefix").alias("h"))
    rows = rows.select("node", F.explode(F.array(F.xxhash64("h", "class"), F.xxhash64("h", F.col("class") + 1))).alias("b"))
    hubs = rows.groupBy("b").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("b", "hub")
    return components(cut(rows.join(hubs, "b").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()))


def _joined(nodes, mates, sets) -> list:
    """Similar pairs of the nodes, one for each two groups that they join: those of the fingerprints' links first, then of all."""
    import numpy as np

    at, group, left, out = {x: i for i, x in enumerate(nodes)}, list(range(len(nodes))), len(nodes), []

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def join(i, j):
        nonlocal left
        x, y = top(i), top(j)
        if x != y:
            group[max(x, y)] = min(x, y)
            left -= 1
            out.append((nodes[i], nodes[j]))

    for i, mate in enumerate(mates):
        j = at.get(mate)
        if j is not None and similar(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j], assume_unique=True))):
            join(i, j)
    if left == 1:
        return out
    n = np.array([len(s) for s in sets])
    kind, c = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), n)
    kept = c[kind] > 1
    kind, owner = kind[kept], owner[kept]
    order = np.argsort(kind, kind="stable")
    holders = np.split(owner[order], np.flatnonzero(np.diff(kind[order])) + 1)
    kind = np.unique(kind, return_inverse=True)[1]
    edges = np.searchsorted(owner, np.arange(len(sets) + 1))
    for i in range(len(sets)):
        if left == 1:
            break
        own = kind[edges[i]:edges[i + 1]]
        if len(own):
            common = np.bincount(np.concatenate([holders[k] for k in own.tolist()]), minlength=len(sets))[i + 1:]
            for j in np.flatnonzero(5 * common >= 4 * (n[i] + n[i + 1:] - common)).tolist():
                join(i, i + 1 + j)
    return out


def edges(texts: DataFrame) -> DataFrame:
    """(node, text) -> (a, b), similar pairs that connect all that similar pairs connect."""
    import numpy as np

    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    common, late = _common(texts, 1 + math.ceil(chars / SHARD_CHARS)), None
    hot = sorted((r.short, r.c) for r in common.where(F.col("c") > HOT).orderBy(F.desc("c")).limit(LATE).collect())
    if hot:
        late = np.array([h for h, _ in hot], dtype=np.uint64), np.array([c for _, c in hot])
    prefixes = cut(_prefixes(texts, late, _bitmap(common)).dropDuplicates(["node"]))
    mates = cut(neighbours(prefixes.select("node", "fp")))
    members = cut(families(prefixes).join(prefixes.select("node", "n"), "node").join(mates, "node", "left"))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("blocks"))
    members = members.join(blocks, "root").withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), "node"), "blocks"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: (x != F.col("mine")) | (F.col("blocks") == 1))
    members = cut(members.select("node", "mate", "root", "mine", F.explode(other).alias("other")).select("node", "mate", F.xxhash64("root",
        F.least("mine", "other"), F.greatest("mine", "other")).alias("meeting")))
    nodes = members.select("node").distinct()
    held = narrowed(texts, F.col("node"), nodes).join(members, "node").repartition("meeting").sortWithinPartitions("meeting", "node")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found(rows):
            pairs = _joined(*zip(*rows)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*pairs)) or [()] * 2], names=["a", "b"])

        meeting, rows = None, []
        for batch in batches:
            for here, node, mate, t in zip(*[batch.column(c).to_pylist() for c in ("meeting", "node", "mate")], batch.column("text")):
                if here != meeting:
                    yield found(rows)
                    meeting, rows = here, []
                if not rows or rows[-1][0] != node:
                    rows.append((node, mate, shingles(t.as_py())))
        yield found(rows)

    return map_batches(held, run, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, one row of each group of near copies: the one with the smallest id, nulls last.

    Null text is empty; empty texts are one group. Of rows that agree in id and text one remains; rows of one id with
    different texts are told apart. Of no rows, no rows come. Texts are compared whole, however long.
    Other columns pass, whatever their names but those that begin with __near_.
    """
    slim = renamed(docs, id=id_col, text=text_col).select("id", text_of(F.col("text")).alias("text")).withColumn("node", F.xxhash64("text"))
    # Of equal texts, the one with the smallest id goes on; repeated rows of it are one node all the same.
    copies = cut(slim.groupBy("node").agg(F.count("*").alias("c"), F.min(F.struct(F.col("id").isNull().alias("none"),
        "id")).alias("least")).where("c > 1").select("node", "least"))
    few = copies.limit(FEW + 1).count() <= FEW
    texts = slim.join(F.broadcast(copies) if few else copies, "node",
        "left").where(F.col("least").isNull() | F.col("id").eqNullSafe(F.col("least.id"))).select("node", "text")
    roots = components(edges(texts if few else cut(texts)))
    first = slim.select("node", "id").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("k")).select(F.col("k.id").alias("__near_id"),
            F.col("k.node").alias("__near_node"))
    kept = docs.withColumn("__near_own", F.xxhash64(text_of(F.col(f"`{text_col}`")))).join(
        first, F.col(f"`{id_col}`").eqNullSafe(F.col("__near_id")) & (F.col("__near_own") == F.col("__near_node")))
    return kept.dropDuplicates(["__near_id", "__near_node"]).select(*[F.col(f"`{c}`") for c in docs.columns])
