"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is its set of five-word shingles, lower-cased in ASCII. Its sketch is the bottom-k MinHash of that set. Items
are partitioned by size, and k follows the size: n shingles of which ceil(t * n) must be found can miss n - ceil(t * n),
so of the k = n - ceil(t * n) + 1 smallest hashes a document that contains the item has one at least, however long the
document is. Documents stream past the sketches; a document that has a value of an item's sketch is a candidate, and
the share of the item's shingles that the document has is then counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.llm.common import cut, map_batches, narrowed, renamed, ship, table, text_of

SHINGLE = 5
THRESHOLD = 0.8
BLOCK = 1_000_000  # words of test items that are broadcast, about 100 MB at most; sketches of more items are joined with documents
FILTER_BITS = 27  # of the bitmap of sketch values, 16 MB
FEW = 2_000_000  # hashes of texts with leaks that are broadcast; more are joined by a shuffle
VOCABULARY = 1_000_000  # word hashes that a task remembers

SCHEMA = "doc_id {id}, item_id {item}, n_shingles long, n_shared long, containment double"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > VOCABULARY:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """All runs of SHINGLE words; fewer words are one shingle, none is none."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(SHINGLE)]))


def shingle_hashes(words: list[bytes], memory: WordHashes, size: int = SHINGLE):
    """A hash for each run of `size` words, in order, from the hashes of its words; fewer words are one run."""
    import numpy as np

    w = np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    h = np.full(max(0, len(words) - size + 1), size, dtype=np.uint64)
    for i in range(size):
        h = (h ^ w[i:len(w) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def needed(n: int, threshold: float) -> int:
    """Shingles of n that make up the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


class Sketches:
    """The sketches of a block of items: partitions by size, each with sorted sketch values and the items that have them."""

    def __init__(self, items: list[tuple], threshold: float):
        import numpy as np

        self.threshold, self.items, self.partitions = threshold, [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # items of few words: number of words -> hash -> items
        memory, by_size = WordHashes(), {}
        for item, text in items:
            words = split_words(text)
            if 0 < len(words) < SHINGLE:
                self.short.setdefault(len(words), {}).setdefault(int(shingle_hashes(words, memory)[0]), []).append(len(self.items))
                self.items.append((item, {tuple(words)}))
            elif found := shingles(words):
                hashes = np.unique(shingle_hashes(words, memory))
                sketch = hashes[: len(found) - needed(len(found), threshold) + 1]
                by_size.setdefault(len(found).bit_length(), []).append((sketch, len(self.items)))
                self.items.append((item, found))
        for _, members in sorted(by_size.items()):
            values = np.concatenate([s for s, _ in members])
            owners = np.concatenate([np.full(len(s), i, dtype=np.int64) for s, i in members])
            order = np.argsort(values, kind="stable")
            self.partitions.append((values[order], owners[order]))
        self.filter = np.zeros(1 << 20, dtype=bool)
        for values, _ in self.partitions:
            self.filter[values >> np.uint64(44)] = True

    def candidates(self, hashes) -> set[int]:
        import numpy as np

        hashes = hashes[self.filter[hashes >> np.uint64(44)]]
        found = set()
        if len(hashes):
            for values, owners in self.partitions:
                low, high = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
                for a, b in zip(low[high > low], high[high > low]):
                    found.update(owners[a:b].tolist())
        return found

    def short_matches(self, words: list[bytes], memory: WordHashes) -> set[int]:
        """The items of fewer than SHINGLE words that are a run of the document's words."""
        import numpy as np

        found = set()
        for size, items in self.short.items():
            if size <= len(words):
                hashes = shingle_hashes(words, memory, size)
                for at in np.flatnonzero(np.isin(hashes, np.fromiter(items, dtype=np.uint64, count=len(items)))).tolist():
                    run = {tuple(words[at:at + size])}
                    found.update(i for i in items[int(hashes[at])] if self.items[i][1] == run)
        return found

    def matches(self, text: str, memory: WordHashes) -> list[tuple]:
        """(item, its shingles, those shared) for each item that the text contains."""
        words = split_words(text)
        if not words:
            return []
        out = [(self.items[i][0], 1, 1) for i in sorted(self.short_matches(words, memory))]
        if len(words) < SHINGLE or not (near := self.candidates(shingle_hashes(words, memory))):
            return out
        own = shingles(words)
        for i in sorted(near):
            item, wanted = self.items[i]
            if (shared := len(wanted & own)) >= needed(len(wanted), self.threshold):
                out.append((item, len(wanted), shared))
        return out


def _within(items: DataFrame, block: int) -> list[tuple] | None:
    """The items, if they have at most `block` words; else None."""
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    return [tuple(r) for r in items.toLocalIterator()] if words <= block else None


def _sketch_rows(items: DataFrame, threshold: float) -> DataFrame:
    """(item, size, hash) of (item, text): the sketch of each, and the number of words of a shingle."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memory = WordHashes()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                words = split_words(text.as_py())
                if found := shingles(words):
                    sketch = np.unique(shingle_hashes(words, memory))[: len(found) - needed(len(found), threshold) + 1]
                    out += [(item, min(SHINGLE, len(words)), h) for h in sketch.view("<i8").tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int32(), pa.int64()))],
                names=["item", "size", "hash"])

    return map_batches(items.select("item", "text"), run, "item long, size int, hash long")


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(body, item, n, k) for any number of items, of documents (body, text) and (item, text).

    Sketches stay a table. Documents give the hashes that a bounded bitmap of all sketch values lets through, these are
    joined with the sketches, and only the texts of candidates move, to be verified exactly.
    """
    import numpy as np

    sketches = cut(_sketch_rows(items, threshold))
    sizes = [r["size"] for r in sketches.select("size").distinct().collect()]  # one to SHINGLE
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = np.zeros((1 << (FILTER_BITS - 15), 4096), dtype=np.uint8)
    pieces = sketches.groupBy(F.shiftright(place, 15).alias("piece")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    for r in pieces.toLocalIterator():  # 16 MB at most
        bits[r.piece, :len(r.bits)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((sizes, bits.reshape(-1)))

    def probe(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sizes, bits = shared.value
        memory = WordHashes()
        for batch in batches:
            bodies, hashes, of_size = [], [], []
            for body, text in zip(batch.column("body").to_pylist(), batch.column("text")):
                words = split_words(text.as_py())
                for size in sizes:
                    if len(words) >= size:
                        h = np.unique(shingle_hashes(words, memory, size))
                        at = h >> np.uint64(64 - FILTER_BITS)
                        h = h[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                        bodies.append(np.full(len(h), body, dtype=np.int64))
                        hashes.append(h.view("<i8"))
                        of_size.append(np.full(len(h), size, dtype=np.int32))
            columns = [np.concatenate(c) if c else np.zeros(0, k) for c, k in ((bodies, "<i8"), (of_size, "<i4"), (hashes, "<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["body", "size", "hash"])

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for body, item, doc, text in zip(*(batch.column(c).to_pylist() for c in ("body", "item", "doc", "text"))):
                wanted, words = shingles(split_words(text)), split_words(doc)
                size = len(next(iter(wanted)))
                shared = len(wanted & set(zip(*[words[i:] for i in range(size)])))
                if shared >= needed(len(wanted), threshold):
                    out.append((body, item, len(wanted), shared))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 4], names=["body", "item", "n", "k"])

    near = cut(map_batches(docs, probe, "body long, size int, hash long").join(sketches, ["hash", "size"]).select("body", "item").distinct())
    texts = narrowed(docs, F.col("body"), near.select("body")).dropDuplicates(["body"]).select("body", F.col("text").alias("doc"))
    return cut(map_batches(near.join(texts, "body").join(items.select("item", "text"), "item"), verify, "body long, item long, n long, k long"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): each document and test item that it contains.

    An item is contained if the document has threshold of its shingles or more. Items without words match nothing; an
    item of fewer than five words is one shingle of that many, which any run of the same words has. Null texts are
    empty; null ids pass. Rows that share an id are told apart only by their matches: repeated rows give repeated
    results. Of no documents or no items, no rows come; other columns are left out, whatever their names. Documents of
    any length are taken whole. Items of up to `block` words in all go to the executors, and documents are not
    shuffled; the sketches of more items are a table that documents' hashes are joined with, in one pass over documents.
    """
    spark = ship(docs.sparkSession)
    slim = renamed(docs, doc_id=id_col, text=text_col).select("doc_id", text_of(F.col("text")).alias("text"))
    items = renamed(benchmark, item_id=item_col, text=item_text).select("item_id", text_of(F.col("text")).alias("text"))
    schema = SCHEMA.format(id=dict(slim.dtypes)["doc_id"], item=dict(items.dtypes)["item_id"])
    part = _within(items, block)
    if part is None:
        items = cut(items.withColumn("item", F.monotonically_increasing_id()))
        keyed = slim.withColumn("body", F.xxhash64("text"))
        found = _joined(keyed.select("body", "text"), items, threshold).join(items.select("item", "item_id"), "item")
        rows = keyed.select("doc_id", "body").join(found, "body")
        return rows.select("doc_id", "item_id", F.col("n").alias("n_shingles"), F.col("k").alias("n_shared"), (F.col("k") / F.col("n")).alias("containment"))
    sketches = Sketches(part, threshold)
    sketches.item_type = to_arrow_type(items.schema["item_id"].dataType)
    sketches = spark.sparkContext.broadcast(sketches)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memory = WordHashes()
        for batch in batches:
            hits = [(at, *hit) for at, t in enumerate(batch.column("text")) for hit in sketches.value.matches(t.as_py(), memory)]
            at, items, n, k = zip(*hits) if hits else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, sketches.value.item_type), pa.array(n, pa.int64()),
                pa.array(k, pa.int64()), pa.array([y / x for x, y in zip(n, k)], pa.float64()),
            ], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return map_batches(slim, run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    block: int = BLOCK) -> DataFrame:
    """docs with its columns, without the rows that contain a test item; in one pass without a shuffle, for few items.

    For nulls, empty and very long texts, repeated rows and short items see find_leaks(). Without items, all rows stay.
    Other columns pass, whatever their names but those that begin with __leak_.
    """
    spark = ship(docs.sparkSession)
    items = renamed(benchmark, item_id="item_id", text="text").select("item_id", text_of(F.col("text")).alias("text"))
    part = _within(items, block)
    text = text_of(F.col(f"`{text_col}`"))
    if part is not None:
        return docs.where(_cleaner(spark.sparkContext.broadcast(Sketches(part, threshold)))(text))
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))
    gone = _joined(docs.select(F.xxhash64(text).alias("body"), text.alias("text")), items, threshold).select(F.col("body").alias("__leak_body")).distinct()
    few = gone.limit(FEW + 1).count() <= FEW
    kept = docs.withColumn("__leak_own", F.xxhash64(text)).join(F.broadcast(gone) if few else gone, F.col("__leak_own") == F.col("__leak_body"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _cleaner(sketches):
    """Whether a text contains none of the items, as a function of a column."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def clean(batches: Iterator) -> Iterator:
        memory = WordHashes()
        for texts in batches:
            yield texts.map(lambda t: not sketches.value.matches(t, memory))

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(clean, "boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple], items: list[tuple], threshold: float = THRESHOLD) -> Counter:
    """Every document against every item, by their sets of shingles; for tests."""
    runs = lambda words, n: {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
    split = [(i, split_words(t or "")) for i, t in items]
    out = Counter()
    for d, t in docs:
        words = split_words(t or "")
        own = {n: runs(words, n) for n in range(1, SHINGLE + 1)}
        for i, w in split:
            n = min(SHINGLE, len(w))
            if n and len(found := runs(w, n) & own[n]) >= needed(len(runs(w, n)), threshold):
                out[d, i, len(runs(w, n)), len(found)] += 1
    return out
