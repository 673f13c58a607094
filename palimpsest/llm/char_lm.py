"""Interpolated modified Kneser-Ney over code points, in sharded tables that documents are joined with block by block.

The model has grams of one to ORDER code points of any script; its tables grow with the text and are never gathered.
A gram lies in the shard of its context, the gram without its last symbol. So a shard has all that follows a context,
and can tell both what Kneser-Ney keeps for a seen gram (alpha) and the share that its context leaves to shorter ones
(gamma): P(gram) = alpha + gamma * P(gram without its first symbol).

Documents do not move. The distinct grams of a block are asked of the shards; what comes back (counts, and four numbers
for each context, so nothing is rounded on the way) is written to the shared folder, a folder for each block, and read by
the task that scores the block, one order at a time. A block is a run of rows within a split of the input, of RUN
characters and at most one text more, so what a task holds does not follow the size of splits. Sets of grams travel as
one compressed row for each block (or task) and shard, about a byte a gram. The grams of one symbol, whose context is
empty, are sharded by their symbol; the two numbers of their one context are known to all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, file_system, map_batches, small_batches

ORDER = 6
CHUNK = 1 << 20  # characters of a text that are taken at once
GROUP = 1 << 18  # characters of several texts that are taken at once
RUN = 16 << 20  # characters of a block before the next one begins
HELD = 5 << 18  # distinct grams that a task gathers before it passes them on
TRAINING = 4  # of these, training holds one in so many: what it passes on is merged by shard at once
PENDING = 1 << 18  # grams that wait to be merged with the distinct ones a task has, or half as many as those
SHARD_CHARS = 8 << 20  # characters of all documents for each shard
START = 0  # the symbol before a text; code points are one up
SYMBOLS = 0x110001  # as many can there be
BITS = 10  # of a symbol's code in a gatherer, so that ORDER of them are one key
TEXT_BITS = 10  # of a text's number behind a key when it is scored
OTHERWISE = "the input was split otherwise than when its grams were counted"
UNSEEN, OTHER = 0xFFFF, 0xFFFE  # symbols without a code: not seen yet, and seen when all were given

_slots = None


def symbols(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4") + np.uint32(1)


def padded(texts: list[str]) -> Iterator[tuple]:
    """(texts' places, starts, sizes, symbols): ORDER - 1 start symbols before each text, about GROUP characters at once.

    A text of more than CHUNK characters comes in pieces, each behind the last symbols of the piece before it.
    """
    import numpy as np

    pad = np.zeros(ORDER - 1, dtype=np.uint32)

    def packed(held):
        sizes = np.array([len(s) for _, s, _ in held])
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]])
        return [at for at, _, _ in held], starts, sizes, np.concatenate([x for _, s, before in held for x in (before, s)])

    held, n = [], 0
    for at, text in enumerate(texts):
        before = pad
        for begin in range(0, len(text), CHUNK):
            s = symbols(text[begin:begin + CHUNK])
            held.append((at, s, before))
            before = s[-(ORDER - 1):] if len(s) >= ORDER - 1 else pad
            n += len(s)
            if n >= GROUP:
                yield packed(held)
                held, n = [], 0
    if held:
        yield packed(held)


def hashed(columns):
    """A 64-bit key of each gram, from its symbols in order."""
    import numpy as np

    h = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def windows(s):
    """The ORDER columns of the windows of a symbol array."""
    n = len(s) - ORDER + 1
    return [s[i:i + n] for i in range(ORDER)]


def inside(starts, sizes, n: int):
    """Whether each of n windows ends in a text, not in the start symbols of the text behind."""
    import numpy as np

    own = np.ones(n, dtype=bool)
    for k in range(ORDER - 1):
        ends = starts + sizes + k
        own[ends[ends < n]] = False
    return own


def distinct(keys):
    """(places of one of each key, for each key which of them): in a table of slots; what does not fit there is sorted."""
    import numpy as np

    global _slots
    if _slots is None:
        _slots = np.zeros(1 << 22, dtype=np.int32)
    at = (keys & np.uint64(len(_slots) - 1)).astype(np.int32)
    _slots[at] = np.arange(len(keys), dtype=np.int32)
    owner = _slots[at]
    del at
    lost = np.flatnonzero(keys[owner] != keys)
    if len(lost):
        _, first, back = np.unique(keys[lost], return_index=True, return_inverse=True)
        owner[lost] = lost[first][back]
    is_owner = owner == np.arange(len(keys), dtype=np.int32)
    number = np.cumsum(is_owner, dtype=np.int32) - np.int32(1)
    return np.flatnonzero(is_owner), number[owner]


def pack(columns) -> bytes:
    """Symbols of sorted grams as byte planes, compressed."""
    import numpy as np
    import pyarrow as pa

    planes = b"".join(np.ascontiguousarray(c, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(blob: bytes, order: int, n: int):
    import numpy as np
    import pyarrow as pa

    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 4 * n * order), dtype=np.uint8).reshape(order, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").reshape(n) for p in planes]


def pack_values(values) -> bytes:
    import numpy as np
    import pyarrow as pa

    v = np.ascontiguousarray(values)
    return pa.Codec("zstd").compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes(), asbytes=True)


def unpack_values(blob: bytes, kind: str, n: int):
    import numpy as np
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.Codec("zstd").decompress(blob, n * size), dtype=np.uint8).reshape(size, n).T).view(kind).reshape(n)


def in_order(columns):
    """The places of grams in the order of their symbols: one sort of whole keys where the symbols are few."""
    import numpy as np

    seen = np.zeros(1 + max(int(c.max()) for c in columns), dtype=bool)
    for c in columns:
        seen[c] = True
    bits = max(1, (int(np.count_nonzero(seen)) - 1).bit_length())
    if bits * len(columns) > 64:
        return np.lexsort(columns[::-1])
    rank = (np.cumsum(seen) - 1).astype(np.uint64)
    keys = rank[columns[0]]
    for c in columns[1:]:
        keys <<= np.uint64(bits)
        keys |= rank[c]
    return np.argsort(keys)


def by_shard(columns, shards: int, *values) -> Iterator[tuple]:
    """(shard, columns, values) with the grams of each shard in order."""
    import numpy as np

    if not len(columns[0]):
        return
    order = in_order(columns)
    columns, values = [c[order] for c in columns], [v[order] for v in values]
    if shards == 1:
        yield 0, columns, values
        return
    context = hashed(columns[:-1] or columns)
    shard = ((context >> np.uint64(20)) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    columns, values, shard = [c[order] for c in columns], [v[order] for v in values], shard[order]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(shard[a]), [c[a:b] for c in columns], [v[a:b] for v in values]


def merged(columns, counts):
    """One of each gram, with its counts summed."""
    import numpy as np

    first, number = distinct(hashed(columns))
    return [c[first] for c in columns], np.bincount(number, weights=counts, minlength=len(first)).astype(np.int64)


class Gatherer:
    """The distinct grams of texts with their counts, passed on whenever so many of them, HELD if not told, are together.

    The first symbols that come, as many as BITS allow, have codes, and a gram of such symbols is one exact key. Keys are
    merged by sorting; grams with other symbols are held as columns and merged by hash.
    """

    def __init__(self, most: int | None = None):
        import numpy as np

        self.most = HELD if most is None else most
        self.n = self.own = 0  # grams held, keys that wait included; of these, distinct ones
        self.codes, self.symbols = np.full(SYMBOLS, UNSEEN, dtype=np.uint16), np.zeros(1, dtype=np.uint32)
        self.codes[START] = 0
        self.wait: list = []  # of keys, as they come
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # distinct, in order
        self.parts: list = []  # (columns, keys, counts) of other grams

    def coded(self, s):
        """The code of each symbol of an array, OTHER for those that came when codes had run out."""
        import numpy as np

        codes = self.codes[s]
        if (unseen := codes == UNSEEN).any():
            new = np.unique(s[unseen])
            free = new[:(1 << BITS) - len(self.symbols)]
            self.codes[new] = OTHER
            self.codes[free] = np.arange(len(self.symbols), len(self.symbols) + len(free), dtype=np.uint16)
            self.symbols = np.concatenate([self.symbols, free])
            codes = self.codes[s]
        return codes

    def add(self, texts: list[str]) -> Iterator[tuple]:
        import numpy as np

        for _, starts, sizes, s in padded(texts):
            codes = self.coded(s)
            own = inside(starts, sizes, len(s) - ORDER + 1)
            if len(self.symbols) == 1 << BITS and (other := codes == OTHER).any():
                seen = np.concatenate([[0], np.cumsum(other)])
                wide = own & (seen[ORDER:] > seen[:-ORDER])
                columns = [c[wide] for c in windows(s)]
                keys = hashed(columns)
                first, number = distinct(keys)
                self.parts.append(([c[first] for c in columns], keys[first], np.bincount(number)))
                self.n += len(first)
                own &= ~wide
            codes = codes.astype(np.uint64)
            keys = codes[:-ORDER + 1].copy()
            for c in windows(codes)[1:]:
                keys <<= np.uint64(BITS)
                keys |= c
            self.wait.append(keys[own])
            self.n += len(self.wait[-1])
            if self.n - self.own > max(min(PENDING, self.most // 2), self.own // 2):
                self.shrink()
                if self.n > self.most:
                    yield from self.rest()

    def shrink(self) -> None:
        import numpy as np

        if self.wait:
            new = np.concatenate(self.wait)
            self.wait = []
            new.sort()
            starts = np.flatnonzero(np.concatenate([new[:1] == new[:1], new[1:] != new[:-1]]))
            counts = np.diff(np.append(starts, len(new)))
            new = new[starts]
            at = np.searchsorted(self.keys, new)
            known = np.zeros(len(new), dtype=bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == new[inside]
            self.counts[at[known]] += counts[known]
            new, counts, at = new[~known], counts[~known], at[~known]
            if len(new):
                at += np.arange(len(new))
                kept = np.ones(len(self.keys) + len(new), dtype=bool)
                kept[at] = False
                for name, values in (("keys", new), ("counts", counts)):
                    both = np.empty(len(kept), dtype=values.dtype)
                    both[at], both[kept] = values, getattr(self, name)
                    setattr(self, name, both)
        if self.parts:
            keys = np.concatenate([k for _, k, _ in self.parts])
            first, number = distinct(keys)
            counts = np.bincount(number, weights=np.concatenate([c for _, _, c in self.parts]), minlength=len(first)).astype(np.int64)
            del number
            columns = []
            for _ in range(ORDER):  # one at a time, and what it is made of goes
                columns.append(np.concatenate([p[0].pop(0) for p in self.parts])[first])
            self.parts = [(columns, keys[first], counts)]
        self.n = self.own = len(self.keys) + sum(len(k) for _, k, _ in self.parts)

    def rest(self) -> Iterator[tuple]:
        import numpy as np

        self.shrink()
        keys, counts, parts = self.keys, self.counts, self.parts
        self.keys, self.counts, self.parts, self.n, self.own = keys[:0].copy(), counts[:0].copy(), [], 0, 0
        if len(keys):
            mask = np.uint64((1 << BITS) - 1)
            yield [self.symbols[((keys >> np.uint64(BITS * k)) & mask).astype(np.int32)] for k in range(ORDER - 1, -1, -1)], counts
        for columns, _, counts in parts:
            yield columns, counts


PACKED = "shard long, size long, grams binary, counts binary"


def _rows(rows: list[tuple], names: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _shard_rows(columns, counts, shards: int) -> Iterator:
    for shard, cs, (n,) in by_shard(columns, shards, counts):
        yield _rows([(shard, len(n), pack(cs), pack_values(n))], PACKED)


def _merged_shards(rows: DataFrame, order: int, what: str, make) -> DataFrame:
    """Runs make(shard, columns, counts) on the merged grams of each shard; rows arrive by shard and are merged as they come."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held: list = []
        shard = None

        def shrink() -> None:
            columns = [np.concatenate(c) for c in zip(*(p for p, _ in held))]
            held[:] = [merged(columns, np.concatenate([c for _, c in held]))]

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard"] != shard:
                    shrink()
                    yield from make(shard, *held[0])
                    held.clear()
                shard = row["shard"]
                held.append((unpack(row["grams"], order, row["size"]), unpack_values(row["counts"], "<i8", row["size"])))
                if len(held) > 1 and sum(len(c) for _, c in held[1:]) > HELD:
                    shrink()
        if held:
            shrink()
            yield from make(shard, *held[0])

    return map_batches(rows.repartition("shard").sortWithinPartitions("shard"), run, what)


COUNTED = PACKED + ", n1 long, n2 long, n3 long, n4 long, total long"


def _counted(rows: DataFrame, order: int) -> DataFrame:
    """One row a shard: its distinct grams with their counts, and how many have each of the counts one to four."""
    def make(shard, columns, counts):
        for s, cs, (n,) in by_shard(columns, 1, counts):
            yield _rows([(shard, len(n), pack(cs), pack_values(n), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int(n.sum()))], COUNTED)

    with small_batches(rows.sparkSession):
        return cut(_merged_shards(rows, order, COUNTED, make))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three discounts of modified Kneser-Ney, from how many grams have the counts one to four."""
    n1, n2, n3, n4 = (max(1, n or 0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


class Tables:
    """The counts of each order, sharded, and what is known of them as a whole: some ten numbers an order."""

    def __init__(self, counts: dict[int, DataFrame], found: dict[int, list[float]], first: tuple[int, ...], shards: int):
        """first: of the empty context, how many symbols follow it in all, and how many of them once, twice and more often."""
        self.counts, self.discounts, self.first, self.shards = counts, found, first, shards

    @property
    def vocabulary(self) -> int:
        return sum(self.first[1:])

    @property
    def uniform(self) -> float:
        """The probability that no count speaks for; one more symbol than seen stands for all others."""
        return 1.0 / (self.vocabulary + 1)

    def model(self, folder: str, run: int = RUN) -> Model:
        return Model(folder, self.uniform, self.discounts, self.first, run)


def train(trusted: DataFrame, shards: int) -> Tables | None:
    """The model of the column `text` of all rows; None if there is no character in them.

    Counts of the longest grams are of occurrences, those of shorter ones of the distinct symbols that stand before
    them. Each order is one shuffle of packed grams that its tasks have merged already.
    """
    def gather(batches: Iterator) -> Iterator:
        held = Gatherer(HELD // TRAINING)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for found in held.add(batch.column("text").slice(at, 500).to_pylist()):
                    yield from _shard_rows(*found, shards)
        for found in held.rest():
            yield from _shard_rows(*found, shards)

    def shorter(order: int):
        def run(batches: Iterator) -> Iterator:
            import numpy as np

            for batch in batches:
                for row in batch.to_pylist():
                    suffix = unpack(row["grams"], order, row["size"])[1:]
                    yield from _shard_rows(*merged(suffix, np.ones(row["size"], dtype=np.int64)), shards)
        return run

    counts, found = {}, {}
    rows = map_batches(trusted.select("text"), gather, PACKED)
    for order in range(ORDER, 0, -1):
        counts[order] = _counted(rows, order)
        *seen, size, total = counts[order].agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)], F.sum("size"), F.sum("total")).first()
        if not size:
            return None
        found[order] = discounts(*seen)
        if order > 1:
            rows = map_batches(counts[order].select("grams", "size"), shorter(order), PACKED)
    return Tables(counts, found, (total, seen[0], seen[1], size - seen[0] - seen[1]), shards)


def contexts(columns):
    """Where, among sorted grams, those of another context begin."""
    import numpy as np

    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def follow(columns, counts):
    """(keys of the contexts, sorted; for each how many symbols follow in all, and how many once, twice, more often)."""
    import numpy as np

    starts = contexts(columns)
    keys = hashed([c[starts] for c in columns[:-1]])
    kinds = [np.add.reduceat(x, starts) for x in (counts, counts == 1, counts == 2, counts > 2)]
    order = np.argsort(keys)
    return keys[order], np.stack(kinds).astype(np.int64)[:, order]


ASKED = "shard long, level int, kind int, block long, size long, grams binary, counts binary"
TOLD = "block long, level int, size long, grams binary, counts binary, known long, follow binary"


class Runs:
    """Numbers the blocks of the rows of splits, which must come in order and none of which may be missing but empty texts."""

    def __init__(self, chars: int = RUN):
        self.chars, self.split, self.before = chars, None, 0

    def blocks(self, splits, sizes):
        """A block for each row, from its split and its characters."""
        import numpy as np

        out = np.zeros(len(splits), dtype=np.uint64)
        edges = np.flatnonzero(np.concatenate([[True], splits[1:] != splits[:-1], [True]])) if len(splits) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if splits[a] != self.split:
                self.split, self.before = splits[a], 0
            sums = np.cumsum(sizes[a:b])
            run = ((self.before + sums - sizes[a:b]) // self.chars).astype(np.uint64)
            out[a:b] = hashed([splits[a:b].view(np.uint64), run])
            self.before += int(sums[-1])
        return out.view(np.int64)


def ask(docs: DataFrame, shards: int, run: int = RUN) -> DataFrame:
    """(split, text) -> the distinct grams of each block, of every order, as rows for the shards that know of them."""
    chars = run

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow.compute as pc

        def told(block: int, columns) -> Iterator:
            for order in range(ORDER, 0, -1):
                for shard, cs, _ in by_shard(columns, shards):
                    yield _rows([(shard, order, 1, block, len(cs[0]), pack(cs), None)], ASKED)
                if order > 1:
                    columns = columns[1:]
                    first, _ = distinct(hashed(columns))
                    columns = [c[first] for c in columns]

        held: dict[int, Gatherer] = {}
        runs = Runs(chars)
        for batch in batches:
            blocks = runs.blocks(batch.column("split").to_numpy(), pc.utf8_length(batch.column("text")).to_numpy())
            for block in dict.fromkeys(blocks.tolist()):
                if block not in held and held:  # a task reads one split after another
                    gone = next(iter(held))
                    for columns, _ in held.pop(gone).rest():
                        yield from told(gone, columns)
                places = np.flatnonzero(blocks == block)
                for at in range(0, len(places), 500):
                    texts = batch.column("text").take(places[at:at + 500]).to_pylist()
                    for columns, _ in held.setdefault(block, Gatherer()).add(texts):
                        yield from told(block, columns)
        for block, rest in held.items():
            for columns, _ in rest.rest():
                yield from told(block, columns)

    return map_batches(docs.select("split", "text"), run, ASKED)


def answer(asked: DataFrame, tables: Tables) -> DataFrame:
    """Each request with its grams' counts and what follows each of their contexts (zeros where nothing is known).

    A shard's counts of an order come before the requests for them, one at a time.
    """
    none = F.lit(None)
    known = None
    for order, rows in tables.counts.items():
        own = rows.select("shard", F.lit(order).alias("level"), F.lit(0).alias("kind"), none.cast("long").alias("block"), "size", "grams", "counts")
        known = own if known is None else known.unionByName(own)

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        at = None
        for batch in batches:
            for row in batch.to_pylist():
                order = row["level"]
                columns = unpack(row["grams"], order, row["size"])
                if row["kind"] == 0:
                    at = row["shard"], order
                    counts = unpack_values(row["counts"], "<i8", row["size"])
                    keys = hashed(columns)
                    if order > 1:
                        own, followed = follow(columns, counts)
                    sort = np.argsort(keys)
                    keys, counts = keys[sort], counts[sort]
                    continue
                wanted = hashed(columns)
                starts = contexts(columns) if order > 1 else np.zeros(0, dtype=np.int64)
                c, f = np.zeros(len(wanted), dtype="<i8"), np.zeros((4, len(starts)), dtype="<i8")
                if at == (row["shard"], order):
                    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    c = np.where(keys[place] == wanted, counts[place], 0)
                    if order > 1:
                        context = hashed([x[starts] for x in columns[:-1]])
                        place = np.minimum(np.searchsorted(own, context), len(own) - 1)
                        f = np.where(own[place] == context, followed[:, place], 0)
                yield _rows([(row["block"], order, row["size"], row["grams"], pack_values(c), len(starts), pack_values(f.reshape(-1)))], TOLD)

    met = asked.unionByName(known).repartition("shard", "level").sortWithinPartitions("shard", "level", "kind")
    return map_batches(met, run, TOLD)


def write_answers(docs: DataFrame, tables: Tables, folder: str, run: int = RUN) -> None:
    """The grams of each block with what the tables know of them, in a folder for each block, as Parquet, shortest grams first."""
    with small_batches(docs.sparkSession):
        answer(ask(docs, tables.shards, run), tables).repartition("block").sortWithinPartitions("block", "level").write.option(
            "parquet.block.size", 1 << 20).partitionBy("block").parquet(folder)


class Model(NamedTuple):
    """What a task needs besides a block's answers: some twenty numbers."""

    folder: str
    uniform: float
    discounts: dict[int, list[float]]
    first: tuple[int, ...]
    run: int


class Block:
    """The log-probability of each of a block's longest grams, found by key; answers are read one order at a time.

    A key is exact and in the grams' order where the block's symbols are few (`bits` of each one's code), else a hash.
    """

    def __init__(self, model: Model, block: int):
        import numpy as np

        fs, base = file_system(f"{model.folder.rstrip('/')}/block={block}")
        files = [f.path for f in fs.get_file_info(_selector(base)) if f.path.endswith(".parquet")]
        keys, p = None, None
        for order in range(1, ORDER + 1):
            d = np.array([0.0, *model.discounts[order]])
            rows = self._rows(fs, files, order)
            if order == 1:
                rows = list(rows)
                self._code([unpack(row["grams"], 1, row["size"])[0] for row in rows])
            own, found = zip(*(self._answer(row, order, d, model, keys, p) for row in rows))
            own, found = np.concatenate(own), np.concatenate(found)
            sort = np.argsort(own)
            keys, p = own[sort], found[sort]
        # A block may have asked for a gram twice; both answers are the same.
        self.keys, self.log = keys, np.log(p).astype(np.float32)
        if not self.bits:
            bits = max(10, int(len(keys) * 4).bit_length())
            self.mask = np.uint64((1 << bits) - 1)
            self.slots = np.zeros(1 << bits, dtype=np.int32)
            self.slots[(keys & self.mask).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    @staticmethod
    def _rows(fs, files: list[str], order: int) -> Iterator[dict]:
        import pyarrow.parquet as pq

        for path in files:
            with fs.open_input_file(path) as source:
                parquet = pq.ParquetFile(source)
                for g in _groups_of(parquet, order):
                    for batch in parquet.iter_batches(16, [g]):
                        yield from (row for row in batch.to_pylist() if row["level"] == order)

    def _code(self, symbols: list) -> None:
        """Codes for the block's symbols, if ORDER of them and the number of a text fit into a key."""
        import numpy as np

        alphabet = np.unique(np.concatenate([np.full(1, START, dtype=np.uint32), *symbols]))
        bits = max(1, (len(alphabet) - 1).bit_length())
        self.bits = bits if bits * ORDER + TEXT_BITS <= 64 else 0
        if self.bits:
            self.codes = np.full(int(alphabet[-1]) + 2, UNSEEN, dtype=np.uint16)  # the last is any symbol beyond
            self.codes[alphabet] = np.arange(len(alphabet), dtype=np.uint16)

    def key(self, columns):
        """The key of each gram."""
        import numpy as np

        if not self.bits:
            return hashed(columns)
        keys = self.codes[columns[0]].astype(np.uint64)
        for c in columns[1:]:
            keys <<= np.uint64(self.bits)
            keys |= self.codes[c]
        return keys

    def window_keys(self, s):
        """The key of each window of a symbol array."""
        import numpy as np

        if not self.bits:
            return hashed(windows(s))
        codes = self.codes[np.minimum(s, np.uint32(len(self.codes) - 1))]
        if (codes == UNSEEN).any():
            raise RuntimeError(OTHERWISE)
        columns = windows(codes.astype(np.uint64))
        keys = columns[0].copy()
        for c in columns[1:]:
            keys <<= np.uint64(self.bits)
            keys |= c
        return keys

    def _answer(self, row: dict, order: int, d, model: Model, keys, p):
        """(keys, probabilities) of the grams of one row, from those of the order below."""
        import numpy as np

        n = row["size"]
        columns, counts = unpack(row["grams"], order, n), unpack_values(row["counts"], "<i8", n)
        if order == 1:
            lower, total, spare = model.uniform, model.first[0], float(np.dot(d[1:], model.first[1:]))
        else:
            lower = p[np.searchsorted(keys, self.key(columns[1:]))]
            starts = contexts(columns)
            sizes = np.diff(np.append(starts, n))
            follow = unpack_values(row["follow"], "<i8", 4 * row["known"]).reshape(4, -1)
            total, spare = np.repeat(follow[0], sizes), np.repeat(d[1:] @ follow[1:], sizes)
        # Of an unknown context, all is left to the shorter gram.
        known = (counts - d[np.minimum(counts, 3)] + spare * lower) / np.maximum(total, 1)
        return self.key(columns), np.where(np.asarray(total) > 0, known, lower)

    def log_probabilities(self, wanted):
        import numpy as np

        if self.bits:
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            if (self.keys[at] != wanted).any():
                raise RuntimeError(OTHERWISE)
            return self.log[at]
        at = self.slots[(wanted & self.mask).astype(np.int64)]
        lost = np.flatnonzero(self.keys[at] != wanted)
        if len(lost):
            at[lost] = np.minimum(np.searchsorted(self.keys, wanted[lost]), len(self.keys) - 1)
            if (self.keys[at[lost]] != wanted[lost]).any():
                raise RuntimeError(OTHERWISE)
        return self.log[at]


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder)


def _groups_of(parquet, order: int) -> Iterator[int]:
    """The row groups that may have answers of an order."""
    place = parquet.schema_arrow.get_field_index("level")
    for g in range(parquet.num_row_groups):
        seen = parquet.metadata.row_group(g).column(place).statistics
        if seen is None or not seen.has_min_max or seen.min <= order <= seen.max:
            yield g


def measure(texts: list[str], block: Block | None):
    """(log-probability, characters, redundancy) of each text, as arrays.

    Redundancy is the sum of c log c over the counts c of the text's own longest grams, by characters: how much less
    than its length the text says. A text of more than CHUNK characters sums it over its pieces.
    """
    import numpy as np

    total, size, spare = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    for places, starts, sizes, s in padded(texts):
        np.add.at(size, places, sizes)
        own = inside(starts, sizes, len(s) - ORDER + 1)
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        exact = block is not None and block.bits and len(sizes) <= 1 << TEXT_BITS
        if exact:  # the text's number stands behind the key, so that one sort serves both sums
            bits = np.uint64(TEXT_BITS)
            mixed = block.window_keys(s)[own]
            mixed <<= bits
        else:
            keys = hashed(windows(s))
            if block is not None:
                known = block.window_keys(s) if block.bits else keys
                sums = np.concatenate([[0.0], np.cumsum(block_log(block, known, own))])
                np.add.at(total, places, sums[starts + sizes] - sums[starts])
            # A piece has fewer than 2^21 texts; its number takes the place of the key's low bits.
            bits = np.uint64(21)
            mixed = keys[own] >> bits << bits
        mixed |= owner
        mixed.sort()
        edges = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1], [True]]))
        c, mixed = np.diff(edges), mixed[edges[:-1]]
        which = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        if exact:
            mixed >>= bits
            new = np.concatenate([[True], mixed[1:] != mixed[:-1]])
            log = block.log_probabilities(mixed[new])[np.cumsum(new) - 1]
            np.add.at(total, places, np.bincount(which, weights=c * log.astype(np.float64), minlength=len(sizes)))
        more = c > 1
        c = c[more]
        np.add.at(spare, places, np.bincount(which[more], weights=c * np.log(c), minlength=len(sizes)))
    return total, size, spare / np.maximum(size, 1)


def block_log(block: Block, keys, own):
    """The log-probability at each window; windows that end in start symbols count nothing."""
    import numpy as np

    out = np.zeros(len(keys))
    out[own] = block.log_probabilities(keys[own])
    return out


def shard_count(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return 1 + math.ceil(chars / SHARD_CHARS)
