"""The sharded model against Kneser-Ney written out over dictionaries."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import char_lm, quality_lm
from palimpsest.llm.common import blocked, shared_dir, small_batches

WORDS = ["the", "and", "или", "привет", "你好", "ok", "a", "été", "\U0001F600", "x\0y"]


def text(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice("abc") for _ in range(n))


class Dictionary:
    def __init__(self, texts, order):
        start = (0,) * (order - 1)
        counts = {order: Counter()}
        for t in texts:
            s = (*start, *(ord(c) + 1 for c in t))
            counts[order].update(s[i:i + order] for i in range(len(s) - order + 1))
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        self.counts, self.order = counts, order
        self.totals, self.spare = {}, {}
        for n, found in counts.items():
            have = Counter(found.values())
            n1, n2, n3, n4 = (max(1, have[k]) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = (0, min(max(1 - 2 * y * n2 / n1, 0.05), 0.95), min(max(2 - 3 * y * n3 / n2, 0.05), 1.95), min(max(3 - 4 * y * n4 / n3, 0.05), 2.95))
            self.totals[n], self.spare[n] = Counter(), Counter()
            for g, c in found.items():
                self.totals[n][g[:-1]] += c
                self.spare[n][g[:-1]] += d[min(c, 3)]
            setattr(self, f"d{n}", d)

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / (len(self.counts[1]) + 1)
        lower = self.p(gram[1:])
        total = self.totals[n][gram[:-1]]
        if not total:
            return lower
        c = self.counts[n][gram]
        return ((c - getattr(self, f"d{n}")[min(c, 3)]) if c else 0) / total + self.spare[n][gram[:-1]] / total * lower

    def loss(self, t):
        s = (*(0,) * (self.order - 1), *(ord(c) + 1 for c in t))
        return -sum(math.log(self.p(s[i:i + self.order])) for i in range(len(s) - self.order + 1))


def scores(spark, train, docs, shards):
    trusted = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    tables = char_lm.train(trusted, shards)
    here = blocked(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, text string").repartition(2)).withColumnRenamed("__block", "split")
    folder = f"{shared_dir(spark)}/test-{random.random()}"
    char_lm.write_answers(here, tables, folder)
    rows = here.select("id", quality_lm.scorer(tables.model(folder))("text", "split", F.length("text").cast("long")).alias("s")).select("id", "s.*").collect()
    return {r.id: r for r in rows}, tables


@pytest.mark.parametrize("shards", [1, 7])
def test_equals_the_dictionary_model(spark, shards):
    train = [text(i, 40) for i in range(12)] + ["", "b"]
    docs = [text(99, 30), text(3, 40), "zzz", "q", "the thea " * 20, "", train[0], train[0]]
    want, (got, tables) = Dictionary(train, char_lm.ORDER), scores(spark, train, docs, shards)
    assert tables.vocabulary == len(want.counts[1])
    for i, t in enumerate(docs):
        assert got[i].n == len(t) and abs(got[i].loss - want.loss(t)) < 1e-6 * max(1, len(t))
        seen = Counter()
        s = (0,) * (char_lm.ORDER - 1) + tuple(ord(c) + 1 for c in t)
        seen.update(s[k:k + char_lm.ORDER] for k in range(len(t)))
        assert abs(got[i].redundancy - sum(c * math.log(c) for c in seen.values()) / max(1, len(t))) < 1e-9


def test_probabilities_sum_to_one():
    m = Dictionary([text(i, 40) for i in range(5)], 3)
    for context in ((0, 0), (ord("a") + 1, ord("n") + 1), (5, 5)):
        assert abs(sum(m.p((*context, w[0])) for w in m.counts[1]) + m.p((*context, -1)) - 1) < 1e-9


def test_long_texts_come_in_pieces(monkeypatch):
    whole = char_lm.measure([text(1, 300)], None)
    grams = lambda: sum((Counter(dict(zip(zip(*c), n.tolist()))) for c, n in _gathered([text(1, 300), "x", text(2, 9)])), Counter())
    before = grams()
    monkeypatch.setattr(char_lm, "CHUNK", 97)
    monkeypatch.setattr(char_lm, "HELD", 150)
    assert grams() == before
    pieces = char_lm.measure([text(1, 300)], None)
    assert whole[1].tolist() == pieces[1].tolist() and pieces[2][0] <= whole[2][0]


def _gathered(texts):
    held = char_lm.Gatherer()
    yield from held.add(texts)
    yield from held.rest()


def test_no_text_no_model(spark):
    assert char_lm.train(spark.createDataFrame([("",)], "text string"), 3) is None


@pytest.mark.parametrize("few", [True, False])
def test_runs_within_a_split_change_nothing(spark, make, tmp_path, monkeypatch, few):
    """Filters and joins behind the counting of runs must not be moved before it."""
    monkeypatch.setattr(quality_lm, "BROADCAST_IDS", 10_000 if few else 5)
    rows = [(None if i % 11 == 3 else i, text(i, 5 + i % 30) if i % 7 else "", ("en", "fr", None)[i % 3], "s") for i in range(150)]
    make(*rows).coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    whole, parts = (sorted(str((r.doc_id, r.text, round(r["__quality"].perplexity or 0, 3), r["__quality"].kept)) for r in
        quality_lm.classify(docs, labels, **options).collect()) for options in ({}, {"run": 300}))
    assert whole == parts and len(whole) == 150


def test_what_waits_to_be_merged_is_bounded(monkeypatch):
    texts = ["the same few words again and again, and again"] * 400
    monkeypatch.setattr(char_lm, "GROUP", 40)
    monkeypatch.setattr(char_lm, "PENDING", 100)
    held, most = char_lm.Gatherer(), 0
    for t in texts:
        assert not list(held.add([t]))
        most = max(most, held.n)
    (columns, counts), = held.rest()
    assert counts.sum() == sum(map(len, texts)) and most <= 200 + len(counts)


def test_small_batches_end(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes = spark.conf.get(name), "n long"

    def count(batches):
        import pyarrow as pa

        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

    with pytest.raises(KeyError), small_batches(spark):
        assert spark.range(0, 1200, 1, 1).mapInArrow(count, sizes).agg(F.max("n")).first()[0] == 500
        raise KeyError
    assert spark.conf.get(name) == before


def test_training_holds_less_and_counts_the_same():
    texts = [f"some text {k} of its own, {k * k}" for k in range(200)]

    def counts(held):
        total = {}
        found = [x for t in texts for x in held.add([t])] + list(held.rest())
        for columns, n in found:
            for *gram, c in zip(*[k.tolist() for k in columns], n.tolist()):
                total[tuple(gram)] = total.get(tuple(gram), 0) + c
        return total, max(len(n) for _, n in found)

    (small, most), (large, all_) = counts(char_lm.Gatherer(300)), counts(char_lm.Gatherer())
    assert small == large and most < 400 < all_


def test_more_symbols_than_codes(spark):
    """Grams of symbols that have no code are counted and scored as others are."""
    rnd = random.Random(5)
    wide = lambda n: "".join(chr(0x4E00 + rnd.randrange(1500)) if rnd.random() < 0.7 else rnd.choice("ab \U0001F600") for _ in range(n))
    train = [wide(400) for _ in range(8)] + [text(1, 40)]
    docs = [wide(3000), text(2, 50), train[3], "ab ab", chr(0x10FFFF), train[0][:300]]
    assert len(set("".join(docs))) > 1 << char_lm.BITS
    seen = Counter()
    for columns, counts in _gathered(docs):
        for *gram, n in zip(*[c.tolist() for c in columns], counts.tolist()):
            seen[tuple(gram)] += n
    want = Counter()
    for t in docs:
        s = (0,) * (char_lm.ORDER - 1) + tuple(ord(c) + 1 for c in t)
        want.update(s[k:k + char_lm.ORDER] for k in range(len(t)))
    assert seen == want
    model, (got, _) = Dictionary(train, char_lm.ORDER), scores(spark, train, docs, 3)
    for i, t in enumerate(docs):
        assert got[i].n == len(t) and abs(got[i].loss - model.loss(t)) < 1e-6 * max(1, len(t))


def test_shards_are_in_order_for_any_symbols():
    rng = np.random.default_rng(3)
    for most in (3, 40, 3000, char_lm.SYMBOLS):
        for order in (1, 2, char_lm.ORDER):
            columns = [rng.integers(0, most, 2000).astype(np.uint32) for _ in range(order)]
            grams = list(zip(*[c.tolist() for c in columns]))
            found, shards = [], set()
            for shard, cs, (v,) in char_lm.by_shard(columns, 5, np.arange(2000)):
                here = list(zip(*[c.tolist() for c in cs]))
                assert here == sorted(here) == [grams[k] for k in v] and shard not in shards
                shards.add(shard)
                found += v.tolist()
            assert sorted(found) == list(range(2000))
    assert not list(char_lm.by_shard([np.zeros(0, dtype=np.uint32)] * 3, 5)) and not list(char_lm.by_shard([np.zeros(0, dtype=np.uint32)] * 3, 1))


def test_one_sort_gives_the_sums_of_two_passes(monkeypatch):
    texts = [text(i, 5 + i % 40) for i in range(300)] + ["", "a", "the the the"]
    block = char_lm.Block.__new__(char_lm.Block)
    block._code([char_lm.symbols("".join(texts))])
    assert block.bits
    block.keys = np.unique(np.concatenate([block.window_keys(s) for _, _, _, s in char_lm.padded(texts)]))
    block.log = -np.random.default_rng(1).random(len(block.keys)).astype(np.float32)
    once = char_lm.measure(texts, block)
    monkeypatch.setattr(char_lm, "TEXT_BITS", 0)
    for x, y in zip(once, char_lm.measure(texts, block)):
        assert np.allclose(x, y, rtol=1e-12, atol=1e-9)
    with pytest.raises(RuntimeError):
        char_lm.measure(["Ж"], block)


def test_gathering_costs_few_sorts():
    """Held against one sort of as many numbers, so that it holds on any machine."""
    rnd = random.Random(1)
    parts = [rnd.choice("bcdfghklmnprst") + rnd.choice("aeiouäé") for _ in range(60)]
    texts = ["".join(rnd.choice(parts) + " " * (rnd.random() < 0.3) for _ in range(1500)) for _ in range(600)]
    keys = np.random.default_rng(1).integers(0, 1 << 60, sum(map(len, texts)), dtype=np.uint64)

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    ratio = least(lambda: list(_gathered(texts))) / least(lambda: np.sort(keys))
    print("ratio", ratio)
    assert ratio < 6
