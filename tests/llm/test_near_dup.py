from itertools import combinations

import numpy as np

import corpus_pipeline
from palimpsest.llm import near_dup, simhash
from tests.llm.conftest import words


def brute(texts):
    """The groups of texts by all pairs."""
    sets = {i: set(near_dup.shingles(t).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        common = len(sets[a] & sets[b])
        if near_dup.similar(len(sets[a]), len(sets[b]), common):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in texts}


def altered(text, at):
    w = text.split()
    for i in at:
        w[i] = "zzzzz"
    return " ".join(w)


def test_stage_removes_copies_beyond_three_bits(spark, make):
    texts = {}
    for i in range(60):
        base = words(1000 + i, 120)
        texts[10 * i] = base
        texts[10 * i + 1] = altered(base, (30, 90))  # 10 of 116 shingles changed: Jaccard 0.84
        texts[10 * i + 2] = altered(base, (10, 40, 70, 100))  # 20 changed: Jaccard 0.71
    far = [i for i in range(0, 600, 10) if bin((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 1])) & (2**64 - 1)).count("1") > 3]
    assert len(far) > 40
    got = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, make(*texts.items()), "").collect()}
    roots = brute(texts)
    assert got == {i for i in texts if roots[i] == i} and not got & {i + 1 for i in far}


def test_hot_buckets_chains_and_shared_passages(spark, make, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 5)
    rnd, base, passage = np.random.default_rng(3), words(7, 100), words(8, 30)
    texts = {i: altered(base, rnd.choice(100, 3, replace=False)) for i in range(40)}
    texts |= {100 + i: f"{words(200 + i, 40)} {passage} {words(300 + i, 40)}" for i in range(20)}
    texts |= {200: "", 201: " \n", 202: "one two", 203: "One  two", 204: "one"}
    roots = brute(texts)
    got = {r.doc_id for r in near_dup.keep_one(make(*texts.items())).collect()}
    assert got == {i for i in texts if roots[i] == i}


def test_fingerprints_link_first(spark):
    base, other = words(20, 3000), words(21, 3000)
    texts = {1: base, 2: altered(base, (50,)), 3: base.upper(), 4: other, 5: words(22, 3000)}
    prints = {i: simhash.fingerprint(t, near_dup.SHINGLE) for i, t in texts.items()}
    near = {(i, j) for i in texts for j in texts if i != j and bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 3}
    got = {(r.node, r.mate) for r in near_dup.neighbours(spark.createDataFrame(list(prints.items()), "node long, fp long")).collect()}
    assert got and got <= near and {i for p in got for i in p} == {i for p in near for i in p} == {1, 2, 3}


def test_links_do_not_grow_with_pairs(spark, monkeypatch):
    rnd, base = np.random.default_rng(5), words(30, 150)
    texts = {i: altered(base, rnd.choice(150, i % 9, replace=False)) for i in range(150)}
    texts |= {200 + i: f"{words(400 + i, 60)} {words(31, 30)}" for i in range(40)}
    roots = brute(texts)
    rows = [(i, t) for i, t in texts.items()] + [(0, texts[0])] * 20
    for block in (near_dup.BLOCK, 5000):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        found = near_dup.edges(spark.createDataFrame(rows, "node long, text string"))
        pairs = [(r.a, r.b) for r in found.collect()]
        assert len(pairs) < (len(texts) if block > 5000 else 10 * len(texts))
        linked = {r.node: r.root for r in simhash.components(found).collect()}
        assert {i: linked.get(i, i) for i in texts} == roots


def test_real_table(spark, sf):
    """Every pair of a whole table: what the stage keeps is what all pairs leave."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    roots = brute(texts)
    kept = [r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs, sf).collect()]
    assert sorted(kept) == sorted(i for i in texts if roots[i] == i) and len(kept) < len(texts)
