from itertools import combinations

import numpy as np
import pytest

from palimpsest.llm import minhash
from palimpsest.llm.near_dup import shingles
from tests.llm.conftest import words


def brute(rows):
    """{id: (set size, smallest id reachable)} by all pairs of rows (id, text)."""
    sets = {i: set(shingles(t).tolist()) if t and t.strip(" \t\n\x0b\x0c\r") else set() for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def altered(text, at):
    w = text.split()
    for i in at:
        w[i] = "zzzzz"
    return " ".join(w)


def corpus():
    rnd, base, passage = np.random.default_rng(3), words(7, 200), words(8, 60)
    texts = [altered(base, rnd.choice(200, k % 7, replace=False)) for k in range(90)]  # a dense group, many links below 0.85
    texts += [f"{words(200 + i, 30)} {passage} {words(300 + i, 30)}" for i in range(40)]  # a shared passage links none
    for i in range(20):
        own = words(500 + i, 120)
        texts += [own, altered(own, (60,)), altered(own, (30, 90))]  # Jaccard 0.92 and 0.84
    texts += [None, "", " \n\t", "one two", "One  TWO", "one", "x " * 30_000, words(9, 9000), altered(words(9, 9000), (5,))]
    return list(enumerate(texts))


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("hot,block", [(minhash.HOT, minhash.BLOCK), (4, 3000)])
def test_equals_all_pairs(spark, make, monkeypatch, hot, block):
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    got = minhash.digest(make(*rows))
    assert found(got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_signatures_within_the_radius_always_share_a_key():
    rnd = np.random.default_rng(5)
    for errors, chunks in ((minhash.ERRORS, range(5)), (minhash.DEEP_ERRORS, range(1, 5))):
        for _ in range(200):
            a = rnd.integers(0, 256, (1, minhash.SYMBOLS), dtype=np.uint8)
            b = a.copy()
            first = 0 if 0 in chunks else minhash.CHUNKS[0]  # where one chunk agrees, the errors lie in the others
            b[0, rnd.choice(np.arange(first, minhash.INDEXED), minhash.RADIUS, replace=False)] += 1
            assert (minhash.keys(a, errors) == minhash.keys(b, errors)).any()


def test_signature_estimates_similarity():
    factors, rnd = minhash._multipliers(), np.random.default_rng(1)
    off = []
    for _ in range(60):
        h = rnd.integers(0, 1 << 63, 1000, dtype=np.uint64)
        s, t = (np.frombuffer(minhash.signature(x, factors), np.uint8) for x in (h[:900], h[100:]))
        off.append((s != t).mean())
    assert abs(np.mean(off) - 0.2 * 255 / 256) < 0.02  # Jaccard 0.8
    assert minhash.signature(h, factors) == minhash.signature(h[::-1], factors)


def test_confirmed_finds_what_pairs_find():
    rnd = np.random.default_rng(2)
    for seed in range(30):
        base = rnd.choice(10_000, 100, replace=False)
        sets = [np.unique(np.where(rnd.random(100) < rnd.random() * 0.2, rnd.integers(0, 10_000, 100), base)) for _ in range(12)]
        root = list(range(12))
        for i, j in combinations(range(12), 2):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                root = [root[i] if r == root[j] else r for r in root]
        for groups in ([None] * 12, [min(k for k in range(12) if root[k] == root[i]) if i % 3 else None for i in range(12)]):
            own = list(range(12))
            for i, g in enumerate(groups):
                if g is not None:
                    own = [own[[k for k in range(12) if groups[k] == g][0]] if o == own[i] else o for o in own]
            for a, b in minhash.confirmed(list(range(12)), groups, sets):
                own = [own[a] if o == own[b] else o for o in own]
            assert [[own[i] == own[j] for j in range(12)] for i in range(12)] == [[root[i] == root[j] for j in range(12)] for i in range(12)]


def test_odd_rows(spark, make):
    long, near = words(1, 100), altered(words(1, 100), (50,))
    rows = [(5, long), (5, long), (3, near), (None, long), (None, "only null ids"), (9, None), (9, None), (7, long.upper())]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.digest(make(*rows)).collect()), key=str)
    assert got == sorted([(5, 96, 3, False), (5, 96, 3, False), (3, 96, 3, True), (None, 96, 3, False), (None, 1, None, True), (9, 0, 9, True), (9, 0, 9, True),
        (7, 96, 3, False)], key=str)
    assert minhash.digest(make((1, "x")).limit(0)).count() == 0
