import random

from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, simhash
from palimpsest.llm.common import DROP_SHUFFLES, cut, setting
from tests.llm.conftest import words

MASK = (1 << 64) - 1


def brute(prints, radius=3):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and ((prints[a] ^ prints[b]) & MASK).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    assert simhash.fingerprint("") == simhash.fingerprint(" \t\r\n") == 0
    assert simhash.fingerprint("One  TWO") & MASK == xxh64_intdigest(b"one two", 42)
    text = "a b c d e a b c"
    w = text.split()
    h = [xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(6)]
    assert simhash.fingerprint(text) & MASK == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 6)
    assert simhash.fingerprint("É b c") != simhash.fingerprint("é b c")


def test_groups(make):
    base = words(1, 2000).split()
    near = list(base)
    near[7] = "zzz"
    rows = [(9, None), (3, ""), (4, " "), (5, "hi"), (6, "HI"), (10, " ".join(base)), (11, " ".join(near)), (2, " ".join(base).upper()),
        (20, words(2, 300)), (20, words(2, 300)), (21, words(3, 200_000)), (None, "lonely text of null"), (None, " ".join(base))]
    got = simhash.groups(make(*rows)).collect()
    prints = {i: simhash.fingerprint(t or "") for i, t in rows if i is not None}
    want = brute(prints)
    assert len(got) == len(rows)
    for r in got:
        if r.id is not None:
            assert (r.fp, r.component) == (prints[r.id], want[r.id])
    assert {r.component for r in got if r.id is None} == {None, 2}
    assert simhash.groups(make(*rows).limit(0)).count() == 0
    kept = simhash.keep_one(make(*rows))
    assert sorted(kept.columns) == sorted(make("x").columns)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_links_at_every_level(spark):
    """Buckets over the bound are indexed again; all links stay, and none is added."""
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    values = {base}
    for _ in range(150):
        v = base
        for _ in range(rnd.randint(1, 5)):
            v ^= 1 << rnd.choice((rnd.randrange(64), rnd.randrange(8), 40 + rnd.randrange(6)))
        values.add(v)
    values |= {rnd.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & MASK).bit_count() <= 3}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for hot in (1000, 20, 2):
        assert {(r.a, r.b) for r in simhash.links(df, hot=hot).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 150), (150, 120), (5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 120 for i in (120, 150, 200)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")


def test_rounds_have_partitions_by_their_rows(spark, monkeypatch):
    edges, parts, cores = [(i, i + 1) for i in range(200)], [], spark.sparkContext.defaultParallelism
    monkeypatch.setattr(simhash, "cut", lambda df: parts.append((out := cut(df)).rdd.getNumPartitions()) or out)
    with setting(spark, "spark.sql.shuffle.partitions", "40"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        for rows, most in ((simhash.PART_ROWS, cores), (20, 10), (1, 40)):
            monkeypatch.setattr(simhash, "PART_ROWS", rows)
            parts.clear()
            got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
            assert got == {i: 0 for i in range(201)}
            assert len(parts) > 3 and set(parts[1:]) == {most}


def test_cut_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).select(F.pmod("id", F.lit(7)).alias("k"), "id").repartition(20)
    before, counts = shuffle_files(spark), rows.groupBy("k").count()
    first, second = cut(counts), cut(counts)  # the same frame may be cut and run again
    assert shuffle_files(spark) <= before
    assert sorted(first.collect()) == sorted(second.collect()) == sorted(counts.collect())
    assert spark.conf.get(DROP_SHUFFLES) == "false"


def test_lines_keep_columns(make):
    line = "this line is in three documents"
    df = make((1, f"a\n{line}\nb"), (2, line), (3, f"{line}\n{line}"), (4, None), (3, "another row of three"), (None, f"{line} "))
    out = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert out == {(1, "a\nb"), (2, ""), (3, f"{line}\n{line}"), (4, None), (3, "another row of three"), (None, "")}
    two = make((1, line), (1, line), (1, f"{line}\nx"), (2, line))
    assert {r.text for r in line_dedup.dedup_lines(two).collect()} == {line, f"{line}\nx"}  # two documents, however many rows


def test_real_table(spark, sf):
    """The registered query's whole rows against all pairs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: simhash.fingerprint(r.text or "") for r in docs.collect()}
    roots = brute(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()}
    assert got == {i: (f"{p & MASK:016x}", roots[i]) for i, p in prints.items()} and len({c for _, c in got.values()}) < len(got)
