from collections import Counter

import corpus_pipeline
from palimpsest.llm import decontaminate, mixing, simhash
from tests.llm.conftest import words
from tests.llm.test_near_dup import brute


def changed(text, *places):
    w = text.split(" ")
    for i in places:
        w[i] = w[i][::-1] + "ab"
    return " ".join(w)


def tables(spark, make, folder):
    line = "a line that many documents of this corpus share"
    leak = words(50, 30)
    rows = [(i, f"{words(i, 150)}\n{line}" if i % 4 == 0 else words(i, 150), "en", "ab"[i % 2]) for i in range(120)]
    rows += [(200, words(1, 150), "en", "a"), (201, words(2, 150) + ".", "en", "b"), (202, f"{words(60, 80)} {leak} {words(61, 80)}", "en", "a"),
        (203, "#$%&*" * 200, "en", "a"), (204, None, None, None), (205, "", "en", "b"), (1, words(1, 150), "en", "b"),
        (210, changed(words(3, 150), 30, 90), "en", "a"), (211, changed(words(5, 150), 10, 45, 80, 120), "en", "b")]  # Jaccard 0.87 and 0.76
    docs = make(*rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(203, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, rows, line, leak


def test_run(spark, make, tmp_path):
    docs, rows, line, leak = tables(spark, make, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    # By hand: quality drops the symbols and the texts without characters.
    kept = [(i, t, s) for i, t, _, s in rows if t and "#" not in t]
    # The line is in thirty documents; the largest id keeps it.
    last = max(i for i, t, _ in kept if line in t)
    kept = [(i, t if i == last else t.replace("\n" + line, ""), s) for i, t, s in kept]
    roots = brute(dict((i, t) for i, t, _ in kept))
    far = simhash.fingerprint(words(3, 150)) ^ simhash.fingerprint(changed(words(3, 150), 30, 90))
    assert roots[210] == 3 and (far & (2**64 - 1)).bit_count() > 3 and roots[211] == 211  # three bits of three words would tell otherwise
    kept = {i: (t, s) for i, t, s in kept if roots[i] == i}
    hits = {d for d, *_ in decontaminate.brute_force([(i, t) for i, (t, _) in kept.items()], [(1, leak)])}
    assert 202 in hits
    kept = {i: v for i, v in kept.items() if i not in hits}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in out} <= {(i, t) for i, (t, _) in kept.items()}
    before = make(*[(i, t, "en", s) for i, (t, s) in kept.items()])
    want = Counter({r.doc_id: len(r.shards) for r in mixing.plan_mix(before).select("doc_id", "__mix.shards").collect() if r.shards})
    assert Counter(r.doc_id for r in out) == want and all(r.n_chars == len(r.text) for r in out)


def test_stages_on_nothing_and_columns(spark, make, tmp_path):
    docs, *_ = tables(spark, make, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        some = stage(spark, docs, str(tmp_path))
        assert some.columns[:len(docs.columns)] == docs.columns and (name == "mixing" or some.columns == docs.columns)
