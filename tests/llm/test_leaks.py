from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.llm import decontaminate
from tests.llm.conftest import words


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def found(df):
    return Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect())


def test_against_brute_force(spark, make):
    passage, other = words(1, 40), words(2, 30)
    changed = passage.split()
    changed[20] = "changed"
    far = list(changed)
    far[8] = far[30] = "changed"
    docs = [(1, words(3, 5000) + " " + passage.upper() + "\n" + words(4, 5000)), (2, passage), (3, " ".join(changed)), (4, " ".join(far)),
        (5, passage[:60]), (6, None), (7, ""), (8, "two words"), (9, passage + " " + other), (9, passage + " " + other),
            (10, passage.replace(" ", "\n\t ")), (None, passage), (11, "all of Two words here"), (12, "two other words")]
    tests = [(1, passage), (2, other), (3, None), (4, "  "), (5, "Two  words"), (6, passage), (6, passage)]
    for block in (1_000_000, 10):
        got = decontaminate.find_leaks(make(*docs), items(spark, *tests), block=block)
        assert found(got) == decontaminate.brute_force(docs, tests)
    for block in (1_000_000, 10):
        ids = {r.doc_id for r in decontaminate.decontaminate(make(*docs), items(spark, *tests), block=block).collect()}
        assert ids == {4, 5, 6, 7, 12}
    assert decontaminate.decontaminate(make(*docs), items(spark, *tests)).columns == make("x").columns
    assert decontaminate.find_leaks(make(*docs).limit(0), items(spark, *tests)).count() == 0
    assert decontaminate.find_leaks(make(*docs), items(spark, *tests).limit(0)).count() == 0
    assert decontaminate.decontaminate(make(*docs), items(spark, *tests).limit(0)).count() == len(docs)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.sampled_from("a b c d e f g".split()), max_size=40), st.lists(st.sampled_from("a b c d e f g".split()), max_size=14), st.integers(0, 30))
def test_no_candidate_is_lost(doc, item, at):
    text = " ".join([*doc[:at], *item, *doc[at:]])
    one = [(1, " ".join(item))]
    sketches = decontaminate.Sketches(one, 0.8)
    got = [(1, *m) for m in sketches.matches(text, decontaminate.WordHashes())]
    assert got == sorted(decontaminate.brute_force([(1, text)], one))


def test_real_tables(spark, sf):
    from palimpsest.llm.common import table

    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    tests = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert found(decontaminate.query(spark, sf)) == decontaminate.brute_force(docs, tests)
