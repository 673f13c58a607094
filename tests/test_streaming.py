from datetime import datetime

import pytest

from palimpsest.options import SearchOptions
from palimpsest.streaming.search import aggregate_channel, read_blobs, stream_matches


@pytest.mark.parametrize("pattern", ["^x", "^(?:x)+"])
def test_stream(spark, tmp_path, pattern):
    schema = "blob_oid string, content string, arrived timestamp"
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("a", "x one\ny\nx two\nx three", t), ("b", "nothing", t)], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", "x one\ny\nx two\nx three", t), ("c", "x", t)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    where = spark.createDataFrame([("a", "p", "s1"), ("c", "q", "s2"), ("c", "r", "s2")], "blob_oid string, path string, commit_sha string")
    got = []
    matches = stream_matches(read_blobs(spark, str(tmp_path / "in"), max_files=1), SearchOptions((pattern,), max_count=2), where)
    query = aggregate_channel(matches, lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert sorted(got) == [("a", "p", "s1", 2), ("c", "q", "s2", 1), ("c", "r", "s2", 1)]


@pytest.mark.parametrize("folder", [False, True])
def test_stream_counts_of_a_file_or_a_folder(spark, tmp_path, folder):
    from palimpsest.plans import catalogue

    rows = spark.createDataFrame([(i, f"one of {i}\nout of many\nnone") for i in range(6)], "doc_id long, text string")
    rows.repartition(3 if folder else 1).write.parquet(f"{tmp_path}/out")
    if folder:
        (tmp_path / "out").rename(tmp_path / "documents.parquet")
    else:
        next((tmp_path / "out").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert sorted(r.n_matches for r in catalogue.queries()["stream_counts"](spark, str(tmp_path)).collect()) == [2] * 6
