from palimpsest.sources import tables


def test_files_of_orders_are_dealt_once(spark, tmp_path, monkeypatch):
    """Quantities and keys are shuffled, no names, and partitions follow the rows."""
    monkeypatch.setattr(tables, "PARTITION_ROWS", 50)
    rows = [(o, p, float(o * p % 5)) for o in range(60) for p in (o % 7, 40 + o % 7, 10, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = tables.order_files(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert files.rdd.getNumPartitions() == 5
    held = {}
    for r in files.collect():
        held.setdefault(r.root, set()).add((r.mode, r.path.removeprefix("part/"), r.oid))
    assert len(held) == 60 and all(len(h) == len({(o % 7), 10, 3}) for o, h in ((int(k), h) for k, h in held.items()))
    entries = tables.order_entries(spark, str(tmp_path)).collect()
    tops = {e.tree_oid: e.oid for e in entries if e.mode == 0o040000}
    below = {}
    for e in entries:
        if e.mode != 0o040000:
            below.setdefault(e.tree_oid, []).append((e.mode, e.name, e.oid))
    assert {root: sorted(below[sub]) for root, sub in tops.items()} == {root: sorted(h) for root, h in held.items()}
