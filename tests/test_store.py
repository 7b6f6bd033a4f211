"""Published runs: whole or absent, once, whatever jobs do."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.checkpoints import ensure_checkpoint_dir
from tallyframe.operators import drift, incremental, profile
from tallyframe.sources import store

ROW = "source_name string, n long"


def rows(spark, *r):
    return spark.createDataFrame(r, ROW)


def seen(spark, path):
    return sorted(tuple(r) for r in store.read(spark, path, ROW).collect())


def test_a_run_is_there_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert seen(spark, path) == [] and store.sweep(spark, path) == 0
    store.publish(rows(spark, ("1", 1), ("b/c", 2)), path, "r1")
    store.publish(rows(spark, ("1", 3)), path, "2")
    store.publish(rows(spark, ("1", 4), ("1", 5)), path, "r1")
    assert seen(spark, path) == [("1", 3, "2"), ("1", 4, "r1"), ("1", 5, "r1")]
    rows(spark, ("1", 9)).write.partitionBy("source_name").parquet(f"{path}/data/attempt=killed")  # a job killed before its manifest line
    assert seen(spark, path) == [("1", 3, "2"), ("1", 4, "r1"), ("1", 5, "r1")]
    assert store.sweep(spark, path) == 1 and len(seen(spark, path)) == 3

    def fail(batches):
        raise RuntimeError("killed")
        yield

    with pytest.raises(Exception, match="killed"):
        store.publish(rows(spark, ("1", 6)).mapInPandas(fail, ROW), path, "r1")
    assert seen(spark, path) == [("1", 3, "2"), ("1", 4, "r1"), ("1", 5, "r1")]
    store.publish(rows(spark).limit(0), path, "r1")
    assert seen(spark, path) == [("1", 3, "2")]


def test_kinds_of_history(spark, tmp_path):
    path = str(tmp_path / "h")
    calls = spark.createDataFrame([("s", "A", "mapping", "lookup", "1", "x")], "source_name string, source_column string, agent string, tool_name string, call_order string, other string")
    for _ in range(2):
        store.record(calls, path, "tool_calls", "run-1")
    assert [(r.call_order, r.inputs_json, r.run_id) for r in store.history(spark, path, "tool_calls").collect()] == [(1, None, "run-1")]
    assert store.history(spark, path, "loss_runs").count() == 0
    with pytest.raises(ValueError, match="tool_name"):
        store.record(calls.drop("tool_name"), path, "tool_calls", "run-2")


def test_deliveries_of_versions(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    path = str(tmp_path / "v")
    cols = lambda *names, source="s": spark.createDataFrame([(source, n, "integer", False, False, None) for n in names], "source_name string, column_name string, inferred_type string, is_id boolean, is_coded boolean, date_format string")
    told = lambda: sorted((r.source_name, r.version, [c.column_name for c in r.columns]) for r in store.read(spark, path, drift.VERSION).collect())
    assert drift.record_delivery(cols("a", "b"), path, "1").count() == 0
    assert drift.record_delivery(cols("a", "b"), path, "2").count() == 0
    assert told() == [("s", 1, ["a", "b"])]
    drift.record_delivery(cols("a", "b", "c").unionByName(cols("x", source="t")), path, "3")
    for _ in range(2):
        assert {r.kind for r in drift.record_delivery(cols("a"), path, "4").collect()} == {"removed"}
    assert told() == [("s", 1, ["a", "b"]), ("s", 2, ["a", "b", "c"]), ("t", 1, ["x"])]
    for _ in range(2):
        drift.record_delivery(cols("a"), path, "4", spark.createDataFrame([("s",)], "source_name string"))
    assert told() == [("s", 1, ["a", "b"]), ("s", 2, ["a", "b", "c"]), ("s", 3, ["a"]), ("t", 1, ["x"])]


def test_profile_by_deliveries(spark):
    ensure_checkpoint_dir(spark)
    data = [(i, "" if i % 7 == 0 else str(i), "YN"[i % 2], "20240102" if i % 3 else "2024-01-02", str(i % 15) + "x", str(i % 21), None) for i in range(3000)]
    df = spark.createDataFrame(data, "p long, MANY string, FLAG string, DAY_DT string, CODE string, EDGE string, GONE string")
    cells = profile.melt(df, F.col("p"), "t")
    parts = [incremental.column_states(cells.where(f), "s") for f in ("pos < 10", "pos between 10 and 2000", "pos > 2000")]
    got = {r.column_name: r for r in incremental.merged_profile(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    want = {r.column_name: r for r in profile.profile(cells).collect()}
    assert set(got) == set(want)
    for name, w in want.items():
        g = got[name]
        assert all(g[c] == w[c] for c in ("row_count", "null_rate", "inferred_type", "date_format", "is_id", "is_coded", "is_cents")), name
        assert g.distinct_exact == (w.exact_distinct <= 20) and abs(g.distinct_estimate - w.exact_distinct) <= 0.06 * w.exact_distinct
    tops = {(r.column_name, r.rank): (r.value, r.n) for r in profile.top_values(profile.value_counts(cells)).collect()}
    assert {(n, i + 1): tuple(t) for n, g in got.items() for i, t in enumerate(g.top or [])} == tops
