import pytest
from pyspark.sql import functions as F

from tallyframe.functions.checkpoints import ensure_checkpoint_dir
from tallyframe.operators import cluster

COLS = "source_name string, column_name string, ordinal int, inferred_type string, is_id boolean, is_coded boolean, is_cents boolean, distinct_ratio double, null_rate double, vocabulary array<string>"


def catalog(spark, rows):
    return spark.createDataFrame([(s, c, i, k, False, coded, False, 0.5, 0.0, v) for i, (s, c, k, coded, v) in enumerate(rows)], COLS)


def test_names(spark):
    got = [r[0] for r in spark.createDataFrame([("EFF_DT",), ("POL_NO",), ("ANNU_PREM_AMT",), ("effective_date",)], "n string").select(cluster.expanded_name(F.col("n"))).collect()]
    assert got == ["effective date", "policy number", "annual premium amount", "effective date"]


def test_pairs(spark):
    rows = [("a", "RSK_SCR", "decimal", False, []), ("b", "risk_score", "decimal", False, []), ("a", "REGN_CD", "string", True, ["N", "S", "E"]), ("b", "sales_area", "string", True, ["N", "S", "E"]), ("a", "_cdc_ts", "date", False, []), ("b", "_cdc_ts", "date", False, [])]
    got = {(r.a_column_name, r.b_column_name): r for r in cluster.pair_scores(catalog(spark, rows)).collect()}
    assert got["RSK_SCR", "risk_score"].score == 0.85 and got["REGN_CD", "sales_area"].score >= 0.75
    assert ("_cdc_ts", "_cdc_ts") not in got
    with pytest.raises(ValueError):
        cluster.pair_scores(catalog(spark, rows), 0.0)


def test_three_sources_make_one_cluster(spark):
    ensure_checkpoint_dir(spark)
    rows = [("a", "RSK_SCR", "decimal", False, []), ("b", "risk_score", "decimal", False, []), ("c", "RISK_SCORE", "decimal", False, []), ("c", "other_thing", "date", False, [])]
    c = catalog(spark, rows)
    got = {r.member: (r.cluster, r.size) for r in cluster.clusters(c, cluster.pair_scores(c)).collect()}
    assert got["b.risk_score"] == ("a.RSK_SCR", 3) and got["c.other_thing"] == ("c.other_thing", 1)


def test_mutual_best(spark):
    rows = [("s", "a2", 1, "t", "b1", 0, 0.90), ("s", "a1", 0, "t", "b1", 0, 0.88), ("s", "a1", 0, "t", "b2", 1, 0.85)]
    p = spark.createDataFrame(rows, "a_source_name string, a_column_name string, a_ordinal int, b_source_name string, b_column_name string, b_ordinal int, score double")
    assert [(r.a_column_name, r.b_column_name) for r in cluster.mutual_best(p).collect()] == [("a2", "b1")]


def test_consensus_and_score(spark):
    v = spark.createDataFrame([("p", r, "x", "y", 0.9) for r in range(4)] + [("p", 0, "x", "y", 0.9), ("p", 0, "x", "z", 0.9), ("p", 1, "x", "z", 0.9)], "pair string, run int, a string, b string, confidence double")
    assert [(r.a, r.b, r.votes) for r in cluster.vote_consensus(v, 4).collect()] == [("x", "y", 4)]
    found = spark.createDataFrame([("a.P", "a", "1"), ("b.p", "b", "1"), ("a.E", "a", "2"), ("b.x", "b", "2"), ("b.e", "b", "3")], "member string, source_name string, cluster string")
    t = spark.createDataFrame([("a.P", "id", None), ("b.p", "id", None), ("a.E", "start", None), ("b.x", None, None), ("b.e", "start", None)], "member string, target string, secondary string")
    r = cluster.score_clusters(found, t).first()
    assert (r.tp, r.fp, r.truth, r.precision, r.recall) == (1, 1, 2, 0.5, 0.5)
