from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.functions import transforms as t
from tallyframe.operators import drift, profile, review, rowshape, scoring
from tallyframe.sources import artifacts, delimited, tables


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_transforms(spark):
    assert str(one(spark, "20240115", t.compact_date)) == "2024-01-15" and one(spark, "00000000", t.compact_date) is None and one(spark, "20250230", t.compact_date) is None
    assert str(one(spark, "1/5/2024", t.us_date)) == "2024-01-05" and one(spark, "x", t.iso_date) is None
    assert one(spark, "y", t.yes_no) is True and one(spark, "Q", t.yes_no) is None and one(spark, "TRUE", t.true_false) is True
    assert one(spark, "12345", t.cents) == Decimal("123.45") and one(spark, "123.45", t.cents) is None
    assert one(spark, "PCM-00000042", lambda c: t.prefixed_id(c, "PCM-")) == 42 and one(spark, "7574149615", t.whole_number) == 7574149615
    assert one(spark, " jOHN o'fallon ", t.title) == "John O'fallon" and one(spark, "  ", t.blank_as_null) is None
    assert one(spark, "A", lambda c: t.translated(c, {"A": "Active"})) == "Active" and one(spark, "Z", lambda c: t.translated(c, {"A": "Active"})) == "Z"
    assert one(spark, "", lambda c: t.filled("HARDCODED", "O'Fallon", "string")) == "O'Fallon" and one(spark, "", lambda c: t.filled("DERIVED", "1 - 1", "integer")) == 0


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c"), (1, 7, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in rowshape.latest_rows(df, ["k"], ["t", "v"]).collect()} == {(1, "c"), (2, "c")}


def test_row_shape(spark):
    cols = "table_name string, column_name string, ordinal int, exact_distinct long, row_count long, null_rate double, is_id boolean, inferred_type string"
    rows = [("p", "POL_NO", 0, 10, 12, 0.0, True, "integer"), ("p", "POL_NO_SEQ", 1, 2, 12, 0.0, True, "integer"), ("p", "EFF_DT", 2, 5, 12, 0.0, False, "date"), ("q", "id_no", 0, 5, 5, 0.0, True, "integer"), ("q", "x", 1, 2, 5, 0.0, False, "string"), ("c", "key_id", 0, 3, 5, 0.0, True, "string"), ("c", "_cdc_operation", 1, 2, 5, 0.0, False, "string")]
    got = {r.table_name: r for r in rowshape.infer(spark.createDataFrame(rows, cols)).collect()}
    assert (got["p"].natural_key, got["p"].recency_column, got["p"].strategy) == ("POL_NO", "POL_NO_SEQ", "row_number")
    assert (got["q"].strategy, got["q"].confidence) == ("none", 0.7) and got["c"].strategy == "cdc_latest"
    truth = spark.createDataFrame([("p", "pol_no", "POL_NO_SEQ", "row_number"), ("q", "other", "when", "cdc_latest")], "table_name string, t_key string, t_recency string, t_strategy string")
    assert {r.table_name: r.loss for r in rowshape.score(rowshape.infer(spark.createDataFrame(rows, cols)), truth).collect()} == {"p": 0.0, "q": 1.0}


def test_drift_renames_and_versions(spark):
    make = lambda names: spark.createDataFrame([("s", n, k, False, False, None) for n, k in names], "source_name string, column_name string, inferred_type string, is_id boolean, is_coded boolean, date_format string")
    old = make([("ANNU_PREM_AMT", "integer"), ("WINBK_FLG", "boolean"), ("ZIP", "string"), ("DT", "date")])
    new = make([("ANNUAL_PREM_AMT", "integer"), ("WINBACK_FLG", "boolean"), ("STATE", "string"), ("DT", "string")])
    kinds = {(r.kind, r.old_name, r.new_name) for r in drift.changes(old, new, ["source_name"]).collect()}
    assert kinds == {("renamed", "ANNU_PREM_AMT", "ANNUAL_PREM_AMT"), ("renamed", "WINBK_FLG", "WINBACK_FLG"), ("removed", "ZIP", None), ("added", None, "STATE"), ("type_changed", "DT", "DT")}
    prints = drift.fingerprints(old, ["source_name"])
    versions = prints.withColumn("version", F.lit(1))
    assert drift.next_versions(versions, prints, ["source_name"]).count() == 0
    assert drift.next_versions(versions, drift.fingerprints(new, ["source_name"]), ["source_name"]).first().version == 2
    assert drift.next_versions(versions, drift.fingerprints(new, ["source_name"]), ["source_name"], drift.breaking_sources(drift.changes(old, new, ["source_name"]), ["source_name"])).count() == 0


def test_scoring_and_review(spark):
    labels = spark.createDataFrame([("a", "x", True, 0.9, "cents"), ("b", None, False, None, None), ("c", "y", False, None, None)], "k string, truth string, is_hard boolean, confidence_floor double, check string")
    maps = spark.createDataFrame([("a", "x", 0.8, "v * 2"), ("b", "z", 0.5, "")], "k string, target string, confidence double, expression string")
    got = {r.k: r for r in scoring.score_columns(labels, maps, ["k"]).collect()}
    assert got["a"].verdict == "TP" and got["a"].sql_ok is False and got["a"].below_floor and got["a"].loss == round(2 * (0.3 * 0.04 + 1), 4)
    assert got["b"].verdict == "FP" and got["c"].verdict == "FN" and got["c"].loss == 1.0
    m = scoring.gate(scoring.metrics(scoring.score_columns(labels, maps, ["k"]).withColumn("g", F.lit(1)), ["g"]), 0.9).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.passed) == (1, 1, 1, 0.5, 0.5, False)
    tiers = spark.createDataFrame([(0.85,), (0.5,), (0.49,)], "c double").select(review.tier(F.col("c"))).collect()
    assert [r[0] for r in tiers] == ["auto", "flagged", "low"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.dat").write_text("A | B|C\n1|2|3\n4|5\n6|7|8|9\n")
    (tmp_path / "b.csv").write_text('x,y,z\n"1,5",2,3\n')
    (tmp_path / "c.dat").write_text("only\nv\n")
    seps = {r.path.rsplit("/", 1)[1]: r.sep for r in delimited.detect(spark, [str(tmp_path / n) for n in ("a.dat", "b.csv", "c.dat")]).collect()}
    assert seps == {"a.dat": "|", "b.csv": ",", "c.dat": "|"}
    df = delimited.read(spark, str(tmp_path / "a.dat"))
    assert df.columns == ["A", "B", "C"] and [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("4", "5", ""), ("6", "7", "8")]
    assert delimited.read(spark, str(tmp_path / "b.csv")).first().x == "1,5"
    schema = spark.sql("select cast(1 as decimal(9,0)) a, cast(1 as decimal(38,0)) b, cast(1 as decimal(10,2)) c, timestamp'2020-01-01' d, cast(1 as float) e, array(1) f").schema
    assert [tables.target_type(f.dataType) for f in schema.fields] == ["integer", "bigint", "decimal", "date", "decimal", "string"]
    text, n = tables.read_text(spark.createDataFrame([(1, None)], "a int, b string"))
    assert tuple(text.first()) == ("1", "") and n.first()[0] == 1
    (tmp_path / "p.json").write_text('{"source_name": "s", "table_name": "t", "mappings": [{"source_column": "a", "target_field": "x", "confidence": 0.5, "method": "rule", "sql_expression": "a"}]}')
    rows = artifacts.read_proposals(spark, str(tmp_path / "p.json"))
    none = spark.createDataFrame([], "run_id string")
    assert artifacts.backfill(rows, none).first().run_id == "backfill-p"
    assert artifacts.backfill(rows, spark.createDataFrame([("backfill-p",)], "run_id string")).count() == 0
    (tmp_path / "profile.json").write_text('{"source_name": "s", "profile_hash": "h", "tables": [{"table_name": "t", "row_count": 2, "columns": [{"name": "a", "inferred_type": "string", "value_distribution": {"x": 2}}]}]}')
    r = artifacts.read_profiles(spark, str(tmp_path / "profile.json")).first()
    assert r["name"] == "a" and r["value_distribution"] == {"x": 2}
    artifacts.append(spark.createDataFrame([("s", 1)], "source_name string, v int"), str(tmp_path / "h"))
    artifacts.append(spark.createDataFrame([("s", 2)], "source_name string, v int"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_profile_of_nothing(spark):
    cells = profile.melt(spark.createDataFrame([], "n long, a string"), F.col("n"), "t")
    assert profile.profile(cells).count() == 0
