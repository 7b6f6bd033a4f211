from pyspark.sql import functions as F

from tallyframe.operators import mapping
from tallyframe.plans import canonical

KEYS = "source_name string, table_name string, column_name string, ordinal int, target string, confidence double, secondary string"


def contended(spark, rows):
    df = spark.createDataFrame([("s", "t", c, i, target, conf, second) for i, (c, target, conf, second) in enumerate(rows)], KEYS)
    return mapping.contention(df)


def test_contention_branches(spark):
    rows = [("A", "premium_amount", 0.95, None), ("B", "premium_amount", 0.70, None), ("POL_NO", "policy_id", 0.90, "policy_number"), ("POL_REF", "policy_id", 0.88, "policy_number"), ("X", "region_code", 0.80, None), ("Y", "region_code", 0.79, None), ("Z", None, 0.2, None)]
    out = contended(spark, rows)
    got = {r.column_name: (r.action, r.final_target) for r in out.collect()}
    assert got == {"A": ("kept", "premium_amount"), "B": ("demoted", None), "POL_NO": ("kept", "policy_id"), "POL_REF": ("promoted", "policy_number"), "X": ("contested", "region_code"), "Y": ("demoted", None), "Z": ("unmapped", None)}
    c = mapping.contests(out).first()
    assert c.columns == ["X", "Y"] and c.provisional == "X" and c.confidences == {"X": 0.80, "Y": 0.79}
    decide = lambda w: {r.column_name: r.final_target for r in mapping.decide_contests(out, spark.createDataFrame([("s", "t", "region_code", w)], "source_name string, table_name string, target string, winner string")).collect()}
    assert decide("Y")["Y"] == "region_code" and decide("Y")["X"] is None
    assert decide("nobody")["X"] == "region_code"


def test_prefix_of_samples(spark):
    df = spark.createDataFrame([(["PCM-1", "PCM-2", "x"],), (["PCM-1", "PCL-2"],), (["PCM-1", "x", "y"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(mapping.sample_prefix(F.col("s"))).collect()] == ["PCM-", None, None, None]


def test_suggestions_overrides_and_selection(spark):
    k = "source_name string, table_name string, column_name string"
    base = spark.createDataFrame([("s", "t", "a", "policy", "policy_id", 0.5), ("s", "t", "b", "policy", "end_date", 0.9), ("s", "t", "c", "policy", "risk_score", 0.2), ("s", "t", "d", "policy", "risk_score", 0.6)], k + ", schema_key string, target string, confidence double").withColumn("method", F.lit("rule")).withColumn("transform", F.lit("blank_as_null")).withColumn("expression", F.lit("x"))
    fields = canonical.fields(spark)
    sugg = spark.createDataFrame([("s", "t", "a", "customer_id", 0.8), ("s", "t", "b", "customer_id", 0.9), ("s", "t", "d", "no_such_field", 0.95)], k + ", s_target string, s_confidence double")
    got = {r.column_name: (r.target, r.confidence) for r in mapping.merge_suggestions(base, sugg, fields).collect()}
    assert got == {"a": ("customer_id", 0.8), "b": ("end_date", 0.9), "c": (None, 0.3), "d": (None, 0.95)}
    loose = {r.column_name: r.target for r in mapping.merge_suggestions(base, sugg, fields, strict=False).collect()}
    assert loose["b"] == "customer_id"
    over = mapping.merge_overrides(base, spark.createDataFrame([("s", "t", "a", "NULL"), ("s", "t", "b", "start_date")], k + ", o_target string"))
    got = {r.column_name: (r.target, r.method) for r in over.collect()}
    assert got["a"] == (None, "critic") and got["b"] == ("start_date", "critic") and got["c"] == ("risk_score", "rule")
    fixed = mapping.repair_expressions(over, spark.createDataFrame([("s", "t", "b", "upper(b)"), ("s", "t", "d", "upper(other)")], k + ", new_expression string"))
    assert {r.column_name: r.expression for r in fixed.collect()} == {"a": "x", "b": "upper(b)", "c": "x", "d": "x"}
    labels = spark.createDataFrame([("s", "t", "a", True, None), ("s", "t", "b", False, 0.95), ("s", "t", "c", False, 0.1)], k + ", is_hard boolean, confidence_floor double")
    assert {r.column_name for r in mapping.review_selection(base, labels).collect()} == {"a", "b"}
    gone = mapping.suppress(base, spark.createDataFrame([("s", "t", "end_date")], "source_name string, table_name string, target string"))
    assert {r.column_name: r.target for r in gone.collect()}["b"] is None
    assert {r.column_name for r in mapping.low_confidence(base).collect()} == {"a", "c", "d"}


def test_schema_resolution(spark):
    tables = spark.createDataFrame([("x",), ("y",), ("z",)], "table_name string")
    static = spark.createDataFrame([("x", "coverage"), ("y", "coverage")], "table_name string, schema_key string")
    dynamic = spark.createDataFrame([("y", "own")], "table_name string, schema_key string")
    assert {r.table_name: r.schema_key for r in mapping.resolve_schema(tables, static, dynamic).collect()} == {"x": "coverage", "y": "own", "z": "policy"}


def test_metadata_columns_are_left_out(spark):
    df = spark.createDataFrame([("_cdc_timestamp",), ("name",)], "column_name string")
    kept, out = mapping.split_metadata(df)
    assert [r[0] for r in kept.collect()] == ["name"] and [r[0] for r in out.collect()] == ["_cdc_timestamp"]


def test_default_schemas():
    assert len(canonical.rows("policy", canonical.POLICY)) == 24 and len(canonical.rows("coverage", canonical.COVERAGE)) == 11
