"""A mapping run with every outside table at once."""

from tallyframe.operators import mapping

COLUMNS = "source_name string, table_name string, column_name string, ordinal int, inferred_type string, date_format string, is_id boolean, is_coded boolean, is_cents boolean, samples array<string>, schema_key string, row_count long, null_rate double, exact_distinct long"
FIELDS = "schema_key string, ordinal int, name string, target_type string, required boolean, secondary string, names array<string>"
KEYED = "source_name string, table_name string, "


def test_all_outside_tables_together(spark):
    col = lambda name, o, kind="string", **k: ("s", "t", name, o, kind, k.get("f"), k.get("id", False), False, False, k.get("samples", []), "k", 100, 0.0, 50)
    columns = spark.createDataFrame(
        [col("POL_NO", 0, id=True, samples=["PCM-1", "PCM-2"]), col("EFF_DT", 1, "date", f="YYYYMMDD"), col("ODD", 2), col("STATE_A", 3), col("STATE_B", 4), col("BROKER", 5), col("GONE", 6), col("_CDC_OP", 7), col("NOTHING_LIKE", 8)], COLUMNS
    )
    field = lambda o, name, kind="string", need=False, second=None, *names: ("k", o, name, kind, need, second, [name, *names])
    fields = spark.createDataFrame([field(0, "pol_no", "bigint", True), field(1, "eff_dt", "date", True), field(2, "state"), field(3, "broker"), field(4, "gone", "string", True), field(5, "extra"), field(6, "owner", "string", True)], FIELDS)
    weights = spark.createDataFrame([("s", 1.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "source_name string, wa double, wb double, wc double")
    keyed = lambda kind, *r: spark.createDataFrame([("s", "t", *x) for x in r], KEYED + kind)
    tables = {
        "weights": weights,
        "suggestions": keyed("column_name string, s_target string, s_confidence double", ("ODD", "extra", 0.99), ("NOTHING_LIKE", "no_field", 0.9)),
        "overrides": keyed("column_name string, o_target string", ("BROKER", "none")),
        "expressions": keyed("column_name string, new_expression string", ("STATE_A", "upper(STATE_A)"), ("POL_NO", "upper(other)")),
        "sourceless": keyed("target string", ("gone",)),
        "decisions": keyed("target string, winner string", ("state", "STATE_B")),
    }
    got = {r.column_name: r for r in mapping.map_columns(columns, fields, **tables).collect()}
    assert "_CDC_OP" not in got
    assert (got["POL_NO"].final_target, got["POL_NO"].transform, got["POL_NO"].confidence) == ("pol_no", "prefixed_id", 1.0)
    assert (got["EFF_DT"].final_target, got["EFF_DT"].transform) == ("eff_dt", "compact_date")
    assert (got["ODD"].final_target, got["ODD"].method, got["ODD"].confidence) == ("extra", "suggested", 0.99)
    assert (got["NOTHING_LIKE"].final_target, got["BROKER"].final_target, got["BROKER"].method) == (None, None, "critic")
    assert (got["GONE"].final_target, got["GONE"].note) == (None, "target has no source")
    assert (got["STATE_A"].final_target, got["STATE_B"].final_target) == (None, "state")
    assert got["STATE_A"].expression == "upper(STATE_A)" and "other" not in got["POL_NO"].expression
    found = {(r.kind, r.name): r.detail for r in mapping.map_catalog(columns, fields, **tables).collect()}
    assert {k for k in found if k[0] == "missing"} == {("missing", "gone"), ("missing", "owner")}
    assert ("excluded", "_CDC_OP") in found and not any(k == "contested" for k, _ in found)
    assert {n for k, n in found if k == "unmapped"} == {"NOTHING_LIKE", "BROKER", "GONE", "STATE_A"}
