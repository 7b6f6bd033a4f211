"""Definitions: order-keeping lists, documents and the staging table they give; code lookups."""

from tallyframe.functions import transforms as t
from tallyframe.operators import review
from tallyframe.sources import artifacts

KEYED = "source_name string, table_name string, "


def test_document_round_trip(spark, tmp_path):
    cols = [("A", 3, "id", "try_cast(`A` as bigint)", "accept"), ("B", 1, None, "`B`", "skip"), ("C", 2, "name", "trim(`C`)", "modify"), ("D", 0, None, "`D`", "skip"), ("E", 4, "id", "try_cast(`E` as bigint)", "accept")]
    decided = spark.createDataFrame([("s", "t", c, o, target, e, 0.8, "rule", d) for c, o, target, e, d in cols] + [("s", "open", "X", 0, None, "`X`", 0.1, "rule", "pending")], KEYED + "column_name string, ordinal int, approved_target string, expression string, confidence double, method string, decision string")
    states = review.status(decided, decided.limit(0), review.TABLE)
    some = lambda *r: spark.createDataFrame([("s", "t", *x) for x in r], KEYED + "column_name string, ordinal int")
    missing = spark.createDataFrame([("s", "t", "zip"), ("s", "t", "state")], KEYED + "field string")
    given = spark.createDataFrame([("s", "t", "state", "HARDCODED", "TX"), ("s", "t", "size", "DERIVED", "length(C)")], KEYED + "field string, kind string, value string")
    made = review.definitions(decided, states, missing, resolutions=given, unmapped=some(("Z", 9), ("B", 1)), kept=some(("C", 2), ("D", 0)), reviewer="me", profile_hash="h")
    artifacts.write_definitions(made, str(tmp_path / "d"))
    artifacts.write_definitions(made.where("false"), str(tmp_path / "none"))
    docs = artifacts.read_definitions(spark, str(tmp_path / "d")).collect()
    assert [(d.source_name, d.table_name, d.reviewer_identity, d.profile_hash) for d in docs] == [("s", "t", "me", "h")]
    d = docs[0]
    assert d.extended_attributes == ["B", "Z", "D", "C"]
    assert [(m.source_column, m.target_field) for m in d.approved_mappings] == [("D", None), ("B", None), ("C", "name"), ("A", "id"), ("E", "id")]
    assert [(m.target_field, m.resolution, m.hardcoded_value, m.derivation_sql) for m in d.missing_field_resolutions] == [("size", "DERIVED", None, "length(C)"), ("state", "HARDCODED", "TX", None), ("zip", "NULL", None, None)]
    rows = spark.createDataFrame([("1", "b", " c ", "d", "5", "z")], "A string, B string, C string, D string, E string, Z string")
    out = artifacts.stage(rows, d, [("name", "string"), ("id", "bigint"), ("zip", "string"), ("state", "string"), ("size", "integer"), ("other", "date")])
    assert tuple(out.first()) == ("c", 5, None, "TX", 3, None, '{"B":"b","Z":"z","D":"d","C":" c "}')
    assert review.definitions(decided, states, missing).first().missing_field_resolutions[0].resolution == "NULL"


def test_code_lookup(spark):
    rows = spark.createDataFrame([(1, " A ", "x"), (2, "B", ""), (3, None, "y"), (4, "A", "y")], "id int, `c.1` string, label string")
    known = spark.createDataFrame([("c.1", "A", "alpha"), ("c.1", "A", "zeta"), ("label", "y", "why"), ("other", "B", "no")], "column_name string, code string, label string")
    got = sorted(tuple(r) for r in t.translate_codes(rows, ["c.1", "label"], known).collect())
    assert got == [(1, "alpha", "x"), (2, "B", ""), (3, None, "why"), (4, "alpha", "why")]
    assert sorted(tuple(r) for r in t.missing_codes(rows, ["c.1", "label"], known).collect()) == [("c.1", "B", 1), ("label", "x", 1)]
    assert t.translate_codes(rows.limit(0), ["label"], known.limit(0)).count() == 0
