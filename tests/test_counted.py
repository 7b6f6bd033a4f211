"""Values counted column by column, few-valued columns by sketches, and profiles that are made once."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import incremental, profile
from tallyframe.plans import registry

SF = "/root/testdata/sf0.001"


def _odd(spark):
    rows = [(i, i % 3 - 1, -20240101 if i % 2 else 20240101, f" {i % 4} " if i % 5 else " ", None if i % 7 else "20240101\n", i % 2 == 0, float(i % 30) - 1.5) for i in range(90)]
    return spark.createDataFrame(rows, "n long, CODE int, DAY long, BLANK string, RARE string, FLG boolean, AMT double").withColumn("ON", F.date_add(F.lit("2024-01-01").cast("date"), F.col("CODE"))).repartition(3)


@pytest.mark.parametrize("limit", [None, 7])
def test_columns_count_as_their_cells(spark, limit):
    df = _odd(spark)
    columns = ["table_name", "column_name", "value", "ordinal", "n", "votes", "first_pos", "cell_type", "date_format"]
    show = lambda d: sorted(map(repr, d.select(columns).collect()))
    got = profile.counted_columns(df, F.col("n"), "t", limit)
    assert show(got) == show(profile.counted(profile.melt(df, F.col("n"), "t"), limit))
    assert not any(x in got._jdf.queryExecution().optimizedPlan().toString() for x in ("Generate", "inline"))
    assert show(profile.counted_columns(df, F.col("n"), "t", limit, {"FLG"})) == show(got.where("column_name = 'FLG'"))


def test_few_valued_columns(spark):
    df = _odd(spark)
    assert profile.few_valued(df) == {"CODE", "DAY", "BLANK", "RARE", "FLG", "ON", "AMT"} and "AMT" not in profile.few_valued(df, 19)
    assert profile.few_valued(df.limit(0)) == set(df.columns)


@pytest.mark.parametrize(("text", "kind"), [("20240101\n", "date"), ("2024-01-01\r\n", "date"), ("1/2/2024\r\n", "date"), ("20241301\n", "integer"), ("19000001", "integer"), ("2024-01-00", "string"), ("18991231", "integer"), ("-20240101", "integer"), ("TRUE\n", "string"), ("5\n", "integer")])
def test_cell_types_at_line_ends(spark, text, kind):
    assert spark.createDataFrame([(text,)], "v string").select(profile.cell_type(F.col("v"))).first()[0] == kind


def test_top_values_count_few_valued_columns_only(spark, monkeypatch):
    asked = []
    values = registry._values
    monkeypatch.setattr(registry, "_values", lambda *a, **k: asked.append(k["only"]) or values(*a, **k))
    registry.profile_top_values(spark, SF)
    assert len(asked) == 1 and "l_returnflag" in asked[0]["lineitem"] and not asked[0]["lineitem"] & {"l_orderkey", "l_extendedprice", "l_shipdate"}


def test_missing_fields_profile_once(spark, monkeypatch):
    made = []
    profiled = registry.profiled
    monkeypatch.setattr(registry, "profiled", lambda *a: made.append(1) or profiled(*a))
    registry.map_missing(spark, SF)
    assert len(made) == 1


def test_states_count_few_values_from_a_narrow_scan(spark):
    df, asked = _odd(spark), []
    cells = profile.melt(df, F.col("n"), "t")
    narrow = lambda names: asked.append(names) or profile.melt(df, F.col("n"), "t", names["t"])
    show = lambda d: sorted((r.column_name, r.row_count, sorted(map(repr, r.few or []))) for r in d.collect())
    assert show(incremental.column_states(cells, "s", narrow)) == show(incremental.column_states(cells, "s"))
    assert len(asked) == 1 and "n" not in asked[0]["t"]
