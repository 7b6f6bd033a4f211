"""The registered queries of the reference operators, over the given tables.

Labels, histories and decisions have no table of their own among the inputs; they
are derived from ``events`` and ``orders`` row by row, so all work grows with those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms as t
from ..functions.checkpoints import ensure_checkpoint_dir, new_folder
from ..operators import cluster, drift, incremental, mapping, profile, review, rowshape, scoring, tuning
from ..sources import artifacts, delimited, store
from ..sources.tables import read_text, target_fields
from . import canonical

TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "events": "event_id", "lineitem": "l_orderkey * 10 + l_linenumber"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rows: a legacy text extract of orders, and its canonical form


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a legacy system would send them: text, cents, compact dates, flags, blanks."""
    o = read(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        F.concat(F.lit("PCM-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("POL_NO"),
        F.lpad((F.col("o_orderkey") % 3).cast("string"), 2, "0").alias("POL_NO_SEQ"),
        F.when(F.col("o_orderkey") % 11 == 0, "00000000").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("EFF_DT"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("SIGN_DT"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ISO_DT"),
        cents.cast("string").alias("PREM_AMT"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat((F.col("o_orderkey") % 500).cast("string"), F.lit(".50"))).alias("DEDUCT"),
        F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("N").alias("WINBK_FLG"),
        F.when(F.col("o_orderkey") % 5 == 0, "TRUE").otherwise("false").alias("CLAIMS_IND"),
        F.concat(F.lit("  "), F.upper(F.col("o_orderpriority")), F.lit(" ")).alias("INS_NM"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_orderstatus")).alias("POL_STAT_CD"),
    )


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = legacy(spark, sf_dir)
    return x.select(
        t.prefixed_id(F.col("POL_NO"), "PCM-").alias("policy_id"),
        t.whole_number(F.col("POL_NO_SEQ")).alias("policy_seq"),
        t.blank_as_null(F.col("POL_NO")).alias("policy_number"),
        t.compact_date(F.col("EFF_DT")).alias("start_date"),
        t.us_date(F.col("SIGN_DT")).alias("sign_date"),
        t.iso_date(F.col("ISO_DT")).alias("end_date"),
        t.cents(F.col("PREM_AMT")).alias("premium_amount"),
        t.money(F.col("DEDUCT")).alias("policy_deductible"),
        t.yes_no(F.col("WINBK_FLG")).alias("win_back_eligible"),
        t.true_false(F.col("CLAIMS_IND")).alias("claims_made"),
        t.title(F.col("INS_NM")).alias("insured_name"),
        t.translated(F.col("POL_STAT_CD"), {"F": "Final", "O": "Open"}).alias("policy_status"),
        t.filled("HARDCODED", "TX", "string").alias("region_code"),
        t.filled("DERIVED", "length(POL_NO)", "integer").alias("number_length"),
        t.filled("NULL", None, "bigint").alias("customer_id"),
        t.extended(["POL_NO_SEQ", "CLAIMS_IND"]).alias("extended_attributes"),
    )


def canonical_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transform over all rows, one output column for each target."""
    return staging(spark, sf_dir)


#: A mapping definition of the legacy extract as a reviewer leaves it: (column, transform, prefix, target), the last for a target counts.
APPROVED = [
    ("POL_NO", "blank_as_null", None, "policy_id"), ("POL_NO", "prefixed_id", "PCM-", "policy_id"), ("POL_NO", "blank_as_null", None, "policy_number"), ("POL_NO_SEQ", "whole_number", None, "risk_score"), ("EFF_DT", "compact_date", None, "start_date"),
    ("ISO_DT", "iso_date", None, "end_date"), ("PREM_AMT", "cents", None, "premium_amount"), ("DEDUCT", "money", None, "policy_deductible"), ("WINBK_FLG", "yes_no", None, "win_back_eligible"), ("POL_STAT_CD", "blank_as_null", None, "policy_status"),
]
RESOLVED = [("region_code", "HARDCODED", "TX"), ("customer_id", "DERIVED", "try_cast(substr(POL_NO, 5) as bigint)"), ("agent_id", "NULL", None), ("annual_revenue_impact", "HARDCODED", "12.50")]


def _approved(spark: SparkSession) -> DataFrame:
    """The definition's mappings with the text of their transforms, in order."""
    d = spark.createDataFrame([(i, *a) for i, a in enumerate(APPROVED)], "n int, column_name string, transform string, prefix string, target string")
    return d.select("n", "target", t.expression(F.col("transform"), F.col("column_name"), F.col("prefix")).alias("expression"))


def staging_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14, M9: a definition's texts run over all rows, one column for each field of the schema in its order."""
    listed = [(r.name, r.target_type) for r in canonical.fields(spark).where("schema_key = 'policy'").orderBy("ordinal").collect()]
    approved = [(r.target, r.expression) for r in _approved(spark).orderBy("n").collect()]
    return t.project(legacy(spark, sf_dir), listed, approved, RESOLVED, ["SIGN_DT", "CLAIMS_IND"])


def definition_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed columns finalised to a definition document, the document read again, and the rows staged by it."""
    rows = legacy(spark, sf_dir)
    at = {c: i for i, c in enumerate(rows.columns)}
    placed = F.create_map(*[F.lit(x) for p in at.items() for x in p])
    d = spark.createDataFrame([(i, *a) for i, a in enumerate(APPROVED)] + [(90, "CLAIMS_IND", "true_false", None, None), (91, "SIGN_DT", "us_date", None, None)], "n int, column_name string, transform string, prefix string, approved_target string")
    # Of the texts for one target the last counts, so later ones take later places.
    decided = d.select(F.lit("oldsys").alias("source_name"), F.lit("legacy").alias("table_name"), "column_name", F.when(F.col("approved_target").isNull(), placed[F.col("column_name")]).otherwise(F.col("n")).alias("ordinal"), "approved_target", t.expression(F.col("transform"), F.col("column_name"), F.col("prefix")).alias("expression"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("method"), F.lit("accepted").alias("decision"))
    states = review.status(decided, decided.limit(0), review.TABLE)
    resolved = spark.createDataFrame([("oldsys", "legacy", *r) for r in RESOLVED], "source_name string, table_name string, field string, kind string, value string")
    missing = resolved.select(*review.TABLE, "field").unionByName(spark.createDataFrame([("oldsys", "legacy", "claim_count")], "source_name string, table_name string, field string"))
    unmapped = decided.where("column_name = 'SIGN_DT'").select(*review.TABLE, "column_name", "ordinal")
    path = new_folder(spark, "definitions")
    artifacts.write_definitions(review.definitions(decided, states, missing, resolutions=resolved, unmapped=unmapped, reviewer="r"), path)
    listed = [(r.name, r.target_type) for r in canonical.fields(spark).where("schema_key = 'policy'").orderBy("ordinal").collect()]
    return artifacts.stage(rows, artifacts.read_definitions(spark, path).first(), listed)


def _value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table of codes: all priorities, all order states but one."""
    o = read(spark, sf_dir, "orders")
    status = o.where("o_orderstatus <> 'P'").select(F.lit("POL_STAT_CD").alias("column_name"), F.col("o_orderstatus").alias("code"), F.concat(F.lit("state "), F.lower("o_orderstatus")).alias("label"))
    names = o.select(F.lit("INS_NM").alias("column_name"), F.upper("o_orderpriority").alias("code"), F.lower("o_orderpriority").alias("label"))
    return status.unionByName(names).distinct()


def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: coded columns translated by a lookup table."""
    return t.translate_codes(legacy(spark, sf_dir).select("POL_NO", "POL_STAT_CD", "INS_NM", "WINBK_FLG"), ["POL_STAT_CD", "INS_NM", "WINBK_FLG"], _value_map(spark, sf_dir))


def canonical_codes_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: codes that the lookup table lacks."""
    return t.missing_codes(legacy(spark, sf_dir), ["POL_STAT_CD", "INS_NM", "WINBK_FLG"], _value_map(spark, sf_dir))


def canonical_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that neither an approved mapping nor a resolution covers, for each status of the extract's rows."""
    wanted = canonical.fields(spark).where("schema_key = 'policy'").select("name", "required")
    resolved = spark.createDataFrame(RESOLVED, "field string, kind string, value string")
    missing = t.unmapped_fields(wanted, _approved(spark), resolved)
    used = legacy(spark, sf_dir).groupBy("POL_STAT_CD").agg(F.count("*").alias("rows"))
    return used.join(F.broadcast(missing), F.lit(True))


def label_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels derived from the history, written as catalog files by source and loaded again."""
    h = history(spark, sf_dir).withColumn("table_name", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    keys = ["source_name", "table_name", "source_column"]
    columns = h.groupBy(*keys).agg(F.max_by("truth", "id").alias("truth"), F.min("truth").alias("secondary"), F.max("confidence_floor").alias("confidence_floor"), F.max("check").alias("check"), F.bool_or("is_hard").alias("is_hard"))
    missing = h.where("id % 97 = 5 and target is not null").select("source_name", "table_name", F.col("target").alias("field"))
    path = new_folder(spark, "labels")
    artifacts.write_labels(columns, missing, path)
    found, gone = artifacts.read_labels(spark, path)
    return found.unionByName(gone.select("source_name", "table_name", F.lit("-").alias("source_column"), F.col("field").alias("truth")), allowMissingColumns=True)


def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    return rowshape.latest_rows(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


def dedup_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each (user, type)."""
    return rowshape.latest_change(read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id")


# --- profiles


def _wide(spark: SparkSession, sf_dir: str) -> dict:
    """The profiled tables with their positions."""
    tables = {name: (profile_input(spark, sf_dir, name), F.expr(key)) for name, key in TABLES.items()}
    return tables | {"legacy": (legacy(spark, sf_dir), F.substring("POL_NO", 5, 8).cast("bigint"))}


def cells(spark: SparkSession, sf_dir: str, only: dict[str, set[str]] | None = None) -> DataFrame:
    """All cells of six tables, or those of the columns ``only`` by table."""
    return reduce(DataFrame.unionByName, [profile.melt(df, pos, name, None if only is None else only[name]) for name, (df, pos) in _wide(spark, sf_dir).items() if only is None or name in only])


def _values(spark: SparkSession, sf_dir: str, vote_rows: int | None = None, only: dict[str, set[str]] | None = None) -> DataFrame:
    """The counted values of six tables, or of the columns ``only`` by table."""
    wide = {name: t for name, t in _wide(spark, sf_dir).items() if only is None or only.get(name)}
    return reduce(DataFrame.unionByName, [profile.counted_columns(df, pos, name, vote_rows, None if only is None else only[name]) for name, (df, pos) in wide.items()])


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, pos) of all their rows."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), pos.cast("long").alias("pos")) for name, (df, pos) in _wide(spark, sf_dir).items()])


def profile_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All columns; doubles with all their digits in plain notation and times with six decimals, the same in every engine."""
    df = read(spark, sf_dir, name)
    plain = lambda c: F.regexp_replace(F.col(c).try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    shown = lambda c: F.col(c).cast("string")
    # Only numbers with an exponent are written anew.
    text = {"double": lambda c: F.when(F.contains(shown(c), F.lit("E")), F.coalesce(plain(c), shown(c))).otherwise(shown(c)), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")}
    if name in ("orders", "lineitem"):  # their times are dates
        text |= {k: lambda c: F.date_format(c, "yyyy-MM-dd") for k in ("timestamp", "timestamp_ntz")}
    return df.select([text.get(k, F.col)(c).alias(c) for c, k in df.dtypes])


def profile_vote_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first 700 rows of each table vote; counts are of all rows."""
    return profile.profile(None, values=_values(spark, sf_dir, vote_rows=700)).select("table_name", "column_name", "inferred_type", "date_format", "row_count", "null_rate")


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per column of six tables."""
    return profile.profile(None, values=_values(spark, sf_dir)).drop("ordinal")


def profile_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries' states published one by one, and the profile of all made of states; the sketched counts against exact ones."""
    ensure_checkpoint_dir(spark)
    path = new_folder(spark, "states")
    c = cells(spark, sf_dir)
    for k in range(3):
        part = lambda of: of.where(F.pmod("pos", F.lit(3)) == k)  # noqa: B023, E731
        store.publish(incremental.column_states(part(c), "shop", lambda names: part(cells(spark, sf_dir, names))), path, f"delivery-{k}")  # noqa: B023
    merged = incremental.merged_profile(store.read(spark, path, incremental.STATE))
    exact = _values(spark, sf_dir).groupBy("table_name", "column_name").agg(F.count("value").alias("d"))
    close = F.when(F.col("distinct_exact"), F.col("distinct_estimate") == F.col("d")).otherwise(F.abs(F.col("distinct_estimate") - F.col("d")) <= 0.06 * F.col("d"))
    return merged.join(exact, ["table_name", "column_name"]).select("table_name", "column_name", "row_count", "null_rate", "inferred_type", "date_format", "is_id", "is_coded", "is_cents", "distinct_exact", close.alias("distinct_close"), F.array_join(F.transform("top", lambda t: t["value"]), "|").alias("top"))


def profile_type_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes for each cell type."""
    return profile.type_votes(_values(spark, sf_dir).where("value is not null"))


def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: values are counted only in columns that sketches say have few."""
    few = {name: profile.few_valued(df) for name, (df, _) in _wide(spark, sf_dir).items()}
    if not any(few.values()):
        few = None  # no column: the operator says so of all values
    return profile.top_values(settled(_values(spark, sf_dir, only=few)).where("value is not null").drop("ordinal"))


def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, as joined text."""
    return profile.samples(cells(spark, sf_dir), rows_of(spark, sf_dir)).select("table_name", "column_name", F.array_join("samples", "|").alias("samples"))


def profile_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    return profile.profile_hash(profile.profile(None, values=_values(spark, sf_dir)))


def rowshape_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R4 for six tables."""
    return rowshape.infer(profile.profile(None, values=_values(spark, sf_dir)))


def rowshape_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred shapes against expected ones."""
    truth = spark.createDataFrame([("orders", "O_ORDERKEY", "o_orderdate", "row_number"), ("events", "event_id", None, "none"), ("customer", "c_custkey", None, "none"), ("legacy", "POL_NO", "POL_NO_SEQ", "row_number")], "table_name string, t_key string, t_recency string, t_strategy string")
    return rowshape.score(rowshape_infer(spark, sf_dir), truth)


# --- sources


def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legacy extract written as text files with a header, its separator found, read back as text."""
    path = new_folder(spark, "extract")
    out = legacy(spark, sf_dir).write.option("header", True).option("sep", "|").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    out.csv(path)
    return delimited.read(spark, path)


def delimited_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in quoted cells with separators, doubled quotes, backslashes and line feeds, written as files and scanned again."""
    d = read(spark, sf_dir, "documents")
    path = new_folder(spark, "quoted")
    text = F.coalesce("text", F.lit(""))
    rows = d.select(F.col("doc_id").cast("string").alias("DOC_ID"), text.alias("BODY"), F.concat(F.lit('"'), F.coalesce("source", F.lit("")), F.lit('", \\')).alias("SAID"), F.concat(F.lit("\n"), F.substring_index(text, "\n", 2), F.lit('"\n')).alias("HEAD"), F.coalesce(F.col("lang"), F.lit("")).alias("LANG"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return delimited.read(spark, path)


def source_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True row counts of tables that are read as text."""
    parts = [read_text(read(spark, sf_dir, name))[1].select(F.lit(name).alias("table_name"), "row_count") for name in [*TABLES, "documents"]]
    return reduce(DataFrame.unionByName, parts)


# --- mapping


def settled(df: DataFrame) -> DataFrame:
    """A catalog-sized table cut from its lineage: profiles aren't computed again by each of its readers."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile rows ready for mapping: two sources, policy names on both."""
    return _ready(cells(spark, sf_dir), rows_of(spark, sf_dir), _values(spark, sf_dir))


def _ready(c: DataFrame, at: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    rows = profile.profile(c, values=values).join(profile.samples(c, at), ["table_name", "column_name"], "left")
    rows = rows.withColumn("source_name", F.when(F.col("table_name") == "legacy", "oldsys").otherwise("shop")).withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return settled(rows.withColumn("schema_key", F.when(F.col("table_name").isin("orders", "events", "lineitem"), "customer_table").otherwise("policy")))


def target_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared schemas and one taken from a table's schema."""
    return canonical.fields(spark, target_fields("customer_table", read(spark, sf_dir, "customer").schema))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, _ = mapping.split_metadata(profiled(spark, sf_dir))
    return mapping.scores(usable, target_tables(spark, sf_dir))


def map_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6: all scores of all columns."""
    s = _scored(spark, sf_dir)
    return s.select("table_name", "column_name", "field", *[F.bround(c, 6).alias(c) for c in ("name_score", "type_score", "pattern_score", "confidence")])


def map_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the best field of each column."""
    b = mapping.best_field(_scored(spark, sf_dir))
    return b.select("table_name", "column_name", "target", "name_score", "type_score", "pattern_score", "confidence")


def map_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M22."""
    return mapping.top_fields(_scored(spark, sf_dir))


def _contended(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    return mapping.map_columns(profiled(spark, sf_dir) if columns is None else columns, target_tables(spark, sf_dir))


def map_contention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided targets with their transforms."""
    return _contended(spark, sf_dir).select("table_name", "column_name", "target", "confidence", "action", "final_target", "transform", "expression")


def _named(d: DataFrame, names: dict[str, str], column: str) -> DataFrame:
    """Rows of the given columns with a value each."""
    pick = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return d.where(F.col("column_name").isin(list(names))).select(*mapping.KEYS, F.element_at(pick, F.col("column_name")).alias(column))


def map_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions, overrides, supplied expressions and suppression on the best fields."""
    fields = target_tables(spark, sf_dir)
    best = settled(mapping.with_transform(mapping.best_field(_scored(spark, sf_dir))))
    suggested = _named(best, {"c_custkey": "customer_id", "s_suppkey": "no_such_field", "INS_NM": "policy_type", "POL_NO": "policy_number"}, "s_target").withColumn("s_confidence", F.lit(0.8))
    merged = mapping.merge_suggestions(best, suggested, fields)
    merged = mapping.merge_overrides(merged, _named(best, {"ISO_DT": "end_date", "c_name": "None"}, "o_target"))
    merged = mapping.repair_expressions(merged, _named(best, {"ISO_DT": "to_date(ISO_DT)", "INS_NM": "upper(other)", "PREM_AMT": "PREM_AMT * 2"}, "new_expression"))
    merged = mapping.suppress(merged, best.select("source_name", "table_name").distinct().withColumn("target", F.lit("policy_status")))
    low = mapping.low_confidence(merged).select(*mapping.KEYS, F.lit(True).alias("low"))
    return merged.join(low, mapping.KEYS, "left").select("table_name", "column_name", "target", "confidence", "method", "expression", F.coalesce("low", F.lit(False)).alias("low"))


def map_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contested targets, as the first of two near ties is decided for the second."""
    again = _near_ties(spark, sf_dir)
    open_ = mapping.contests(again)
    decisions = open_.select("source_name", "table_name", "target", F.get("columns", F.lit(1)).alias("winner"))
    return mapping.decide_contests(again, decisions).where("action <> 'unmapped'").select("table_name", "column_name", "target", "action", "final_target")


def _near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = settled(_contended(spark, sf_dir).withColumn("confidence", F.bround("confidence", 1)))
    return settled(mapping.contention(d.drop("action", "final_target", "reason")))


def map_contest_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contested target with its columns and confidences, best first."""
    listed = F.array_join(F.transform("columns", lambda c: F.concat(c, F.lit("="), F.format_number(F.element_at("confidences", c), 1))), ",")
    return mapping.contests(_near_ties(spark, sf_dir)).select("source_name", "table_name", "target", "provisional", listed.alias("columns"))


def map_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why columns lost or share their targets; their expressions stay."""
    return _near_ties(spark, sf_dir).where("reason is not null").select("table_name", "column_name", "target", "action", "final_target", "reason")


def map_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M2: each event type as a table with columns of its own, some of them written by change capture, and its schema."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("table_name"), F.when(F.col("event_id") % 10 == 0, "_cdc_op").when(F.col("event_id") % 10 == 1, "_CDC_TS").otherwise(F.concat(F.lit("COL_"), (F.col("event_id") % 10).cast("string"))).alias("column_name")).distinct()
    static = spark.createDataFrame([("click", "clicks"), ("purchase", "orders")], "table_name string, schema_key string")
    dynamic = spark.createDataFrame([("purchase", "sales"), ("view", "views")], "table_name string, schema_key string")
    usable, excluded = mapping.split_metadata(mapping.resolve_schema(e, static, dynamic))
    return usable.withColumn("excluded", F.lit(False)).unionByName(excluded.withColumn("excluded", F.lit(True)))


def map_review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to be reviewed, labelled hard or below their floors."""
    h = history(spark, sf_dir).select("id", "source_name", F.lit("t").alias("table_name"), F.col("id").cast("string").alias("column_name"), "confidence", "is_hard")
    labels = h.where("id % 7 <> 0").select(*mapping.KEYS, "is_hard", (F.col("id") % 5 / 4).alias("confidence_floor"))
    return mapping.review_selection(h.drop("is_hard"), labels).select("id", "confidence", "is_hard", "confidence_floor")


def map_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over all tables: mapped, unmapped, excluded, missing and contested, with the row shapes."""
    return mapping.map_catalog(profiled(spark, sf_dir), target_tables(spark, sf_dir)).select("table_name", "kind", "name", F.when(F.col("kind") != "unmapped", F.col("detail")).alias("detail"))


def map_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21."""
    columns = profiled(spark, sf_dir)
    tables = columns.select("source_name", "table_name", "schema_key").distinct()
    return mapping.missing_required(tables, target_tables(spark, sf_dir), _contended(spark, sf_dir, columns)).select("table_name", "field")


# --- drift


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The legacy extract's profile, and that of a next delivery with renamed, lost, new and retyped columns."""
    x = legacy(spark, sf_dir)
    y = x.withColumnsRenamed({"POL_STAT_CD": "POL_STATUS_CD", "WINBK_FLG": "WINBK_FLAG", "INS_NM": "HOLDER"}).drop("CLAIMS_IND").withColumn("SIGN_DT", F.lit("unknown")).withColumn("BATCH_NO", F.lit("7"))
    pos = F.substring("POL_NO", 5, 8).cast("bigint")
    make = lambda d: profile.profile(profile.melt(d, pos, "legacy")).withColumn("source_name", F.lit("oldsys"))
    return make(x), make(y)


def drift_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3-D5, D7."""
    old, new = _two_versions(spark, sf_dir)
    return drift.changes(old, new, ["source_name"])


def drift_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the next delivery that need a mapping."""
    old, new = _two_versions(spark, sf_dir)
    return drift.to_be_mapped(drift.changes(old, new, ["source_name"])).select("source_name", "new_name", "new_type")


def backfill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals written as a file for each run, read again, and those that the history lacks."""
    h = history(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct(F.col("source_column").alias("source_column"), F.col("target").alias("target_field"), "confidence", "method", F.col("expression").alias("sql_expression"))))
    docs = h.where("id % 50 = 3").groupBy("source_name", F.lit("t").alias("table_name")).agg(rows.alias("mappings"))
    path = new_folder(spark, "proposals")
    docs.write.option("maxRecordsPerFile", 1).json(path)
    found = artifacts.read_proposals(spark, path)
    done = spark.createDataFrame([("backfill-none",)], "run_id string")
    return artifacts.backfill(found, done).groupBy("source_name", "table_name", "source_column", "target_field").agg(F.count("*").alias("n"))


def score_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as CSV with a header, and read as text."""
    path = new_folder(spark, "scores")
    artifacts.write_scores(_scored_history(spark, sf_dir).select("id", "verdict", "below_floor"), path)
    return spark.read.option("header", True).csv(path)


def drift_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be recorded for a new, an unchanged, a forced and a blocked delivery."""
    old, new = _two_versions(spark, sf_dir)
    key = ["source_name"]
    first = drift.fingerprints(old, key)
    names = F.array(*[F.lit(n) for n in ("same", "forced", "blocked")])
    versions = first.select(F.explode(names).alias("source_name"), F.lit(1).alias("version"), "schema_hash", "columns")
    second = drift.fingerprints(new, key)
    seen = first.select(F.explode(F.array(F.lit("same"), F.lit("new"))).alias("source_name"), "columns", "schema_hash").unionByName(second.select(F.explode(F.array(F.lit("forced"), F.lit("blocked"))).alias("source_name"), "columns", "schema_hash"))
    blocked = drift.breaking_sources(drift.changes(old, new, key), key).select(F.lit("blocked").alias("source_name"))
    out = drift.next_versions(versions, seen, key, blocked)
    return out.select("source_name", "version", F.size("columns").alias("columns"), F.transform("columns", lambda c: F.concat_ws(":", c["column_name"], c["inferred_type"], c["is_id"].cast("string"), c["is_coded"].cast("string"), c["date_format"])).cast("string").alias("fingerprint"))


def drift_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries appended to a store of versions, the last one twice, as a job that is run again."""
    ensure_checkpoint_dir(spark)
    old, new = _two_versions(spark, sf_dir)
    path = new_folder(spark, "versions")
    names = F.explode(F.array(F.lit("forced"), F.lit("blocked"))).alias("source_name")
    first, last = (settled(v.drop("source_name").select(names, "*")) for v in (old, new))
    forced = spark.range(1).select(F.lit("forced").alias("source_name"))
    for run, delivered in (("1", first), ("2", first), ("3", last), ("3", last)):
        drift.record_delivery(delivered, path, run, forced)
    out = store.read(spark, path, drift.VERSION)
    return out.select("source_name", "run_id", "version", F.size("columns").alias("columns"), F.transform("columns", lambda c: F.concat_ws(":", c["column_name"], c["inferred_type"], c["is_id"].cast("string"), c["is_coded"].cast("string"), c["date_format"])).cast("string").alias("fingerprint"))


# --- clusters


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    keys = ["table_name", "column_name"]
    p = settled(profile.profile(None, values=_values(spark, sf_dir)))
    # Values are counted once more only for columns that have few.
    few: dict[str, set[str]] = {}
    for r in p.where(F.col("exact_distinct").between(1, profile.TOP_DISTINCT)).select(*keys).collect():  # names of columns, for the scan
        few.setdefault(r["table_name"], set()).add(r["column_name"])
    counts = settled(_values(spark, sf_dir, only=few)).where("value is not null").drop("ordinal") if few else profile.value_counts(c.limit(0))
    top = profile.top_values(counts).groupBy(*keys).agg(F.collect_set(F.upper("value")).alias("top"))
    rows = p.join(top, keys, "left").join(profile.samples(c, rows_of(spark, sf_dir)), keys, "left")
    none = F.array().cast("array<string>")
    vocabulary = F.array_distinct(F.concat(F.coalesce("top", none), F.transform(F.coalesce("samples", none), lambda v: F.upper(v))))
    bounded = F.col("is_coded") | F.col("top").isNotNull()
    return settled(rows.select(F.col("table_name").alias("source_name"), F.regexp_replace("column_name", "^[a-z]_", "").alias("column_name"), "ordinal", "inferred_type", "is_id", "is_coded", "is_cents", F.when(F.col("row_count") > 0, F.col("exact_distinct") / F.col("row_count")).otherwise(0.0).alias("distinct_ratio"), "null_rate", F.when(bounded, vocabulary).otherwise(none).alias("vocabulary")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(cluster.pair_scores(_catalog(spark, sf_dir)))


_ENDS = ["a_source_name", "a_column_name", "b_source_name", "b_column_name"]


def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K7."""
    return _pairs(spark, sf_dir).select(*_ENDS, "name", "overlap", F.bround("score", 4).alias("score"))


def cluster_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8."""
    return cluster.mutual_best(_pairs(spark, sf_dir)).select(*_ENDS, F.bround("score", 4).alias("score"))


def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9-K10."""
    catalog = _catalog(spark, sf_dir)
    return cluster.clusters(catalog, settled(cluster.pair_scores(catalog)))


def cluster_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual bests as groups of two sources, against targets derived from names."""
    catalog = _catalog(spark, sf_dir)
    best = cluster.mutual_best(settled(cluster.pair_scores(catalog)).where("a_source_name = 'customer' and b_source_name = 'supplier'"))
    x = best.select(F.concat_ws(".", "a_source_name", "a_column_name").alias("member"), F.col("a_source_name").alias("source_name"), F.col("a_column_name").alias("cluster"))
    y = best.select(F.concat_ws(".", "b_source_name", "b_column_name").alias("member"), F.col("b_source_name").alias("source_name"), F.col("a_column_name").alias("cluster"))
    everyone = catalog.where("source_name in ('customer', 'supplier')").select(F.concat_ws(".", "source_name", "column_name").alias("member"), "source_name", F.col("column_name").alias("c"))
    found = everyone.join(x.unionByName(y), ["member", "source_name"], "left").select("member", "source_name", F.coalesce("cluster", "member").alias("cluster"))
    truth = everyone.select("member", F.when(F.col("c").isin("name", "nationkey", "acctbal"), F.col("c")).alias("target"), F.lit(None).cast("string").alias("secondary"))
    return cluster.score_clusters(found, truth)


def cluster_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes derived from events: ten runs that propose pairs."""
    e = read(spark, sf_dir, "events")
    v = e.select(F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("pair"), (F.col("event_id") % 10).alias("run"), F.concat(F.lit("a"), (F.col("event_id") % 6).cast("string")).alias("a"), F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")).alias("b"), ((F.col("event_id") * 13 % 50 + 50) / 100).alias("confidence"))
    known = v.select("pair", F.lit("a").alias("side"), F.col("a").alias("name")).unionByName(v.select("pair", F.lit("b").alias("side"), F.col("b").alias("name"))).distinct().where("name <> 'a5'")
    return cluster.vote_consensus(v, 10, share=0.5, known=known)


# --- history, scores, tuning


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping history of one row per event."""
    e = read(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    target = F.when(i % 9 == 0, None).otherwise(text("field_", i * 7 % 24))
    truth = F.when(i % 10 == 0, None).otherwise(F.when(i % 4 == 1, text("field_", i * 5 % 24)).otherwise(text("field_", i * 7 % 24)))
    return e.select(
        i.alias("id"), text("run-", u % 20).alias("run_id"), text("src", u % 5).alias("source_name"), text("COL_", i % 40).alias("source_column"),
        target.alias("target"), truth.alias("truth"), ((i * 37 % 101) / 100).alias("confidence"), (i % 3 == 0).alias("is_hard"), F.lit(0.6).alias("confidence_floor"),
        F.when(i % 5 == 0, "cents").when(i % 5 == 1, "date").alias("check"), F.when(i % 2 == 0, "x / 100").otherwise("try_to_date(x)").alias("expression"),
        F.when(i % 6 == 0, "critic").otherwise("rule").alias("method"), F.when(i % 4 == 0, "accepted").when(i % 4 == 1, "auto_approved").alias("reviewer_action"),
        F.when(i % 8 != 3, text("sig", i % 7)).alias("profile_signature"), F.col("ts").alias("recorded_at"), "event_type",
    )


def _scored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    labels = h.select("id", "run_id", "source_name", "source_column", "truth", "is_hard", "confidence_floor", "check")
    found = h.where("id % 17 <> 0").select("id", "target", "confidence", "expression")
    return scoring.score_columns(labels, found, ["id"])


def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G5."""
    return _scored_history(spark, sf_dir).select("id", "verdict", "sql_ok", "below_floor", F.col("calibration").cast("decimal(10,4)").alias("calibration"), F.col("loss").cast("decimal(10,4)").alias("loss"))


def score_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over named columns only."""
    h = history(spark, sf_dir)
    only = h.where("source_column in ('COL_1', 'COL_2', 'COL_3')").select("id")
    labels = h.select("id", "source_column", "truth", "is_hard", "confidence_floor", "check")
    s = scoring.score_columns(labels, h.select("id", "target", "confidence", "expression"), ["id"], only)
    return s.groupBy("source_column", "verdict").agg(F.count("*").alias("n"))


def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7, G9 by source."""
    return scoring.gate(scoring.metrics(_scored_history(spark, sf_dir), ["source_name"]), 0.3, 0.9)


def score_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that labels and mappings say are missing, by source."""
    h = history(spark, sf_dir)
    labelled = h.where("truth is not null and id % 4 = 1").select("source_name", F.col("truth").alias("field")).distinct()
    detected = h.where("target is not null and id % 3 = 1").select("source_name", F.col("target").alias("field")).distinct()
    return scoring.score_missing(labelled, detected, ["source_name"])


def verdict_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts onto a history that has some."""
    h = history(spark, sf_dir).select("id", "run_id", "source_column", F.when(F.col("id") % 2 == 0, "OLD").alias("verdict"))
    new = _scored_history(spark, sf_dir).where("id % 3 = 0").select("id", "verdict")
    return scoring.write_back(h, new, ["id"])


def tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of 231 weight points on the legacy extract."""
    own = profile.melt(legacy(spark, sf_dir), F.substring("POL_NO", 5, 8).cast("bigint"), "legacy")
    s = mapping.scores(mapping.split_metadata(_ready(own))[0], canonical.fields(spark))
    truth = spark.createDataFrame([("POL_NO", "policy_id", True), ("EFF_DT", "start_date", True), ("PREM_AMT", "premium_amount", True), ("DEDUCT", "policy_deductible", False), ("WINBK_FLG", "win_back_eligible", False), ("POL_STAT_CD", "policy_status", False), ("INS_NM", None, False), ("ISO_DT", None, False), ("SIGN_DT", None, False), ("CLAIMS_IND", None, False), ("POL_NO_SEQ", None, False)], "column_name string, truth string, is_hard boolean")
    labels = truth.select(F.lit("oldsys").alias("source_name"), F.lit("legacy").alias("table_name"), "column_name", "truth", "is_hard", F.lit(None).cast("double").alias("confidence_floor"), F.lit(None).cast("string").alias("check"))
    measured = tuning.grid_metrics(s, tuning.simplex(spark), labels)
    return tuning.ranked_points(measured, 10).select("point", "tp", "fp", "fn", "wrong", "f1", "mean_loss")


def tune_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of every column's scores at every point, summed by point."""
    s = _scored(spark, sf_dir).join(F.broadcast(tuning.simplex(spark)), F.lit(True))
    c = F.least(F.lit(1.0), F.col("wa") * F.col("name_score") + F.col("wb") * F.col("type_score") + F.col("wc") * F.col("pattern_score"))
    return s.groupBy("point").agg(F.count("*").alias("scores"), F.bround(F.sum(c), 3).cast("decimal(18,3)").alias("total"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4."""
    return tuning.threshold_sweep(history(spark, sf_dir))


def curate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    h = history(spark, sf_dir).withColumn("verdict", scoring.verdict(F.col("truth"), F.col("target"))).withColumnRenamed("target", "target_field")
    labels = h.groupBy("source_name", "source_column").agg(F.bool_or("is_hard").alias("is_hard"))
    active = h.where("id % 211 = 0").select("source_name", "source_column").distinct()
    return tuning.curate(h.drop("is_hard"), labels, active).select("source_name", "source_column", "id", "target_field", "origin")


def similar_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of other columns for each profiled column."""
    p = profiled(spark, sf_dir)
    return tuning.similar_examples(p.withColumn("source_name", F.lit("all")), p.withColumn("source_name", F.lit("all")).withColumnRenamed("column_name", "source_column"))


def example_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by origin and status after some are retired."""
    h = history(spark, sf_dir)
    ex = h.select(F.col("id").alias("example_id"), F.col("method").alias("origin"), F.lit("active").alias("status"))
    gone = h.where("id % 5 = 0").select(F.col("id").alias("example_id"), F.lit("stale").alias("retire_reason"))
    return tuning.example_stats(tuning.retire(ex.withColumn("retire_reason", F.lit(None).cast("string")), gone))


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the stratified split."""
    return stratified_split(spark, sf_dir).groupBy("is_hard", "part").agg(F.count("*").alias("n"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of every row."""
    return tuning.stratified_split(history(spark, sf_dir).select("id", "is_hard"), ["id"], "is_hard")


def curation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: how many examples are added and skipped."""
    h = history(spark, sf_dir).withColumn("verdict", scoring.verdict(F.col("truth"), F.col("target"))).withColumnRenamed("target", "target_field")
    labels = h.groupBy("source_name", "source_column").agg(F.bool_or("is_hard").alias("is_hard"))
    return tuning.curation_counts(h.drop("is_hard"), labels, h.where("id % 211 = 0").select("source_name", "source_column").distinct())


def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even rows' losses against those of the row after each."""
    s = _scored_history(spark, sf_dir).select("id", "verdict", "loss")
    before, after = s.where("id % 2 = 0"), s.where("id % 2 = 1").withColumn("id", F.col("id") - 1)
    c = tuning.comparison(before, after, ["id"])
    return c.select("before_columns", "after_columns", "regressed", F.bround("before_loss", 6).alias("before_loss"), F.bround("after_loss", 6).alias("after_loss"), "improved")


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return tuning.diagnose(_scored_history(spark, sf_dir)).groupBy("source_name", "verdict", "fragile").agg(F.count("*").alias("n"))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns right in the even runs' state and not in the odd runs'."""
    h = history(spark, sf_dir).withColumn("verdict", scoring.verdict(F.col("truth"), F.col("target")))
    pick = lambda r: h.where(f"id % 2 = {r}").groupBy("source_name", "source_column").agg(F.max_by("verdict", F.struct("recorded_at", "id")).alias("verdict"))
    after = pick(1).select("source_name", F.concat(F.lit("COL_"), (F.substring("source_column", 5, 3).cast("int") - 1).cast("string")).alias("source_column"), "verdict")
    return tuning.regressions(pick(0), after, ["source_name", "source_column"])


def repeat_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11."""
    return tuning.repeat_variance(_scored_history(spark, sf_dir), ["run_id"])


def latest_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest accepted version for each agent, from events."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("agent_name"), F.col("event_id").alias("version_id"), (F.col("event_id") % 3 == 0).alias("accepted"), F.col("ts").alias("accepted_at"))
    return tuning.latest_accepted(e)


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of one row per event."""
    e = read(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(F.concat(F.lit("run-"), (u % 20).cast("string")).alias("run_id"), F.concat(F.lit("COL_"), (i % 40).cast("string")).alias("source_column"), F.when(i % 11 == 0, "critic").otherwise("mapping").alias("agent"), F.col("event_type").alias("tool_name"), i.alias("call_order"), F.concat(F.lit('{"q":'), (i % 4).cast("string"), F.lit("}")).alias("inputs_json"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir).withColumn("verdict", scoring.verdict(F.col("truth"), F.col("target"))).withColumn("signature", F.concat(F.lit("sig"), (F.substring("source_column", 5, 3).cast("int") % 6).cast("string")))
    return tuning.usage_rows(tool_calls(spark, sf_dir), h.where("id % 23 <> 1"))


def usage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13."""
    return _usage(spark, sf_dir).select("run_id", "source_column", "verdict", "signature", "calls", F.array_join("first_tools", ",").alias("first_tools"))


def usage_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14."""
    return tuning.tool_value(_usage(spark, sf_dir))


def usage_under_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15."""
    return tuning.under_triggered(usage_value(spark, sf_dir), 0.05)


def usage_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16."""
    return tuning.call_efficiency(tool_calls(spark, sf_dir))


def tuning_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning runs among the loss runs, each run's newest row only."""
    e = read(spark, sf_dir, "events")
    runs = e.select(F.concat(F.lit("run-"), (F.col("event_id") % 400).cast("string")).alias("run_id"), F.col("event_id").alias("n"), F.concat(F.lit('{"tuning_layer":'), (F.col("event_id") % 3).cast("string"), F.lit("}")).alias("config_snapshot"))
    return tuning.tuning_runs(artifacts.replaced(runs, ["run_id"], ["n"]))


def history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest rows of each source's column."""
    return artifacts.newest_of_each(history(spark, sf_dir).select("source_name", "source_column", "id", "recorded_at"), ["source_name", "source_column"], ["recorded_at", "id"], 3).select("source_name", "source_column", "rank", "id")


# --- review


def _mapped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("id", "source_name", "source_column", "target", "confidence", "method")


def review_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V2."""
    return review.auto_review(_mapped_history(spark, sf_dir)).select("id", "tier", "action", "approved_target")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _mapped_history(spark, sf_dir)
    known = h.where("target is not null").select(F.col("target").alias("name")).distinct()
    i = F.col("id")
    d = h.where("id % 40 <> 7 or id % 3 <> 0").select("id", F.when(i % 3 == 0, "accept").when(i % 3 == 1, "modify").otherwise("skip").alias("decision"), F.concat(F.lit("field_"), F.when(i % 40 < 10, i % 26).otherwise(i % 24).cast("string")).alias("new_target"))
    return review.apply_decisions(h, d, known, ["id"]).join(h.select("id", "source_name", "source_column"), "id")


def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    return _decided(spark, sf_dir).select("id", "decision", "approved_target", "method")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir)
    open_contests = d.where("confidence > 0.985 and source_name = 'src0' and source_column in ('COL_1', 'COL_2', 'COL_3')").select("source_column")
    return review.status(d, open_contests, ["source_column"])


def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 by column."""
    return _states(spark, sf_dir)


def review_finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: decided rows of what is ready."""
    return review.finalise(_decided(spark, sf_dir), _states(spark, sf_dir), ["source_column"], "id")


def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: reviews onto the history, new ones inserted."""
    h = history(spark, sf_dir).select("id", "reviewer_action", "method")
    new = _decided(spark, sf_dir).select((F.col("id") + 500).alias("id"), F.col("decision").alias("reviewer_action"), F.lit("review").alias("method"))
    return review.upsert(h, new, ["id"], "reviewer_action")


_HELPERS = {"read", "rows_of", "legacy", "staging", "cells", "profile_input", "profiled", "target_tables", "history", "tool_calls", "target_fields", "settled", "read_text", "new_folder", "reduce", "queries"}


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and not n.startswith("_") and n not in _HELPERS and getattr(f, "__module__", "") == __name__}
