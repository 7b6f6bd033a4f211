"""Column-to-target mapping: scores, best field, contention, and what is missing.

Columns come as profile rows (source_name, table_name, column_name, ordinal,
inferred_type, date_format, is_id, is_coded, is_cents, samples) and targets as
the field table of :mod:`tallyframe.plans.canonical`.  Field tables grow with the
introspected targets, so they are counted before they are broadcast; names are
compared once for each distinct pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import transforms
from ..functions.checkpoints import broadcast_counted
from . import rowshape
from ..functions.similarity import field_name, ratio, token_set_ratio
from .profile import ID_ENDING

# Weights and thresholds; the scores of types and patterns stand in their functions.
WEIGHTS = (0.65, 0.25, 0.10)
NO_MATCH = 0.30
LOW_CONFIDENCE = 0.70
TIE = 0.05
PREFIX = r"^([A-Z]{2,5}-)"

KEYS = ["source_name", "table_name", "column_name"]


def split_metadata(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns to be mapped, and those left out because change capture wrote them."""
    meta = F.col("column_name").rlike("(?i)^_CDC_")
    return columns.where(~meta), columns.where(meta)


def resolve_schema(tables: DataFrame, static: DataFrame, dynamic: DataFrame | None = None) -> DataFrame:
    """Add ``schema_key``: registered at run time, else declared, else ``policy``."""
    out = tables.join(broadcast_counted(static.select("table_name", F.col("schema_key").alias("declared"))), "table_name", "left")
    own = F.lit(None).cast("string")
    if dynamic is not None:
        out = out.join(broadcast_counted(dynamic.select("table_name", F.col("schema_key").alias("registered"))), "table_name", "left")
        own = F.col("registered")
    return out.withColumn("schema_key", F.coalesce(own, "declared", F.lit("policy"))).drop("declared", "registered")


def name_scores(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """(column_name, schema_key, field, name_score): the best of a field's names, for distinct names."""
    left = columns.select("column_name", "schema_key").distinct().withColumn("a", field_name(F.col("column_name")))
    names = fields.select("schema_key", F.col("name").alias("field"), F.explode("names").alias("n")).withColumn("b", field_name(F.col("n"))).drop("n").distinct()
    pairs = left.join(broadcast_counted(names), "schema_key")
    distinct = pairs.select("a", "b").distinct().withColumn("s", F.greatest(ratio(F.col("a"), F.col("b")), token_set_ratio(F.col("a"), F.col("b"))))
    return pairs.join(distinct, ["a", "b"]).groupBy("column_name", "schema_key", "field").agg(F.max("s").alias("name_score"))


def type_score(source: Column, target: Column, is_id: Column, is_coded: Column, date_format: Column) -> Column:
    # The score of each pair of types.
    pair = F.concat_ws(">", source, target)
    return (
        F.when(source == target, 1.0)
        .when(pair == "integer>decimal", 0.85)
        .when(pair == "integer>bigint", 0.90)
        .when(pair == "decimal>integer", 0.60)
        .when(pair == "string>integer", F.when(is_id, 0.75).otherwise(0.40))
        .when(pair == "string>bigint", F.when(is_id, 0.70).otherwise(0.35))
        .when(pair == "string>date", F.when(date_format.isNotNull(), 0.70).otherwise(0.25))
        .when(pair == "string>boolean", F.when(is_coded, 0.75).otherwise(0.30))
        .when(pair == "boolean>string", 0.60)
        .when(pair == "integer>string", 0.50)
        .otherwise(0.20)
    )


def pattern_score(name: Column, target: Column) -> Column:
    ends = lambda p: name.rlike(rf"(?i)({p})$")
    return (
        F.when((target == "date") & ends("_DT|_DATE|_DAT"), 1.0)
        .when((target == "decimal") & ends("_AMT|_PREM|_LIM|_DED|_VAL|_REV"), 1.0)
        .when(target.isin("integer", "bigint") & name.rlike(ID_ENDING), 1.0)
        .when((target == "boolean") & ends("_FLG|_FLAG|_IND"), 1.0)
        .when((target == "string") & ends("_CD|_CODE|_STAT|_TYP|_TYPE"), 0.5)
        .otherwise(0.0)
    )


def scores(columns: DataFrame, fields: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Every column against every field of its schema: three scores and the confidence.

    ``weights`` may give (source_name, wa, wb, wc); a null source is the default.
    """
    named = columns.join(name_scores(columns, fields), ["column_name", "schema_key"])
    target = fields.select("schema_key", F.col("name").alias("field"), F.col("ordinal").alias("field_ordinal"), "target_type", "required", "secondary")
    rows = named.join(broadcast_counted(target), ["schema_key", "field"])
    rows = rows.withColumn("type_score", type_score(F.col("inferred_type"), F.col("target_type"), F.col("is_id"), F.col("is_coded"), F.col("date_format")))
    rows = rows.withColumn("pattern_score", pattern_score(F.col("column_name"), F.col("target_type")))
    wa, wb, wc = (F.lit(w) for w in WEIGHTS)
    if weights is not None:
        general = weights.where("source_name is null").limit(1).select(*(F.col(c).alias(f"g{c}") for c in ("wa", "wb", "wc")))
        rows = rows.join(broadcast_counted(weights.where("source_name is not null")), "source_name", "left").join(F.broadcast(general), F.lit(True), "left")
        wa, wb, wc = (F.coalesce(f"w{k}", f"gw{k}", d) for k, d in zip("abc", (wa, wb, wc), strict=True))
    confidence = F.least(F.lit(1.0), wa * F.col("name_score") + wb * F.col("type_score") + wc * F.col("pattern_score"))
    return rows.withColumn("confidence", confidence).drop("wa", "wb", "wc", "gwa", "gwb", "gwc")


def best_field(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each column's best field, ties to the first declared; below the floor the target is null."""
    order = Window.partitionBy(*(keys or KEYS)).orderBy(F.col("confidence").desc(), "field_ordinal")
    best = scored.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    rounded = [F.bround(c, 4).alias(c) for c in ("name_score", "type_score", "pattern_score")]
    target = F.when(F.col("confidence") >= NO_MATCH, F.col("field"))
    return best.select(*[c for c in best.columns if c not in ("name_score", "type_score", "pattern_score", "confidence", "field")], *rounded, F.bround("confidence", 4).alias("confidence"), target.alias("target"))


def top_fields(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k fields whose names come nearest to each column's."""
    order = Window.partitionBy(*KEYS).orderBy(F.col("name_score").desc(), "field_ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*KEYS, "rank", "field", F.bround("name_score", 4).alias("name_score"))


def sample_prefix(samples: Column) -> Column:
    """The one prefix like ``ABC-`` that at least half of the samples bear, else null."""
    found = F.filter(F.transform(samples, lambda s: F.regexp_extract(s, PREFIX, 1)), lambda p: p != "")
    kinds = F.array_distinct(found)
    return F.when((F.size(samples) > 0) & (2 * F.size(found) >= F.size(samples)) & (F.size(kinds) == 1), F.get(kinds, F.lit(0)))


def with_transform(best: DataFrame) -> DataFrame:
    """Add the transform's name and its Spark SQL text."""
    truth = (F.size("samples") > 0) & F.forall("samples", lambda s: F.lower(s).isin("true", "false"))
    rows = best.withColumn("prefix", sample_prefix(F.col("samples"))).withColumn("truth", truth)
    kind = transforms.kind_of(F.col("target_type"), F.col("inferred_type"), F.col("date_format"), F.col("is_id"), F.col("is_cents"), F.col("prefix"), F.col("truth"))
    rows = rows.withColumn("transform", F.when(F.col("target").isNull(), "blank_as_null").otherwise(kind))
    return rows.withColumn("expression", transforms.expression(F.col("transform"), F.col("column_name"), F.col("prefix"))).drop("truth")


def low_confidence(best: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    return best.where(F.col("confidence") < threshold)


def merge_suggestions(best: DataFrame, suggestions: DataFrame, fields: DataFrame, *, strict: bool = True) -> DataFrame:
    """Take a suggested target where it is more confident than the rule.

    ``suggestions``: keys, s_target, s_confidence.  An unknown target becomes
    null; a low-confidence column that was asked for and left out is a null
    target at 0.30.
    """
    known = fields.select("schema_key", F.col("name").alias("s_target"), F.lit(True).alias("known"))
    rows = best.join(suggestions, KEYS, "left").join(broadcast_counted(known), ["schema_key", "s_target"], "left")
    confidence = F.when(F.col("confidence") < LOW_CONFIDENCE, F.coalesce("s_confidence", F.lit(NO_MATCH))).otherwise(F.col("s_confidence"))
    better = F.coalesce((confidence > F.col("confidence")) if strict else (confidence >= F.col("confidence")), F.lit(False))
    rows = rows.withColumn("better", better).withColumn("s_confidence", confidence)
    target = F.when(F.col("better"), F.when(F.col("known"), F.col("s_target"))).otherwise(F.col("target"))
    out = rows.withColumn("method", F.when(F.col("better"), "suggested").otherwise("rule")).withColumn("target", target)
    return out.withColumn("confidence", F.when(F.col("better"), F.col("s_confidence")).otherwise(F.col("confidence"))).drop("s_target", "s_confidence", "known", "better")


def merge_overrides(mapped: DataFrame, overrides: DataFrame) -> DataFrame:
    """A reviewer's new targets (keys, o_target); texts that mean null become null, confidence stays."""
    rows = mapped.join(overrides.withColumn("hit", F.lit(True)), KEYS, "left")
    new = F.when(F.lower(F.trim("o_target")).isin("", "null", "none", "extended_attributes"), None).otherwise(F.col("o_target"))
    return rows.withColumn("target", F.when(F.col("hit"), new).otherwise(F.col("target"))).withColumn("method", F.when(F.col("hit"), "critic").otherwise(F.col("method"))).drop("hit", "o_target")


def review_selection(mapped: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns to be reviewed: labelled hard, or below their floor. ``labels``: keys, is_hard, confidence_floor."""
    rows = mapped.join(labels, KEYS)
    return rows.where(F.col("is_hard") | (F.col("confidence") < F.col("confidence_floor")))


def repair_expressions(mapped: DataFrame, given: DataFrame) -> DataFrame:
    """Supplied expressions (keys, new_expression) for overridden or bare columns, if they name the column."""
    rows = mapped.join(given, KEYS, "left")
    wants = F.col("target").isNotNull() & ((F.col("method") == "critic") | (F.col("transform") == "blank_as_null"))
    good = F.coalesce((F.trim("new_expression") != "") & F.contains("new_expression", "column_name"), F.lit(False))
    return rows.withColumn("expression", F.when(wants & good, F.col("new_expression")).otherwise(F.col("expression"))).drop("new_expression")


def suppress(mapped: DataFrame, sourceless: DataFrame) -> DataFrame:
    """Null the targets that the catalog says no source column feeds: (source_name, table_name, target)."""
    rows = mapped.join(sourceless.withColumn("gone", F.lit(True)), ["source_name", "table_name", "target"], "left")
    return rows.withColumn("note", F.when(F.col("gone"), "target has no source")).withColumn("target", F.when(F.col("gone").isNull(), F.col("target"))).drop("gone")


def contention(mapped: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One column for each target.

    By falling confidence (ties by ``ordinal``): a clear first keeps the target; at
    a near tie the runner-up takes the field's other target, if there is one, and
    else the first keeps it provisionally and the target is contested.  The rest
    are demoted; their expressions stay.  Adds ``action``, ``final_target`` and
    ``reason``.
    """
    part = [*(keys or ["source_name", "table_name"]), "target"]
    order = Window.partitionBy(*part).orderBy(F.col("confidence").desc(), "ordinal")
    whole = Window.partitionBy(*part)
    rows = mapped.withColumn("place", F.row_number().over(order)).withColumn("second", F.max(F.when(F.col("place") == 2, F.col("confidence"))).over(whole))
    rows = rows.withColumn("first", F.max(F.when(F.col("place") == 1, F.col("confidence"))).over(whole))
    near = F.coalesce(F.bround(F.col("first") - F.col("second"), 10) < TIE, F.lit(False))
    action = (
        F.when(F.col("target").isNull(), "unmapped")
        .when((F.col("place") == 1) & near & F.col("secondary").isNull(), "contested")
        .when(F.col("place") == 1, "kept")
        .when((F.col("place") == 2) & near & F.col("secondary").isNotNull(), "promoted")
        .otherwise("demoted")
    )
    rows = rows.withColumn("action", action)
    final = F.when(F.col("action").isin("kept", "contested"), F.col("target")).when(F.col("action") == "promoted", F.col("secondary"))
    winner = F.max(F.when(F.col("place") == 1, F.col("column_name"))).over(whole)
    reason = (
        F.when(F.col("action") == "demoted", F.concat(F.lit("target taken by "), winner))
        .when(F.col("action") == "promoted", F.concat(F.lit("near tie with "), winner, F.lit(", moved to "), F.col("secondary")))
        .when(F.col("action") == "contested", F.lit("near tie, kept until decided"))
    )
    return rows.withColumn("final_target", final).withColumn("reason", reason).drop("place", "first", "second")


def contests(contended: DataFrame) -> DataFrame:
    """The contested targets with all their columns, best first, and the provisional winner."""
    keys = ["source_name", "table_name", "target"]
    open_targets = contended.where("action = 'contested'").select(*keys, F.col("column_name").alias("provisional"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "ordinal", "column_name", "confidence")))
    listed = contended.join(open_targets, keys).groupBy(*keys, "provisional").agg(ranked.alias("r"))
    return listed.select(*keys, "provisional", F.transform("r", lambda x: x["column_name"]).alias("columns"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["column_name"], x["confidence"]))).alias("confidences"))


def decide_contests(contended: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (source_name, table_name, target, winner); a winner that didn't compete changes nothing."""
    keys = ["source_name", "table_name", "target"]
    rivals = contended.where("action in ('contested', 'demoted')").select(*keys, F.col("column_name").alias("winner"))
    valid = decisions.join(contended.where("action = 'contested'").select(*keys), keys, "left_semi").join(rivals, [*keys, "winner"], "left_semi")
    rows = contended.join(valid, keys, "left")
    won = F.col("column_name") == F.col("winner")
    decided = F.col("winner").isNotNull() & F.col("action").isin("contested", "demoted")
    return rows.withColumn("final_target", F.when(decided, F.when(won, F.col("target"))).otherwise(F.col("final_target"))).withColumn("action", F.when(decided, F.when(won, "kept").otherwise("demoted")).otherwise(F.col("action"))).drop("winner")


def missing_required(tables: DataFrame, fields: DataFrame, contended: DataFrame) -> DataFrame:
    """Required fields of each table's schema that no column maps to. ``tables``: source_name, table_name, schema_key."""
    wanted = tables.join(broadcast_counted(fields.where("required")), "schema_key").select("source_name", "table_name", F.col("name").alias("field"), "ordinal")
    got = contended.where("final_target is not null").select("source_name", "table_name", F.col("final_target").alias("field"))
    return wanted.join(got, ["source_name", "table_name", "field"], "left_anti")


def map_columns(columns: DataFrame, fields: DataFrame, *, weights: DataFrame | None = None, suggestions: DataFrame | None = None, overrides: DataFrame | None = None, expressions: DataFrame | None = None, sourceless: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """Profiles to decided mappings, in one plan.

    Exclusion, scores, best field, transform, suggestions, overrides, repaired
    expressions, suppression, contention and its decisions, in this order; the
    tables of outside decisions are all optional.
    """
    usable, _ = split_metadata(columns)
    best = with_transform(best_field(scores(usable, fields, weights)))
    mapped = merge_suggestions(best, suggestions, fields) if suggestions is not None else best.withColumn("method", F.lit("rule"))
    if overrides is not None:
        mapped = merge_overrides(mapped, overrides)
    if expressions is not None:
        mapped = repair_expressions(mapped, expressions)
    if sourceless is not None:
        mapped = suppress(mapped, sourceless)
    decided = contention(mapped)
    return decide_contests(decided, decisions) if decisions is not None else decided


def map_catalog(columns: DataFrame, fields: DataFrame, **tables: DataFrame) -> DataFrame:
    """Everything that a mapping run returns, one row for each finding, for all tables at once.

    ``columns`` also has row_count, null_rate and exact_distinct.  Returns
    (source_name, table_name, kind, name, detail): ``mapped`` columns with their
    targets, ``unmapped`` columns, ``excluded`` ones, ``missing`` required
    fields, ``contested`` targets with their provisional winners, and the row
    shape's ``key``.
    """
    decided = map_columns(columns, fields, **tables)
    where = ["source_name", "table_name"]
    row = lambda df, kind, name, detail: df.select(*where, F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    shapes = rowshape.infer(columns).join(columns.select(*where).distinct(), "table_name")
    parts = [
        row(decided.where("final_target is not null"), "mapped", F.col("column_name"), F.col("final_target")),
        row(decided.where("final_target is null"), "unmapped", F.col("column_name"), F.col("reason")),
        row(split_metadata(columns)[1], "excluded", F.col("column_name"), none),
        row(missing_required(columns.select(*where, "schema_key").distinct(), fields, decided), "missing", F.col("field"), none),
        row(contests(decided), "contested", F.col("target"), F.col("provisional")),
        row(shapes, "key", F.col("natural_key"), F.col("strategy")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
