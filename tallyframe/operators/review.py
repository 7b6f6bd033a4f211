"""Review decisions as data: tiers, automatic review, decisions, status, final lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import broadcast_counted

TABLE = ["source_name", "table_name"]

AUTO, FLAGGED, ACCEPT = 0.85, 0.50, 0.70


def tier(confidence: Column) -> Column:
    return F.when(confidence >= AUTO, "auto").when(confidence >= FLAGGED, "flagged").otherwise("low")


def auto_review(mapped: DataFrame) -> DataFrame:
    """Accept targets at 0.70 or more; skip the rest, whose columns go to the extended attributes."""
    good = F.col("target").isNotNull() & (F.col("confidence") >= ACCEPT)
    return mapped.select("*", tier(F.col("confidence")).alias("tier"), F.when(good, "accepted").otherwise("skipped").alias("action"), F.when(good, F.col("target")).alias("approved_target"))


def auto_missing(missing: DataFrame) -> DataFrame:
    """Missing required fields are filled with NULL."""
    return missing.withColumn("resolution", F.lit("NULL"))


def apply_decisions(mapped: DataFrame, decisions: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """accept / modify / skip by ``keys``; a modification to an unknown field is refused and stays pending."""
    known = fields.select(F.col("name").alias("new_target"), F.lit(True).alias("known")).distinct()
    chosen = decisions.join(broadcast_counted(known), "new_target", "left")
    chosen = chosen.where((F.col("decision") != "modify") | F.col("known")).drop("known")
    rows = mapped.join(chosen, keys, "left")
    target = F.when(F.col("decision") == "accept", F.col("target")).when(F.col("decision") == "modify", F.col("new_target"))
    method = F.when(F.col("decision") == "modify", "manual").otherwise(F.col("method"))
    return rows.select(*keys, "confidence", F.coalesce("decision", F.lit("pending")).alias("decision"), target.alias("approved_target"), method.alias("method"))


def status(decided: DataFrame, open_contests: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: columns, decided, pending, contests without an answer, and whether it can be finalised."""
    by = decided.groupBy(*keys).agg(F.count("*").alias("columns"), F.count_if(F.col("decision") == "pending").alias("pending"))
    still = open_contests.groupBy(*keys).agg(F.count("*").alias("contests"))
    rows = by.join(still, keys, "left").withColumn("contests", F.coalesce("contests", F.lit(0)).cast("long"))
    return rows.withColumn("ready", (F.col("pending") == 0) & (F.col("contests") == 0))


def finalise(decided: DataFrame, states: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Approved mappings of what is ready; columns without a target are extended attributes."""
    rows = decided.join(states.where("ready").select(*keys), keys, "left_semi")
    return rows.select(*keys, column, "approved_target", F.col("approved_target").isNull().alias("extended"))


def extended_columns(decided: DataFrame, unmapped: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """(source_name, table_name, column_name, place): columns for the extended attributes, each once, at its first place.

    First the unmapped ones, then those decided without a target, then those that a
    reviewer keeps beside their mapping; by ``ordinal`` within each.
    """
    own = [*TABLE, "column_name", "ordinal"]
    parts = [decided.where("approved_target is null").select(*own, F.lit(1).alias("part"))]
    parts += [df.select(*own, F.lit(k).alias("part")) for k, df in ((0, unmapped), (2, kept)) if df is not None]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*TABLE, "column_name").agg(F.min(F.struct("part", "ordinal")).alias("place"))


def definitions(decided: DataFrame, states: DataFrame, missing: DataFrame, *, resolutions: DataFrame | None = None, unmapped: DataFrame | None = None, kept: DataFrame | None = None, reviewer: str = "", profile_hash: str = "") -> DataFrame:
    """A mapping definition for each table that is ready: one nested row, to be stored as a document.

    ``decided``: source_name, table_name, column_name, ordinal, approved_target,
    expression, confidence, method, decision; ``states`` of :func:`status` by
    table; ``missing``: field; ``resolutions``: field, kind, value (fields without
    one are filled with NULL); ``unmapped`` and ``kept``: column_name, ordinal.
    Lists stand in order: mappings and columns by ordinal, resolutions by field.
    """
    ready = states.where("ready").select(*TABLE)
    inside = lambda df: None if df is None else df.join(ready, TABLE, "left_semi")
    listed = lambda by, *columns: F.transform(F.array_sort(F.collect_list(F.struct(*by, F.struct(*columns).alias("_row")))), lambda r: r["_row"])
    own = inside(decided)
    approved = own.groupBy(*TABLE).agg(listed(["ordinal", "approved_target"], F.col("column_name").alias("source_column"), F.col("approved_target").alias("target_field"), F.col("expression").alias("sql_expression"), "confidence", "method", F.col("decision").alias("reviewer_action")).alias("approved_mappings"))
    extra = extended_columns(own, inside(unmapped), inside(kept)).groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name"))), lambda r: r["column_name"]).alias("extended_attributes"))
    filled = auto_missing(inside(missing))
    if resolutions is not None:
        given = inside(resolutions).select(*TABLE, "field", "kind", "value")
        filled = filled.join(given, [*TABLE, "field"], "full_outer")
    else:
        filled = filled.withColumn("kind", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("string"))
    filled = filled.withColumn("resolution", F.coalesce("kind", "resolution"))
    fills = filled.groupBy(*TABLE).agg(listed(["field"], F.col("field").alias("target_field"), "resolution", F.when(F.col("resolution") == "HARDCODED", F.col("value")).alias("hardcoded_value"), F.when(F.col("resolution") == "DERIVED", F.col("value")).alias("derivation_sql")).alias("missing_field_resolutions"))
    rows = ready.join(approved, TABLE, "left").join(extra, TABLE, "left").join(fills, TABLE, "left")
    return rows.select(*TABLE, "approved_mappings", "extended_attributes", "missing_field_resolutions", F.lit(reviewer).alias("reviewer_identity"), F.current_timestamp().alias("reviewed_at"), F.lit(profile_hash).alias("profile_hash"))


def upsert(history: DataFrame, reviewed: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Set ``column`` of matching rows by ``keys``, and insert reviewed rows that match nothing."""
    new = reviewed.select(*keys, F.col(column).alias("_new"))
    kept = history.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    added = reviewed.join(history.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)
