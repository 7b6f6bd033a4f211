"""Row shape: natural key, recency column and how to keep one row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def infer(columns: DataFrame) -> DataFrame:
    """One row per table from its profile rows.

    Uncapped distinct counts are used, so that the share of distinct values can
    reach 1 in tables of any size.
    """
    name = F.upper(F.col("column_name"))
    filled = F.col("row_count") > 0
    key_score = 0.6 * F.when(filled, F.col("exact_distinct") / F.col("row_count")).otherwise(0.0) + 0.2 * (1 - F.col("null_rate")) + 0.2 * F.col("is_id").cast("int")
    captured = name.rlike("CDC|OPERATION")
    recency = F.when(F.col("is_id") & (F.col("inferred_type") == "integer") & name.rlike("SEQ|VER|REV"), 0.9).when(captured, 0.85).when(F.col("inferred_type") == "date", 0.5)
    rows = columns.withColumn("key_score", key_score).withColumn("captured", captured).withColumn("recency_score", recency)
    by_key = Window.partitionBy("table_name").orderBy(F.col("key_score").desc(), "ordinal")
    rows = rows.withColumn("is_key", F.row_number().over(by_key) == 1)
    score = F.when(~F.col("is_key"), F.col("recency_score"))
    out = rows.groupBy("table_name").agg(
        F.max(F.when(F.col("is_key"), F.col("column_name"))).alias("natural_key"),
        F.max(F.when(F.col("is_key"), F.col("key_score"))).alias("key_score"),
        F.max(F.when(F.col("is_key"), F.col("exact_distinct") == F.col("row_count"))).alias("unique_key"),
        F.max_by(F.when(score.isNotNull(), F.col("column_name")), F.when(score.isNotNull(), F.struct(score, -F.col("ordinal")))).alias("recency_column"),
        F.bool_or("captured").alias("captured"),
    )
    strategy = F.when(F.col("captured"), "cdc_latest").when(F.col("recency_column").isNotNull(), "row_number").when(F.col("unique_key"), "none").otherwise("row_number")
    out = out.withColumn("strategy", strategy)
    confidence = F.least(F.col("key_score"), F.lit(1.0)) * 0.6 + F.when(F.col("recency_column").isNotNull(), 0.3).otherwise(0.0) + F.when((F.col("strategy") == "none") & F.col("unique_key"), 0.1).otherwise(0.0)
    return out.select("table_name", "natural_key", "recency_column", "strategy", F.bround(F.least(F.lit(1.0), confidence), 3).alias("confidence"))


def latest_rows(df: DataFrame, key: list[str], recency: list[str]) -> DataFrame:
    """The latest row of each key by falling recency; name a tie-break last to have one answer.

    Rows are first reduced to a maximum inside each task, so a key with many
    rows costs no more than others.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*recency)).alias("row"))
    return best.select(*key, *[F.col(f"row.{c}").alias(c) for c in rest]).select(df.columns)


def latest_change(df: DataFrame, key: list[str], changed: str, tie: str) -> DataFrame:
    """Change capture: the row with the last change for each (possibly composite) key; deletes stay as rows."""
    return latest_rows(df, key, [changed, tie])


def score(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Loss of inferred shapes against (table_name, t_key, t_recency, t_strategy), case aside."""
    same = lambda a, b: F.coalesce(F.lower(a) == F.lower(b), F.col(a).isNull() & F.col(b).isNull())
    rows = truth.join(found, "table_name", "left")
    loss = 0.5 * (~same("natural_key", "t_key")).cast("int") + 0.3 * (~same("recency_column", "t_recency")).cast("int") + 0.2 * (~same("strategy", "t_strategy")).cast("int")
    return rows.select("table_name", same("natural_key", "t_key").alias("key_ok"), same("recency_column", "t_recency").alias("recency_ok"), same("strategy", "t_strategy").alias("strategy_ok"), F.bround(loss, 4).alias("loss"))


__all__ = ["infer", "latest_change", "latest_rows", "score"]
