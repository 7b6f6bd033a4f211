"""Mappings against labels: verdicts, losses, metrics, gates, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(truth: Column, found: Column) -> Column:
    return (
        F.when(truth.isNull() & found.isNull(), "TN")
        .when(truth.isNull(), "FP")
        .when(found.isNull(), "FN")
        .when(truth == found, "TP")
        .otherwise("WRONG_TARGET")
    )


def score_columns(labels: DataFrame, mappings: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """Each labelled column's verdict and loss.

    ``labels``: keys, truth, is_hard, confidence_floor, check (``cents``, ``date``
    or null); ``mappings``: keys, target, confidence, expression.  A labelled
    column that isn't mapped counts as (null, 0, ""); ``only`` restricts to keys.
    """
    if only is not None:
        labels = labels.join(only, keys, "left_semi")
    rows = labels.join(mappings, keys, "left")
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("expression", F.coalesce("expression", F.lit("")))
    rows = rows.withColumn("verdict", verdict(F.col("truth"), F.col("target")))
    correct = F.col("verdict").isin("TP", "TN")
    good = F.when(F.col("check") == "cents", F.contains("expression", F.lit("/")) & F.contains("expression", F.lit("100"))).when(F.col("check") == "date", F.lower("expression").rlike("date"))
    rows = rows.withColumn("sql_ok", F.when((F.col("verdict") == "TP") & F.col("check").isNotNull(), good))
    rows = rows.withColumn("below_floor", F.col("target").isNotNull() & F.coalesce(F.col("confidence") < F.col("confidence_floor"), F.lit(False)))
    gap = F.col("confidence") - correct.cast("int")
    rows = rows.withColumn("calibration", F.bround(gap * gap, 4))
    loss = F.when(F.col("is_hard"), 2.0).otherwise(1.0) * ((~correct).cast("int") + 0.3 * F.col("calibration") + F.coalesce(~F.col("sql_ok"), F.lit(False)).cast("int"))
    return rows.withColumn("loss", F.bround(loss, 4))


def score_missing(labelled: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled and detected missing fields (keys, field), and whether they agree."""
    a, b = labelled.withColumn("in_labels", F.lit(True)), detected.withColumn("found", F.lit(True))
    rows = a.join(b, [*keys, "field"], "full_outer")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(*keys, "field", yes("in_labels").alias("in_labels"), yes("found").alias("found"), (yes("in_labels") == yes("found")).alias("agree"))


def _share(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty))


def metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, precision, recall, F1, the same over hard columns, losses and rates, by ``keys``."""
    of = lambda v, hard=False: F.count_if((F.col("verdict") == v) & (F.col("is_hard") if hard else F.lit(True)))
    counts = scored.groupBy(*keys).agg(
        F.count("*").alias("columns"), of("TP").alias("tp"), of("TN").alias("tn"), of("FP").alias("fp"), of("FN").alias("fn"), of("WRONG_TARGET").alias("wrong"),
        of("TP", True).alias("hard_tp"), (of("FP", True) + of("WRONG_TARGET", True)).alias("hard_fp"), of("FN", True).alias("hard_fn"),
        F.count_if("below_floor").alias("below_floor"), F.bround(F.avg("loss"), 4).alias("mean_loss"),
        F.count_if("sql_ok").alias("sql_ok"), F.count("sql_ok").alias("sql_checked"),
    )
    c = F.col
    rows = counts.withColumn("p", _share(c("tp"), c("tp") + c("fp") + c("wrong"))).withColumn("r", _share(c("tp"), c("tp") + c("fn") + c("wrong")))
    rows = rows.withColumn("hp", _share(c("hard_tp"), c("hard_tp") + c("hard_fp"))).withColumn("hr", _share(c("hard_tp"), c("hard_tp") + c("hard_fn")))
    f1 = lambda p, r: F.bround(_share(2 * c(p) * c(r), c(p) + c(r)), 4)
    return rows.select(
        *keys, "columns", "tp", "tn", "fp", "fn", "wrong", F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"), f1("p", "r").alias("f1"),
        F.bround(_share(c("tn"), c("tn") + c("fp"), 1.0), 4).alias("left_out_accuracy"), F.bround("hp", 4).alias("hard_precision"), F.bround("hr", 4).alias("hard_recall"), f1("hp", "hr").alias("hard_f1"),
        "below_floor", "mean_loss", F.bround(_share(c("sql_ok"), c("sql_checked"), 1.0), 4).alias("sql_rate"),
    )


def gate(measured: DataFrame, min_f1: float | None = None, max_loss: float | None = None) -> DataFrame:
    """Add ``passed``: F1 not below and mean loss not above the limits."""
    ok = F.lit(True)
    if min_f1 is not None:
        ok = ok & (F.col("f1") >= min_f1)
    if max_loss is not None:
        ok = ok & (F.col("mean_loss") <= max_loss)
    return measured.withColumn("passed", ok)


def write_back(history: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """A new snapshot of the history with verdicts by ``keys``; others stay as they were."""
    rows = history.join(verdicts.select(*keys, F.col("verdict").alias("new")), keys, "left")
    return rows.withColumn("verdict", F.coalesce("new", "verdict")).drop("new")
