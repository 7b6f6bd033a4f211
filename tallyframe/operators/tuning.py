"""Tuning of the rule weights, curation and retrieval of examples, tool usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoint_dir
from ..functions.similarity import field_similarity
from . import mapping, scoring

# The thresholds of the sweep.
THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)


def simplex(spark: SparkSession, steps: int = 20) -> DataFrame:
    """(point, wa, wb, wc): all weights that add up to 1 in ``steps`` steps, in order."""
    a = spark.range(steps + 1).select(F.col("id").alias("i"))
    rows = a.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps) - F.col("i"))).alias("j"))
    point = (F.col("i") * (2 * steps + 3 - F.col("i")) / 2 + F.col("j")).cast("int")
    return rows.select(point.alias("point"), (F.col("i") / steps).alias("wa"), (F.col("j") / steps).alias("wb"), ((steps - F.col("i") - F.col("j")) / steps).alias("wc"))


def grid_metrics(scored: DataFrame, grid: DataFrame, labels: DataFrame) -> DataFrame:
    """Every point's metrics: best field and contention again, scores as they are.

    The three scores don't depend on the weights and are computed once; the grid
    is a few hundred rows and is broadcast.
    """
    rows = scored.drop("confidence").join(F.broadcast(grid), F.lit(True))
    rows = rows.withColumn("confidence", F.least(F.lit(1.0), F.col("wa") * F.col("name_score") + F.col("wb") * F.col("type_score") + F.col("wc") * F.col("pattern_score")))
    best = mapping.best_field(rows, ["point", *mapping.KEYS])
    decided = mapping.contention(best, ["point", "source_name", "table_name"])
    found = decided.select("point", *mapping.KEYS, F.col("final_target").alias("target"), "confidence", F.lit("").alias("expression"))
    wanted = labels.join(F.broadcast(grid.select("point")), F.lit(True))
    return scoring.metrics(scoring.score_columns(wanted, found, ["point", *mapping.KEYS]), ["point"])


def ranked_points(measured: DataFrame, k: int) -> DataFrame:
    """The k best points by mean loss, then F1; ties in grid order."""
    return measured.orderBy("mean_loss", F.col("f1").desc(), "point").limit(k)


def better_than(measured: DataFrame, current: Column) -> DataFrame:
    return measured.where(F.col("mean_loss") < current)


def threshold_sweep(mappings: DataFrame) -> DataFrame:
    """How many columns each threshold would send on."""
    limits = F.array(*[F.lit(t) for t in THRESHOLDS])
    rows = mappings.select(F.explode(limits).alias("threshold"), "confidence")
    return rows.groupBy("threshold").agg(F.count_if(F.col("confidence") < F.col("threshold")).alias("routed"), F.count("*").alias("columns"))


def qualifying(history: DataFrame, labels: DataFrame) -> DataFrame:
    """The newest row of each column that is hard and TP, or decided by the critic and accepted."""
    keys = ["source_name", "source_column"]
    rows = history.join(labels.select(*keys, "is_hard"), keys, "left")
    hard = F.coalesce(F.col("is_hard"), F.lit(False)) & (F.col("verdict") == "TP")
    critic = (F.col("method") == "critic") & F.col("reviewer_action").isin("accepted", "auto_approved")
    origin = F.when(hard, "hard_case").when(critic, "critic_accepted")
    rows = rows.withColumn("origin", origin).where("origin is not null")
    kept = [c for c in ("id", "target_field", "origin", "profile_signature", "recorded_at")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct("recorded_at", "id")).alias("r")).select(*keys, "r.*")


def curate(history: DataFrame, labels: DataFrame, active: DataFrame) -> DataFrame:
    """New examples: the qualifying row of each column, with the reason.

    Columns that have an active example, or whose row has no signature, are left out.
    """
    keys = ["source_name", "source_column"]
    return qualifying(history, labels).where("profile_signature is not null").join(active.select(*keys), keys, "left_anti")


def curation_counts(history: DataFrame, labels: DataFrame, active: DataFrame) -> DataFrame:
    """One row: hard cases and critic decisions added, columns skipped for an active example, and for want of a signature."""
    keys = ["source_name", "source_column"]
    newest = qualifying(history, labels)
    rows = newest.join(active.select(*keys).distinct().withColumn("has", F.lit(True)), keys, "left")
    held = F.coalesce(F.col("has"), F.lit(False))
    signed = F.col("profile_signature").isNotNull()
    return rows.agg(*[F.count_if(c).alias(n) for n, c in (("added_hard", ~held & signed & (F.col("origin") == "hard_case")), ("added_critic", ~held & signed & (F.col("origin") == "critic_accepted")), ("skipped_existing", held), ("skipped_no_signature", ~held & ~signed))])


FLAGS = ["inferred_type", "is_id", "is_coded", "is_cents", "date_format"]


def similar_examples(columns: DataFrame, examples: DataFrame, *, floor: float = 0.35, k: int = 3, watch: list | None = None) -> DataFrame:
    """The k nearest examples of the same source: half by equal flags, half by name; ties by name of the example.

    Without its name a pair's similarity is at most half the share of equal flags
    and a half.  So columns meet the examples that share all flags first, then those
    that share one less, and so on; a column goes on only while that bound reaches
    its k-th best so far (and the floor).  Flags are matched by their few
    combinations, and names are compared only for pairs that meet.  ``watch``, if
    given, gets the number of pairs compared at each step.
    """
    ensure_checkpoint_dir(columns.sparkSession)
    key = ["source_name", "table_name", "column_name"]
    combo = F.to_json(F.struct(*FLAGS), {"ignoreNullFields": "false"})
    left = columns.select(*key, combo.alias("combo"), *FLAGS).checkpoint()
    right = examples.select("source_name", F.col("source_column").alias("example"), combo.alias("e_combo"), *[F.col(f).alias(f"e_{f}") for f in FLAGS]).distinct().checkpoint()
    kinds = left.select("source_name", "combo", *FLAGS).distinct().join(right.select("source_name", "e_combo", *[f"e_{f}" for f in FLAGS]).distinct(), "source_name")
    equal = sum(F.col(f).eqNullSafe(F.col(f"e_{f}")).cast("int") for f in FLAGS)
    kinds = kinds.select("source_name", "combo", "e_combo", equal.alias("equal")).checkpoint()
    order = Window.partitionBy(*key).orderBy(F.col("similarity").desc(), "example")
    open_, best = left.select(*key, "combo"), None
    for level in range(len(FLAGS), -1, -1):
        bound = 0.5 * level / len(FLAGS) + 0.5
        if bound < floor:
            break
        met = open_.join(kinds.where(F.col("equal") == level), ["source_name", "combo"]).join(right.select("source_name", "e_combo", "example"), ["source_name", "e_combo"]).where(F.col("column_name") != F.col("example"))
        scored = met.withColumn("similarity", F.bround(0.5 * F.col("equal") / 5 + 0.5 * field_similarity(F.col("column_name"), F.col("example")), 4)).select(*key, "example", "similarity").checkpoint()
        if watch is not None:
            watch.append(scored.count())
        found = scored.where(F.col("similarity") >= floor)
        found = found if best is None else best.unionByName(found)
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank").checkpoint()
        full = best.groupBy(*key).agg(F.count("*").alias("c"), F.min("similarity").alias("worst")).where((F.col("c") >= k) & (F.col("worst") > bound - 0.5 / len(FLAGS)))
        open_ = open_.join(full, key, "left_anti").checkpoint()
        if open_.isEmpty():
            break
    return best.withColumn("rank", F.row_number().over(order)).select(*key, "rank", "example", "similarity")


def retire(examples: DataFrame, retired: DataFrame) -> DataFrame:
    """A new snapshot with (example_id, retire_reason) retired."""
    rows = examples.drop("retire_reason").join(retired, "example_id", "left")
    return rows.withColumn("status", F.when(F.col("retire_reason").isNotNull(), "retired").otherwise(F.col("status")))


def example_stats(examples: DataFrame) -> DataFrame:
    return examples.groupBy("origin", "status").agg(F.count("*").alias("n"))


def stratified_split(rows: DataFrame, key: list[str], stratum: str, share: float = 0.7, seed: int = 7) -> DataFrame:
    """Add ``part``: round(n * share) rows of each stratum train, in the order of a digest of the key.

    Counts by the digest's first four digits say in which of 65,536 buckets a
    stratum's boundary lies; only that bucket's rows are numbered.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    marked = rows.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 4))
    counts = marked.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(stratum).orderBy("_b")
    ends = counts.withColumn("_end", F.sum("_c").over(up)).withColumn("_want", F.bround(F.sum("_c").over(Window.partitionBy(stratum)) * share).cast("long"))
    ends = ends.where("_end - _c <= _want and _end > _want").select(F.col(stratum).alias("_s"), F.col("_b").alias("_edge"), (F.col("_want") - F.col("_end") + F.col("_c")).alias("_left"))
    placed = marked.join(F.broadcast(ends), F.col(stratum).eqNullSafe(F.col("_s")), "left")  # at most one row for each stratum
    number = F.row_number().over(Window.partitionBy(stratum).orderBy("_d", *key))
    at_edge = placed.where(F.col("_b") == F.col("_edge")).withColumn("part", F.when(number <= F.col("_left"), "train").otherwise("holdout"))
    others = placed.where(F.coalesce(F.col("_b") != F.col("_edge"), F.lit(True))).withColumn("part", F.when(F.coalesce(F.col("_b") < F.col("_edge"), F.lit(True)), "train").otherwise("holdout"))
    return others.unionByName(at_edge).select(*rows.columns, "part")


def diagnose(scored: DataFrame, calibration: float = 0.15) -> DataFrame:
    """Failures, and right answers with poor confidence (``fragile``)."""
    wrong = ~F.col("verdict").isin("TP", "TN")
    rows = scored.withColumn("fragile", ~wrong & (F.col("calibration") >= calibration))
    return rows.where(wrong | F.col("fragile"))


def regressions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that were right before and no longer are."""
    right = F.col("verdict").isin("TP", "TN")
    return before.where(right).select(*keys).join(after.where(right).select(*keys), keys, "left_anti")


def comparison(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: columns, regressed ones, mean losses, and whether the change is an improvement (a lower loss and none regressed)."""
    lost = regressions(before, after, keys).agg(F.count("*").alias("regressed"))
    mean = lambda df, name: df.agg(F.count("*").alias(f"{name}_columns"), F.avg("loss").alias(f"{name}_loss"))
    row = mean(before, "before").join(mean(after, "after"), F.lit(True)).join(lost, F.lit(True))
    return row.withColumn("improved", (F.col("after_loss") < F.col("before_loss")) & (F.col("regressed") == 0))


def repeat_variance(losses: DataFrame, keys: list[str]) -> DataFrame:
    return losses.groupBy(*keys).agg(F.bround(F.avg("loss"), 6).alias("mean"), F.bround(F.stddev_pop("loss"), 6).alias("stdev"), F.count("*").alias("runs"))


def latest_accepted(versions: DataFrame) -> DataFrame:
    """Each agent's newest accepted version; ties by the id."""
    return versions.where("accepted").groupBy("agent_name").agg(F.max_by("version_id", F.struct("accepted_at", "version_id")).alias("version_id"), F.max("accepted_at").alias("accepted_at"))


def usage_rows(calls: DataFrame, history: DataFrame) -> DataFrame:
    """One row per (run, column): the tools called, the first five calls in order, the number of calls, the verdict, the signature.

    No list of all calls is made: tools are a set, and first calls are ranked.
    """
    keys = ["run_id", "source_column"]
    own = calls.where("agent = 'mapping'")
    order = Window.partitionBy(*keys).orderBy("call_order", "tool_name")
    ranked = own.withColumn("place", F.row_number().over(order)).where("place <= 5")
    first = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tool_name"))), lambda s: s["tool_name"]).alias("first_tools"))
    per = own.groupBy(*keys).agg(F.array_sort(F.collect_set("tool_name")).alias("tools"), F.count("*").alias("calls")).join(first, keys)
    latest = history.groupBy(*keys).agg(F.max_by(F.struct("verdict", "signature"), F.struct("recorded_at", "id")).alias("h")).select(*keys, "h.*")
    return latest.join(per, keys, "left").select(*keys, "verdict", "signature", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tools", "first_tools")], F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


def tool_value(rows: DataFrame) -> DataFrame:
    """Accuracy with and without each tool within groups of one signature; both sides non-empty.

    Rows that called a tool are counted by tool; those that did not are the group's others.
    """
    scored = rows.where("verdict is not null").withColumn("ok", F.col("verdict").isin("TP", "TN").cast("double"))
    groups = scored.groupBy("signature").agg(F.count("*").alias("n"), F.sum("ok").alias("good")).where("n >= 2")
    called = scored.select("signature", "ok", F.explode("tools").alias("tool")).groupBy("signature", "tool").agg(F.count("*").alias("with_n"), F.sum("ok").alias("with_good"))
    out = called.join(groups, "signature").withColumn("without_n", F.col("n") - F.col("with_n")).where("without_n > 0")
    out = out.withColumn("a", F.col("with_good") / F.col("with_n")).withColumn("b", (F.col("good") - F.col("with_good")) / F.col("without_n"))
    return out.select("signature", "tool", "with_n", "without_n", F.bround("a", 6).alias("with_accuracy"), F.bround("b", 6).alias("without_accuracy"), F.bround(F.col("a") - F.col("b"), 6).alias("delta"))


def under_triggered(value: DataFrame, gap: float = 0.20) -> DataFrame:
    """Tools whose absence goes with an error rate higher by at least ``gap``."""
    return value.where(F.bround(F.col("with_accuracy") - F.col("without_accuracy"), 6) >= gap)


def call_efficiency(calls: DataFrame, cap: int = 5) -> DataFrame:
    """By run: traces at or over the cap, and calls that repeat a tool with the same inputs."""
    own = calls.where("agent = 'mapping'")
    per = own.groupBy("run_id", "source_column").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("traces"), F.count_if(F.col("n") >= cap).alias("at_cap"))
    again = own.groupBy("run_id", "source_column", "tool_name", "inputs_json").agg((F.count("*") - 1).alias("d")).groupBy("run_id").agg(F.sum("d").alias("repeated"))
    return per.join(again, "run_id").select("run_id", "traces", "at_cap", "repeated")


def tuning_runs(loss_runs: DataFrame, layer: int = 0) -> DataFrame:
    """Loss runs whose configuration names the tuning layer."""
    return loss_runs.where(F.get_json_object("config_snapshot", "$.tuning_layer") == str(layer))
