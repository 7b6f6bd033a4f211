"""Profiles that grow by delivery: a mergeable state for each column, kept with each delivery.

A new delivery is read once and its states are published; the profile of all
deliveries is made of states alone.  Counts, null rates, types, formats and flags are
exact.  Distinct values are exact up to twenty (kept with their counts) and above
that a HyperLogLog sketch's estimate: relative standard error 1.6 %, so within 5 %
in all but some 1 of 500 columns.

States come from one pass of partial aggregates over the cells, by column, type and
format: no shuffle of values.  Values are counted only in columns whose sketch says
that they are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import broadcast_counted
from .profile import CENTS_PART, DISTINCT_CAP, ID_ENDING, TOP, TOP_DISTINCT, cell_date_format, cell_type

SKETCH_BITS = 12
KEYS = ["table_name", "column_name"]
STATE = "source_name string, table_name string, column_name string, ordinal int, row_count long, longest int, sketch binary, votes array<struct<cell_type:string,date_format:string,n:long,first_pos:long>>, few array<struct<value:string,n:long,first_pos:long>>"


def column_states(cells: DataFrame, source: str, narrowed: Callable[[dict[str, set[str]]], DataFrame] | None = None) -> DataFrame:
    """The states of one delivery's columns (:data:`STATE`) from its melted cells; ``few`` is null for columns of more than twenty values.

    ``narrowed`` gives the delivery's cells of some columns by table from a scan of
    those alone; without it all cells are read once more to count the few values.
    """
    kind = F.when(F.col("value").isNotNull(), cell_type(F.col("value")))
    typed = cells.withColumn("cell_type", kind).withColumn("date_format", F.when(F.col("cell_type") == "date", cell_date_format(F.col("value"))))
    by_type = typed.groupBy(*KEYS, "cell_type", "date_format").agg(
        F.min("ordinal").alias("ordinal"), F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max(F.length("value")).alias("longest"), F.hll_sketch_agg("value", SKETCH_BITS).alias("sketch")
    )
    states = by_type.groupBy(*KEYS).agg(
        F.min("ordinal").cast("int").alias("ordinal"), F.sum("n").alias("row_count"), F.max("longest").cast("int").alias("longest"), F.hll_union_agg("sketch").alias("sketch"),
        F.collect_list(F.struct("cell_type", "date_format", "n", "first_pos")).alias("votes"),
    ).checkpoint()
    some = states.where(F.hll_sketch_estimate("sketch") <= 1.5 * TOP_DISTINCT).select(*KEYS)
    if narrowed is None:
        own = cells.where("value is not null").join(broadcast_counted(some), KEYS, "left_semi")
    else:
        names: dict[str, set[str]] = {}
        for r in some.collect():  # names of columns, for the scan
            names.setdefault(r["table_name"], set()).add(r["column_name"])
        own = (narrowed(names) if names else cells.limit(0)).where("value is not null")
    values = own.groupBy(*KEYS, "value").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    few = values.groupBy(*KEYS).agg(F.collect_list(F.struct("value", "n", "first_pos")).alias("few")).where(F.size("few") <= TOP_DISTINCT)
    nothing = F.when(F.hll_sketch_estimate("sketch") == 0, F.array().cast("array<struct<value:string,n:long,first_pos:long>>"))
    out = states.join(few, KEYS, "left").withColumn("few", F.coalesce("few", nothing)).withColumn("source_name", F.lit(source))
    return out.select("source_name", *KEYS, "ordinal", "row_count", "longest", "sketch", "votes", "few")


def merged_profile(states: DataFrame) -> DataFrame:
    """One row per column over all deliveries of ``states``: the columns of a profile, and ``top`` (five values, where there are at most twenty).

    Ties of types and formats go to the first position, whichever delivery held it.
    """
    whole = states.groupBy(*KEYS).agg(F.min("ordinal").alias("ordinal"), F.sum("row_count").alias("row_count"), F.max("longest").alias("longest"), F.hll_union_agg("sketch").alias("sketch"), F.bool_or(F.col("few").isNull()).alias("many"))
    votes = states.select(*KEYS, F.inline("votes")).where("cell_type is not null").groupBy(*KEYS, "cell_type", "date_format").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    best = F.struct("n", -F.col("first_pos"))
    by_type = votes.groupBy(*KEYS, "cell_type").agg(F.max_by("date_format", best).alias("f"), F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    voted = by_type.groupBy(*KEYS).agg(F.max_by("cell_type", best).alias("t"), F.max("f").alias("f"), F.sum("n").alias("filled"))
    values = states.where("few is not null").select(*KEYS, F.inline("few")).groupBy(*KEYS, "value").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    order = Window.partitionBy(*KEYS).orderBy(F.col("n").desc(), "first_pos", "value")
    ranked = values.withColumn("rank", F.row_number().over(order))
    few = ranked.groupBy(*KEYS).agg(F.count("*").alias("d"), F.array_sort(F.collect_list(F.when(F.col("rank") <= TOP, F.struct("rank", "value", "n")))).alias("top"))
    rows = whole.join(voted, KEYS, "left").join(few, KEYS, "left")
    exact = ~F.col("many") & (F.coalesce("d", F.lit(0)) <= TOP_DISTINCT)
    distinct = F.when(exact, F.coalesce("d", F.lit(0))).otherwise(F.hll_sketch_estimate("sketch")).cast("long")
    kind, filled = F.coalesce("t", F.lit("string")), F.coalesce("filled", F.lit(0))
    return rows.select(
        *KEYS,
        "ordinal",
        "row_count",
        F.when(F.col("row_count") == 0, 1.0).otherwise(F.bround((F.col("row_count") - filled) / F.col("row_count"), 4)).alias("null_rate"),
        F.least(distinct, F.lit(DISTINCT_CAP)).cast("long").alias("distinct_count"),
        distinct.alias("distinct_estimate"),
        exact.alias("distinct_exact"),
        kind.alias("inferred_type"),
        F.when(kind == "date", F.col("f")).alias("date_format"),
        F.col("column_name").rlike(ID_ENDING).alias("is_id"),
        (exact & (distinct < 20) & kind.isin("string", "boolean") & (F.coalesce("longest", F.lit(0)) <= 10)).alias("is_coded"),
        ((kind == "integer") & F.col("column_name").rlike(CENTS_PART)).alias("is_cents"),
        F.when(exact, F.transform("top", lambda t: F.struct(t["value"], t["n"]))).alias("top"),
    )
