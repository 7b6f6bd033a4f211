"""Row transforms: text of a source column to a typed target column.

Each takes and returns a Column; bad text gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import broadcast_counted

MONEY = "decimal(14,2)"


def blank_as_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def compact_date(c: Column) -> Column:
    """YYYYMMDD; the sentinel 00000000 and dates that don't exist are null."""
    return F.when(F.trim(c).rlike(r"^\d{8}$"), F.try_to_date(F.trim(c), "yyyyMMdd"))


def us_date(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(F.trim(c), "M/d/yyyy"))


def iso_date(c: Column) -> Column:
    return F.trim(c).try_cast("date")


def yes_no(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)) == "Y", True).when(F.upper(F.trim(c)) == "N", False)


def true_false(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)) == "true", True).when(F.lower(F.trim(c)) == "false", False)


def prefixed_id(c: Column, prefix: str) -> Column:
    return F.replace(F.trim(c), F.lit(prefix), F.lit("")).try_cast("bigint")


def cents(c: Column) -> Column:
    """Integer cents to money; text with a point is not cents and is null."""
    return F.when(F.trim(c).rlike(r"^-?\d+$"), (F.trim(c).try_cast("decimal(14,0)") / 100).cast(MONEY))


def money(c: Column) -> Column:
    return F.trim(c).try_cast("decimal(12,2)")


def whole_number(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def title(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(c)))


def translated(c: Column, codes: dict[str, str]) -> Column:
    """The label of a code, or the code itself where there is none."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.trim(c)), F.trim(c))


def translate_codes(rows: DataFrame, columns: list[str], value_map: DataFrame) -> DataFrame:
    """``rows`` with the codes of ``columns`` replaced by their labels in ``value_map`` (column_name, code, label).

    The lookup is a table, counted before it is broadcast: then all columns are
    translated in one pass over the rows, and beyond that each join shuffles.
    Codes are trimmed; one that the table lacks stays as it is (see
    :func:`missing_codes`), and of several labels of a code the smallest counts.
    """
    known = value_map.where(F.col("column_name").isin(columns)).groupBy("column_name", "code").agg(F.min("label").alias("label"))
    out, held = rows, broadcast_counted(known, 1_000_000)
    for c in columns:
        own = held.where(F.col("column_name") == c).select(F.col("code").alias("_code"), F.col("label").alias("_label"))
        out = out.join(own, F.trim(F.col(f"`{c}`")) == F.col("_code"), "left").withColumn(c, F.coalesce("_label", F.trim(F.col(f"`{c}`")))).drop("_code", "_label")
    return out.select([f"`{c}`" for c in rows.columns])


def missing_codes(rows: DataFrame, columns: list[str], value_map: DataFrame) -> DataFrame:
    """(column_name, code, rows): codes of ``columns`` that ``value_map`` lacks, with the rows that hold them; empty cells are none."""
    codes = F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"`{c}`")).alias("code")) for c in columns])
    held = rows.select(F.inline(codes)).where("code <> ''").groupBy("column_name", "code").agg(F.count("*").alias("rows"))
    return held.join(value_map.select("column_name", "code").distinct(), ["column_name", "code"], "left_anti")


def filled(kind: str, value: str | None, target: str) -> Column:
    """A target that no source column feeds: NULL, a HARDCODED literal or a DERIVED expression."""
    sql_type = {"integer": "bigint", "bigint": "bigint", "decimal": "decimal(12,2)", "date": "date", "boolean": "boolean"}.get(target, "string")
    if kind == "NULL" or value is None:
        return F.lit(None).cast(sql_type)
    return F.lit(value).try_cast(sql_type) if kind == "HARDCODED" else F.expr(value)


def extended(columns: list[str]) -> Column:
    """What no target takes, as one JSON object; null where nothing is left."""
    return F.to_json(F.struct(*[F.col(c) for c in columns])) if columns else F.lit(None).cast("string")


def project(rows: DataFrame, fields: list[tuple[str, str]], approved: list[tuple[str, str]], resolutions: list[tuple[str, str, str | None]] = (), leftover: list[str] = ()) -> DataFrame:
    """The staging table of a mapping definition: a column for each field, in declared order.

    ``fields`` are (name, type); ``approved`` are (target, expression), of which
    the last for a target counts; ``resolutions`` are (field, kind, value) for
    fields that no column feeds, as in :func:`filled`; other fields are null.
    ``leftover`` columns go to ``extended_attributes``.  A definition has a row
    for each field, so the driver holds it; all rows are one select.
    """
    by_target = dict(approved)
    given = {field: (kind, value) for field, kind, value in resolutions}
    made = [F.expr(by_target[n]).alias(n) if n in by_target else filled(*given.get(n, ("NULL", None)), kind).alias(n) for n, kind in fields]
    return rows.select(*made, extended(list(leftover)).alias("extended_attributes"))


def unmapped_fields(fields: DataFrame, approved: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Fields (name, ...) with neither an approved mapping (target) nor a resolution (field)."""
    return fields.join(approved.select(F.col("target").alias("name")), "name", "left_anti").join(resolutions.select(F.col("field").alias("name")), "name", "left_anti")


def kind_of(target: Column, source: Column, date_format: Column, is_id: Column, is_cents: Column, prefix: Column, truth: Column) -> Column:
    """The transform a mapped column needs, by name."""
    return (
        F.when(target == "date", F.when(date_format == "US", "us_date").when(date_format == "ISO8601", "iso_date").otherwise("compact_date"))
        .when(target == "boolean", F.when(truth, "true_false").otherwise("yes_no"))
        .when(target.isin("integer", "bigint") & prefix.isNotNull(), "prefixed_id")
        .when(target.isin("integer", "bigint"), "whole_number")
        .when((target == "decimal") & (source == "integer") & is_cents, "cents")
        .when(target == "decimal", "money")
        .otherwise("blank_as_null")
    )


def expression(kind: Column, name: Column, prefix: Column) -> Column:
    """The same as Spark SQL text, to be shown, stored and run."""
    q = F.concat(F.lit("`"), name, F.lit("`"))
    call = lambda before, after: F.concat(F.lit(before), q, F.lit(after))
    return (
        F.when(kind == "compact_date", call("try_to_date(", ", 'yyyyMMdd')"))
        .when(kind == "us_date", call("try_to_date(", ", 'M/d/yyyy')"))
        .when(kind == "iso_date", call("try_cast(", " as date)"))
        .when(kind == "yes_no", F.concat(F.lit("case upper("), q, F.lit(") when 'Y' then true when 'N' then false end")))
        .when(kind == "true_false", call("try_cast(lower(", ") as boolean)"))
        .when(kind == "prefixed_id", F.concat(F.lit("try_cast(replace("), q, F.lit(", '"), F.coalesce(prefix, F.lit("")), F.lit("', '') as bigint)")))
        .when(kind == "whole_number", call("try_cast(", " as bigint)"))
        .when(kind == "cents", call("cast(try_cast(", " as decimal(14,0)) / 100 as decimal(14,2))"))
        .when(kind == "money", call("try_cast(", " as decimal(12,2))"))
        .otherwise(call("nullif(trim(", "), '')"))
    )
