"""Tables as text sources, and the schemas of tables as mapping targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import as_text


def read_text(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All columns as strings (at most ``limit`` rows), and the true row count as a one-row table."""
    return as_text(df if limit is None else df.limit(limit)), df.agg(F.count("*").alias("row_count"))


def target_type(kind: T.DataType) -> str:
    """The target vocabulary's word for a Spark type."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.DecimalType):
        return "decimal" if kind.scale > 0 else "bigint" if kind.precision > 9 else "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "decimal"
    if isinstance(kind, T.LongType):
        return "bigint"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "integer"
    return "string"


def target_fields(schema_key: str, schema: T.StructType) -> list[tuple]:
    """Rows for :func:`tallyframe.plans.canonical.fields` from a table's schema, without reading it."""
    return [(schema_key, i, f.name.lower(), target_type(f.dataType), not f.nullable, None, [f.name.lower()]) for i, f in enumerate(schema.fields)]


def jdbc_catalog(spark: SparkSession, name: str, url: str, **options: str) -> None:
    """Name a database, so that its tables are read as ``name.schema.table`` with filters, columns, limits and aggregates pushed down."""
    key = f"spark.sql.catalog.{name}"
    spark.conf.set(key, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for k, v in {"url": url, "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownTableSample": "true", **options}.items():
        spark.conf.set(f"{key}.{k}", v)


def read_jdbc(spark: SparkSession, table: str, column: str | None = None, partitions: int = 8) -> DataFrame:
    """A table of a :func:`jdbc_catalog`, read by ranges of ``column`` (a number or a time) in ``partitions`` queries.

    The bounds come from one pushed-down query for the smallest and largest value;
    rows beyond them or without a value are read by the outer ranges.  Without a
    column, or where it holds one value at most, the table is read by one query.
    """
    whole = spark.table(table)
    if column is None:
        return whole
    r = whole.agg(F.min(f"`{column}`").cast("string").alias("low"), F.max(f"`{column}`").cast("string").alias("high")).first()
    if r["low"] is None or r["low"] == r["high"]:
        return whole
    return spark.read.options(partitionColumn=column, lowerBound=r["low"], upperBound=r["high"], numPartitions=str(partitions)).table(table)
