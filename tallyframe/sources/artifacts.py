"""Profiles, proposals, labels and history as files: nested JSON in, tables out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.transforms import project

_COLUMN = "name:string,inferred_type:string,null_rate:double,distinct_count:bigint,sample_values:array<string>,value_distribution:map<string,bigint>,date_format:string,is_id_column:boolean,is_coded_column:boolean,is_cents_column:boolean"
PROFILE = f"source_name string, profiled_at string, profile_hash string, tables array<struct<table_name:string,row_count:bigint,columns:array<struct<{_COLUMN}>>>>"
PROPOSAL = "source_name string, table_name string, mappings array<struct<source_column:string,target_field:string,confidence:double,method:string,sql_expression:string>>"
SAFE_NAME = r"^[A-Za-z0-9_-]+$"


CATALOG = "source_name string, table_name string, columns array<struct<source_column:string,canonical_target:string,secondary_target:string,confidence_floor:double,transformation:string,is_hard:boolean>>, missing_standard_fields array<string>"


def read_labels(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Label catalogs as tables: labelled columns, and fields that a source lacks.

    One JSON document for each catalog.  A null target is a label too (the column
    has none); no hard flag means not hard.  Catalogs whose source name could not
    stand in a path are left out.
    """
    docs = safe_sources(spark.read.schema(CATALOG).option("multiLine", True).json(paths))
    columns = docs.select("source_name", "table_name", F.inline("columns"))
    columns = columns.select("source_name", "table_name", "source_column", F.col("canonical_target").alias("truth"), F.col("secondary_target").alias("secondary"), "confidence_floor", F.col("transformation").alias("check"), F.coalesce("is_hard", F.lit(False)).alias("is_hard"))
    return columns, docs.select("source_name", "table_name", F.explode("missing_standard_fields").alias("field"))


def write_labels(columns: DataFrame, missing: DataFrame, path: str) -> None:
    """Label tables as catalogs, a JSON file for each source and table."""
    keys = ["source_name", "table_name"]
    listed = F.array_sort(F.collect_list(F.struct("source_column", F.col("truth").alias("canonical_target"), F.col("secondary").alias("secondary_target"), "confidence_floor", F.col("check").alias("transformation"), "is_hard")))
    gone = missing.groupBy(*keys).agg(F.sort_array(F.collect_set("field")).alias("missing_standard_fields"))
    columns.groupBy(*keys).agg(listed.alias("columns")).join(gone, keys, "left").write.option("maxRecordsPerFile", 1).json(path)


def read_proposals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per mapping of each proposal file, with the file's name and time."""
    df = spark.read.schema(PROPOSAL).option("multiLine", True).json(paths)
    meta = df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("recorded_at"))
    return meta.select("source_name", "table_name", "file_name", "recorded_at", F.inline("mappings"))


def read_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per column of each profile file."""
    df = spark.read.schema(PROFILE).option("multiLine", True).json(paths)
    tables = df.select("source_name", "profile_hash", F.inline("tables"))
    return tables.select("source_name", "profile_hash", "table_name", "row_count", F.inline("columns"))


def write_nested(columns: DataFrame, path: str) -> None:
    """Profile rows as one nested JSON document for each table, by source."""
    doc = columns.groupBy("source_name", "table_name").agg(F.collect_list(F.struct(*[c for c in columns.columns if c not in ("source_name", "table_name")])).alias("columns"))
    doc.write.option("maxRecordsPerFile", 1).partitionBy("source_name").json(path)


DEFINITION = (
    "source_name string, table_name string,"
    " approved_mappings array<struct<source_column:string,target_field:string,sql_expression:string,confidence:double,method:string,reviewer_action:string>>,"
    " extended_attributes array<string>,"
    " missing_field_resolutions array<struct<target_field:string,resolution:string,hardcoded_value:string,derivation_sql:string>>,"
    " reviewer_identity string, reviewed_at timestamp, profile_hash string"
)


def write_definitions(definitions: DataFrame, path: str) -> None:
    """Mapping definitions as JSON documents, a file for each source and table."""
    definitions.write.option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(path)


def read_definitions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Mapping definitions, one row for each document; of several for a table the one reviewed last."""
    docs = spark.read.schema(DEFINITION).option("multiLine", True).json(paths)
    return replaced(docs, ["source_name", "table_name"], ["reviewed_at", "profile_hash"])


def stage(rows: DataFrame, definition: Row, fields: list[tuple[str, str]]) -> DataFrame:
    """The staging table of one definition: its mappings and resolutions over all rows, a column for each of ``fields`` (name, type)."""
    approved = [(m["target_field"], m["sql_expression"]) for m in definition["approved_mappings"] or [] if m["target_field"] is not None]
    resolved = [(m["target_field"], m["resolution"], m["hardcoded_value"] if m["resolution"] == "HARDCODED" else m["derivation_sql"]) for m in definition["missing_field_resolutions"] or []]
    return project(rows, fields, approved, resolved, definition["extended_attributes"] or [])


def backfill(proposals: DataFrame, history: DataFrame) -> DataFrame:
    """History rows of proposal files that the history lacks: run ``backfill-<file stem>``."""
    run = F.concat(F.lit("backfill-"), F.regexp_replace("file_name", r"\.[^.]*$", ""))
    rows = proposals.withColumn("run_id", run)
    return rows.join(history.select("run_id").distinct(), "run_id", "left_anti")


def safe_sources(labels: DataFrame) -> DataFrame:
    """Labels whose source name can stand in a path."""
    return labels.where(F.col("source_name").rlike(SAFE_NAME))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("source_name").parquet(path)


def replaced(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """An append-only table read as insert-or-replace: the newest row for each key."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(*key, "r.*").select(rows.columns)


def newest(rows: DataFrame, where: Column, order: list[str], limit: int) -> DataFrame:
    """The newest rows of a selection, for a report."""
    return rows.where(where).orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def newest_of_each(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def write_scores(scored: DataFrame, path: str) -> None:
    scored.write.option("header", True).csv(path)
