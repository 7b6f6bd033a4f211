"""Tables that jobs publish run by run: a run is there whole or not at all, and once.

Each publication writes a folder of its own (an attempt) and then, last, a line in
the manifest that names it.  Readers take, of each run, the attempt that the
newest line names.  So a job that is killed half-way leaves nothing to be seen, one
that runs twice replaces what it published before, and readers of the earlier
attempt aren't cut off by a half-written one.  Superseded attempts are deleted
after the new line stands; what killed jobs left, :func:`sweep` deletes.

The history of decisions, losses, examples, prompts and tool calls is kept in such
tables, each of a fixed schema (:data:`KINDS`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checkpoints import broadcast_counted

#: Columns of each kind of history; the first in each list must not be missing.
KINDS = {
    "decisions": "source_name string, source_column string, table_name string, target string, confidence double, method string, expression string, reviewer_action string, verdict string, recorded_at timestamp",
    "loss_runs": "source_name string, mean_loss double, f1 double, config_snapshot string, recorded_at timestamp",
    "examples": "source_name string, source_column string, target_field string, origin string, signature string, status string, retire_reason string, recorded_at timestamp",
    "prompt_versions": "source_name string, agent_name string, version_id long, prompt string, accepted boolean, accepted_at timestamp",
    "tool_calls": "source_name string, source_column string, agent string, tool_name string, call_order long, inputs_json string, recorded_at timestamp",
}
REQUIRED = {"decisions": 2, "loss_runs": 2, "examples": 3, "prompt_versions": 3, "tool_calls": 5}
_MANIFEST = "run_id string, attempt string, published_at timestamp"


def _fields(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt, published_at): the attempt that counts, for each finished run."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    lines = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    return lines.groupBy("run_id").agg(F.max(F.struct("published_at", "attempt")).alias("m")).select("run_id", "m.attempt", "m.published_at")


def publish(df: DataFrame, path: str, run_id: str) -> str:
    """Publish ``df`` (with a ``source_name``) as the run ``run_id``, in place of what that run published before; the attempt's name."""
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    before = [r["attempt"] for r in manifest(spark, path).where(F.col("run_id") == run_id).collect()]
    df.write.partitionBy("source_name").parquet(f"{path}/data/attempt={attempt}")
    line = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("published_at"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    for old in before:
        fs, p = _files(spark, f"{path}/data/attempt={old}")
        fs.delete(p, True)
    return attempt


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of all finished runs, with their ``run_id``."""
    fields = _fields(schema)
    names = [f.name for f in fields]
    counted = manifest(spark, path).select("run_id", "attempt")
    if not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], T.StructType([*fields.fields, T.StructField("run_id", T.StringType())]))
    rest = [f for f in fields if f.name != "source_name"]
    # Partition columns are given, so that names made of digits stay texts.
    whole = T.StructType([*rest, T.StructField("attempt", T.StringType()), T.StructField("source_name", T.StringType())])
    rows = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(broadcast_counted(counted), "attempt").select(*names, "run_id")


def sweep(spark: SparkSession, path: str) -> int:
    """Delete attempts that no finished run counts, as killed jobs leave them; how many.  For times when no job publishes."""
    fs, data = _files(spark, f"{path}/data")
    if not fs.exists(data):
        return 0
    counted = {r["attempt"] for r in manifest(spark, path).collect()}  # a line for each run, as there is a folder for each
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName().startswith("attempt=") and s.getPath().getName()[8:] not in counted]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def record(rows: DataFrame, path: str, kind: str, run_id: str) -> str:
    """Publish history rows of a kind: columns are cast to its schema, missing optional ones are null, further ones are left out."""
    fields = _fields(KINDS[kind])
    lacking = [f.name for f in fields.fields[: REQUIRED[kind]] if f.name not in rows.columns]
    if lacking:
        raise ValueError(f"{kind} need the columns {', '.join(lacking)}")
    cast = [(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
    return publish(rows.select(cast), f"{path}/{kind}", run_id)


def history(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All finished runs' rows of a kind."""
    return read(spark, f"{path}/{kind}", KINDS[kind])
