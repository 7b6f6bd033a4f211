"""Schema drift: versions of a source's columns and what changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..sources import store

RENAME = 0.85


def fingerprints(columns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per source: its columns and a hash that changes with any of them."""
    item = F.struct(F.lower("column_name").alias("low"), "column_name", "inferred_type", "is_id", "is_coded", F.coalesce("date_format", F.lit("")).alias("date_format"))
    listed = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("columns"))
    text = F.to_json(F.transform("columns", lambda c: F.struct(c["column_name"], c["inferred_type"], c["is_id"], c["is_coded"], c["date_format"])))
    return listed.withColumn("schema_hash", F.substring(F.sha2(text, 256), 1, 16))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, old_name, new_name, old_type, new_type, similarity, breaking).

    Names only in one version are matched as renames if each is the other's best
    at 0.85 or more (ties by name); what is left is removed (breaking) or added.
    A type change of a name in both is breaking.
    """
    o = old.select(*keys, "column_name", F.col("inferred_type").alias("old_type"))
    n = new.select(*keys, "column_name", F.col("inferred_type").alias("new_type"))
    both = o.join(n, [*keys, "column_name"], "full_outer")
    removed = both.where("new_type is null").select(*keys, F.col("column_name").alias("old_name"), "old_type")
    added = both.where("old_type is null").select(*keys, F.col("column_name").alias("new_name"), "new_type")
    pairs = removed.join(added, keys).withColumn("similarity", ratio(F.lower("old_name"), F.lower("new_name"))).where(F.col("similarity") >= RENAME)
    from_old = Window.partitionBy(*keys, "old_name").orderBy(F.col("similarity").desc(), "new_name")
    from_new = Window.partitionBy(*keys, "new_name").orderBy(F.col("similarity").desc(), "old_name")
    renamed = pairs.withColumn("a", F.row_number().over(from_old)).withColumn("b", F.row_number().over(from_new)).where("a = 1 and b = 1").drop("a", "b")
    nothing = F.lit(None).cast("string")
    columns = [*keys, "kind", "old_name", "new_name", "old_type", "new_type", "similarity", "breaking"]
    none = F.lit(None).cast("double")
    parts = [
        renamed.select(*keys, F.lit("renamed").alias("kind"), "old_name", "new_name", "old_type", "new_type", F.bround("similarity", 3).alias("similarity"), F.lit(False).alias("breaking")),
        removed.join(renamed, [*keys, "old_name"], "left_anti").select(*keys, F.lit("removed").alias("kind"), "old_name", nothing.alias("new_name"), "old_type", nothing.alias("new_type"), none.alias("similarity"), F.lit(True).alias("breaking")),
        added.join(renamed, [*keys, "new_name"], "left_anti").select(*keys, F.lit("added").alias("kind"), nothing.alias("old_name"), "new_name", nothing.alias("old_type"), "new_type", none.alias("similarity"), F.lit(False).alias("breaking")),
        both.where("old_type <> new_type").select(*keys, F.lit("type_changed").alias("kind"), F.col("column_name").alias("old_name"), F.col("column_name").alias("new_name"), "old_type", "new_type", none.alias("similarity"), F.lit(True).alias("breaking")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(columns)


def latest_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Each source's newest version of (keys, version, schema_hash, columns)."""
    return versions.groupBy(*keys).agg(F.max_by(F.struct("version", "schema_hash", "columns"), "version").alias("v")).select(*keys, "v.*")


def next_versions(versions: DataFrame, seen: DataFrame, keys: list[str], blocked: DataFrame | None = None) -> DataFrame:
    """Version rows to append: the first, or the next where the hash differs.

    ``blocked`` names sources (keys) with breaking changes that nobody forced;
    they are reported and not recorded.
    """
    last = latest_versions(versions, keys).select(*keys, F.col("version").alias("last"), F.col("schema_hash").alias("last_hash"))
    rows = seen.join(last, keys, "left").where("last is null or last_hash <> schema_hash")
    if blocked is not None:
        rows = rows.join(blocked, keys, "left_anti")
    return rows.select(*keys, (F.coalesce("last", F.lit(0)) + 1).alias("version"), "schema_hash", "columns")


def breaking_sources(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.bool_or("breaking").alias("breaking")).where("breaking").select(*keys)


VERSION = "source_name string, version int, schema_hash string, columns array<struct<low:string,column_name:string,inferred_type:string,is_id:boolean,is_coded:boolean,date_format:string>>"


def record_delivery(delivered: DataFrame, path: str, run_id: str, forced: DataFrame | None = None) -> DataFrame:
    """Append the versions of a delivery's columns to the store at ``path``; the changes against the versions before.

    Sources (source_name) with breaking changes are reported and not recorded,
    unless ``forced`` names them.  The same run published again replaces its own
    versions: it is compared with those of other runs only.
    """
    spark, key = delivered.sparkSession, ["source_name"]
    before = store.read(spark, path, VERSION).where(F.col("run_id") != run_id).drop("run_id").checkpoint()
    old = latest_versions(before, key).select("source_name", F.inline("columns")).drop("low")
    known = delivered.join(before.select("source_name").distinct(), key, "left_semi")
    found = changes(old.join(delivered.select("source_name").distinct(), key, "left_semi"), known, key).checkpoint()
    blocked = breaking_sources(found, key)
    if forced is not None:
        blocked = blocked.join(forced.select("source_name"), key, "left_anti")
    store.publish(next_versions(before, fingerprints(delivered, key), key, blocked), path, run_id)
    return found


def to_be_mapped(found: DataFrame) -> DataFrame:
    return found.where("kind = 'added'")
