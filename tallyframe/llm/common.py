"""What several operators share: tables, materialised steps, components."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` as the cluster names it; only in a local session
    that leaves it unset (as in tests) a folder of our own is made and set.  A
    cluster without it is refused: a machine-local folder would lose rows there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyframe.shared.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tallyframe.shared.dir", base)
    return f"{base}/tallyframe/{spark.sparkContext.applicationId}"


def literal_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A small table of given rows as one literal, without Python workers; ``columns`` are names and types."""
    text = json.dumps([dict(zip(columns, r, strict=True)) for r in rows])
    kind = ",".join(f"{c}:{t}" for c, t in columns.items())
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or ``name`` with underscores that no column of the frames has in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let an Arrow batch hold at most about ``size`` bytes, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read, not the steps before.
    Row groups are small, as a writer holds one in memory.
    """
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised step that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/tallyframe/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Hint a broadcast only where the counted rows are within ``limit``; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def beside_wide_rows(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """The same for a narrow table joined to wide rows: beyond ``limit`` it is hashed, so that the wide rows aren't sorted."""
    return F.broadcast(df) if rows <= limit else df.hint("shuffle_hash")


def running_sum(df: DataFrame, by: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same ``by``, in order.

    Rows are dealt by range of (by, order), so a group of any size is spread;
    only a row for each partition and group meets in a window of its own.
    """
    dealt = materialize(df.withColumn("_v", value).repartitionByRange(by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(by, "_p").agg(F.sum("_v").alias("_t"))
    parts = parts.select(F.col(by).alias("_by"), F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(earlier(by).orderBy("_p")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_v").over(earlier(by, "_p").orderBy(*order)), F.lit(0))
    joined = dealt.withColumn("_inside", inside).join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_v", "_p", "_by", "_q", "_before", "_inside")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    ``edges`` has two columns ``a`` and ``b`` of one type, numbers or strings;
    nulls and loops are left out.  Returns (node, component): every node with an
    edge, and the smallest node of its component.  Each round is two
    aggregations and two joins on the node; a hub's neighbours meet only in a
    partial minimum and in a join that AQE may split, never in one group.
    Rounds go on until the edges stay the same, about log(n) times.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    seen, written = None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        watch = Observation()
        after = rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(after.observe(watch, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")), "stars")
        was, seen = seen, watch.get
        if written is not None:
            discard(written)
        now = written = after
        if was == seen:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def unite_ids(rows: DataFrame) -> DataFrame:
    """(id, component): the smallest id of those joined by rows (id, component), where an id may have several components."""
    rows = materialize(rows.distinct(), "rows")
    first = rows.groupBy("id").agg(F.min("component").alias("first"))
    edges = rows.join(first, "id").select(F.col("component").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    joined = materialize(connected_components(edges), "joined").withColumnRenamed("component", "root")
    rooted = first.join(joined, F.col("first") == F.col("node"), "left").select("id", F.coalesce("root", "first").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(lowest, "root").select("id", "component")
