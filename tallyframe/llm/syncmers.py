"""Document fingerprints from closed syncmers.

A text is a sequence of words (runs of other characters than space and the
controls 9 to 13).  Of its k-mers of ``K`` = 6 words those are anchors whose
smallest inner 2-mer, by hash, is their first or their last: whether a k-mer is
one depends on its own words alone, so the same passage gives the same anchors
wherever it stands.  Two in five k-mers are anchors, and any run of five k-mers
holds one.  A text without anchors (fewer than ``K`` words, or a few more) has
one anchor for the whole sequence; a text without words has none.

The fingerprint is the whole sequence of anchors in text order, as eight
hexadecimal digits each, and the anchors' word positions stand beside it.
``near_edited`` and ``near_next`` are the exact Jaccard similarities of the whole
sets of anchors.  ``placed_edited`` matches by position: the same similarity of the anchors each taken with its distance in words to the next
anchor, so that anchors that moved against their neighbours don't count.

Everything is a DataFrame expression; :func:`anchors` gives the anchors with
their positions for positional matching.

Defined results: a null text is the empty one, with an empty fingerprint; two
empty fingerprints are alike (1.0), an empty one and another are not (0.0); rows
that repeat an id take as next document the row of the next id with the smallest
text hash; a null id has no next document; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 6
_WHITE = " \t\n\x0b\x0c\r"


def _with_anchors(df: DataFrame, text: str, out: str, positions: bool = False) -> DataFrame:
    """Add the anchors of ``text`` as array ``out``; each step is an array of the one before."""
    no_ints = F.array().cast("array<bigint>")
    stripped = F.btrim(F.col(text), F.lit(_WHITE))
    df = df.withColumn("_h", F.when(stripped == "", no_ints).otherwise(F.transform(F.split(stripped, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))))
    pairs = F.size("_h") - 1
    df = df.withColumn("_g", F.when(pairs < 1, no_ints).otherwise(F.zip_with(F.slice("_h", 1, pairs), F.slice("_h", 2, pairs), lambda a, b: F.xxhash64(a, b))))
    g = lambda i: F.get(F.col("_g"), i)
    value = lambda x, i: F.shiftright(F.xxhash64(x, g(i + 2), g(i + 4)), 32).cast("int")
    made = (lambda x, i: F.struct(i.alias("word"), value(x, i).alias("hash"))) if positions else value
    chosen = F.transform(
        F.slice("_g", 1, F.greatest(F.size("_g") - (K - 2), F.lit(0))),
        lambda x, i: F.when(F.least(x, g(i + 4)) <= F.least(g(i + 1), g(i + 2), g(i + 3)), made(x, i)),
    )
    df = df.withColumn("_c", F.array_compact(chosen))
    whole = F.shiftright(F.xxhash64("_h"), 32).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("word"), whole.alias("hash")) if positions else whole)
    return df.withColumn(out, F.when(F.size("_h") == 0, F.slice("_c", 1, 0)).when(F.size("_c") == 0, whole).otherwise(F.col("_c"))).drop("_h", "_g", "_c")


def anchors(docs: DataFrame, *, text_col: str = "text", out_col: str = "anchors") -> DataFrame:
    """The input with its anchors as array<struct<word:int,hash:int>>, in text order."""
    text = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    return _with_anchors(text, "_t", out_col, positions=True).drop("_t")


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def placed(anchors: Column) -> Column:
    """Each anchor of array<struct<word,hash>> with its distance to the next one, hashed; the last with 0."""
    later = F.concat(F.slice(anchors, 2, F.greatest(F.size(anchors) - 1, F.lit(0))), F.slice(anchors, -1, 1))
    return F.when(F.size(anchors) == 0, F.array().cast("array<bigint>")).otherwise(F.zip_with(anchors, later, lambda x, y: F.xxhash64(x["hash"], y["word"] - x["word"])))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays as sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def next_in_order(ids: DataFrame) -> DataFrame:
    """(id, next, cut) in descending order of id; after the last comes the first.

    ``ids`` has id and cut, one row for each id.  Ids are dealt by range and
    looked up within their range; only the ends of the ranges, a row for each
    partition, meet in one window.
    """
    dealt = materialize(ids.repartitionByRange("id").withColumn("p", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("p").agg(F.max("id").alias("top"))
    down = Window.orderBy(F.col("top").desc())
    ends = ends.select("p", F.coalesce(F.lead("top").over(down), F.max("top").over(Window.partitionBy())).alias("after"))
    inside = F.lead("id").over(Window.partitionBy("p").orderBy(F.col("id").desc()))
    return dealt.withColumn("inside", inside).join(F.broadcast(ends), "p").select("id", F.coalesce("inside", "after").alias("next"), "cut")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last third (of code points, rounded
    down) replaced by the first as many of the next document, in descending
    order of id.  Returns the id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``placed_edited``, ``words`` and ``edited_words`` (the
    positions of the fingerprints' anchors).

    The texts are shuffled by id once; what a document gives to the one before
    it (the passage it needs and its set of anchors) once more.
    """
    given_rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = given_rows.where("id is not null")
    ids = base.groupBy("id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("cut"), F.count("*").alias("c"))
    ids = materialize(ids, "ids")
    repeated = not ids.where("c > 1").isEmpty()
    order = materialize(next_in_order(ids.select("id", "cut")), "next").withColumnRenamed("id", "pred")

    ahead = _with_anchors(base.join(order, base["id"] == order["next"]).drop("next"), "text", "next_anchors")  # made behind the shuffle that both joins use
    given = ahead.select("pred", F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("head"), F.array_distinct("next_anchors").alias("next_anchors"), *([F.xxhash64("text").alias("th")] if repeated else []))
    if repeated:
        given = given.groupBy("pred").agg(F.min_by(F.struct("head", "next_anchors"), "th").alias("s")).select("pred", "s.head", "s.next_anchors")
    rows = base.join(given, base["id"] == given["pred"]).drop("pred")
    rows = rows.unionByName(given_rows.where("id is null"), allowMissingColumns=True)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.coalesce(F.substring(F.col("head"), F.lit(1), cut), F.lit(""))))
    rows = _with_anchors(rows.drop("head"), "text", "own", positions=True).drop("text")
    rows = _with_anchors(rows, "edited", "other", positions=True).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = rows.withColumn("next", F.coalesce("next_anchors", F.array().cast("array<int>")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own.hash")).alias("fingerprint"),
        fingerprint(F.col("other.hash")).alias("edited_fingerprint"),
        likeness(F.col("own.hash"), F.col("other.hash")).alias("near_edited"),
        likeness(F.col("own.hash"), F.col("next")).alias("near_next"),
        likeness(placed(F.col("own")), placed(F.col("other"))).alias("placed_edited"),
        F.col("own.word").alias("words"),
        F.col("other.word").alias("edited_words"),
    )
