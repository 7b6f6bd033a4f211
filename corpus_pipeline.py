"""A training-data pipeline: five stages over ``documents``, each one operator.

Language identification, near-duplicate removal, secret redaction, source mixing
and byte-level BPE encoding.  Each stage takes (spark, docs, sf_dir) and works on
all that the stage before kept; all but the last return the columns of
``documents``, further columns of the input included and unchanged, whatever they
are named.  An empty table gives an empty table in each stage, and a text of any
length is taken whole.

SQL can express none of the stages whole (a trained model, hash minima, a forest,
keyed draws, a tokenizer), so there is no ``ORACLE_SQL``; the tests hold each
stage's operator against a brute-force version or held-out labels, and check the
stages' columns and effects on small tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, langid, minhash, mixing, secret_scan
from tallyframe.llm.common import beside_wide_rows, bounded_batches, discard, fresh, materialize

ORACLE_SQL = None

#: Bytes of an Arrow batch.  Executors and their workers live through all stages, and
#: both keep what a stage's batches once took; a longer text is a batch of its own.
BATCH = 1 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label each text with its language in ``lang``; texts without a letter (``und``) go.

    Null and empty texts hold no letter and go.  A null id teaches nothing but
    is labelled; rows that repeat an id or a text are labelled alike; texts
    without a label in ``lang`` teach nothing, and where none has one, nothing
    is learned, all is ``und`` and goes.  Ties of two languages go to the first by name.
    """
    bounded_batches(spark, BATCH)
    found = fresh("_found", docs)
    out = langid.with_language(docs, langid.train_folds(docs), found)
    return out.where(F.col(f"{found}.lang_pred") != "und").select(*[F.col(f"{found}.lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Null and empty texts are near to nothing and stay, as does a null id; of
    rows that repeat an id one stays.
    """
    bounded_batches(spark, BATCH)
    found = materialize(minhash.near_duplicates(docs).select("doc_id", "kept"), "found")
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "gone")
    out = docs.join(beside_wide_rows(gone, gone.count()), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    repeated = not found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    discard(found)
    if repeated:
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
    return out


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and ``n_chars`` follows; every document stays.

    A null text stays null with its ``n_chars``, an empty one has nothing to
    mask.  Rows that repeat an id are masked by the findings of all of them, and
    rows with a null id likewise.
    """
    out = secret_scan.redact(docs, secret_scan.scan(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each copy that the targets take.

    A null source is one like any other, the last; texts without words (null,
    empty) have size 0 and come as often as their source's passes take them.
    Rows that repeat an id are documents of their own, as are those with a null one.
    """
    return mixing.mix(docs, shard_col=fresh("shard", docs), copy_col=fresh("copy", docs)).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded bytes.

    One row for each row of the input, in the columns of
    :func:`tallyframe.llm.bpe.encode_documents`; a null text has no ids.
    """
    bounded_batches(spark, BATCH)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
