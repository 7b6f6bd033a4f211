"""Language identification of mixed-language text.

Words are runs of letters of one script.  The script of a word narrows the
candidates to the languages that training has seen in it; each candidate gets a
score for the word from hashed letter trigrams, and a Viterbi pass over the words
of a document with a penalty for switching labels spans.  A document's language
is the one with most letters in its spans, and its score their share.

Training counts trigrams over all training texts: each task adds up dense tables
of a fixed size, Spark sums them, and the model (``BUCKETS`` numbers for each
language) is read by the driver and travels with the prediction tasks.  Its size
depends on the number of languages alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
as is everything if nothing was learned; texts without a language label teach
nothing; repeated rows are predicted alike; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh
from .textbytes import chunks, pieces

BITS = 18
BUCKETS = 1 << BITS
#: Nats that a change of language between two words costs.
SWITCH = 12.0
#: Share of a language's own letters in a script from which it is a candidate for that script.
CANDIDATE = 0.001
SMOOTH = 0.5
MAX_LANGUAGES = 256
#: Bytes of text whose words a task labels at a time.
PIECE = 4 << 20

# Unicode blocks by script, as (first, last, script).
SCRIPTS = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "thai", "georgian", "hangul", "kana", "han", "other"]
RANGES = [
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x2C60, 0x2C7F, "latin"), (0xFF21, 0xFF5A, "latin"),
    (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x1C80, 0x1C8F, "cyrillic"), (0x2DE0, 0x2DFF, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x08A0, 0x08FF, "arabic"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFF, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x3130, 0x318F, "hangul"), (0xAC00, 0xD7AF, "hangul"),
    (0x3040, 0x30FF, "kana"), (0x31F0, 0x31FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xF900, 0xFAFF, "han"),
]
_PLANE, _HAN_END = 0x20000, 0x40000  # code points from the first up to the second are Han


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Script and lower case of each code point below ``_PLANE``; scripts of what is no letter are 0."""
    chars = [chr(c) for c in range(_PLANE)]
    letter = np.array([c.isalpha() for c in chars])
    script = np.full(_PLANE, SCRIPTS.index("other"), np.uint8)
    for first, last, name in RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    script[~letter] = 0
    lower = np.arange(_PLANE, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        low = chars[c].lower()
        if len(low) == 1 and ord(low) < _PLANE:
            lower[c] = ord(low)
    return script, lower


class Letters:
    """Words and trigram buckets of a chunk of documents."""

    def __init__(self, chunk) -> None:
        script, lower = tables()
        points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.zeros(len(chunk.data) + 1, np.int64)
        np.cumsum((chunk.data & 0xC0) != 0x80, out=ends[1:])
        self.doc_start = ends[chunk.starts]
        small = np.minimum(points, _PLANE - 1)
        kind = script[small]
        kind[(points >= _PLANE) & (points < _HAN_END)] = SCRIPTS.index("han")
        n = len(points)
        new = np.zeros(n + 1, bool)  # a word begins or a gap follows one
        new[1:n] = kind[1:] != kind[:-1]
        new[self.doc_start] = True
        new[n] = True
        cuts = np.flatnonzero(new)
        runs = kind[cuts[:-1]] if n else np.zeros(0, np.uint8)
        full = runs > 0
        self.start, self.end, self.script = cuts[:-1][full].astype(np.int32), cuts[1:][full].astype(np.int32), runs[full]
        self.count = np.diff(np.searchsorted(self.start, self.doc_start))
        # trigrams of each word with one boundary before and one after it
        size = (self.end - self.start + 1).astype(np.int64)
        self.first = np.cumsum(size) - size
        total = int(size.sum())
        letters = np.zeros(total + 2, np.uint32)
        at = np.arange(total) - np.repeat(self.first - self.start, size)
        inner = np.ones(total, bool)
        inner[self.first + size - 1] = False
        body = letters[2:]
        body[inner] = lower[small[at[inner]]]
        a, b, c = letters[:-2], letters[1:-1], body
        a = a * inner_mask(self.first, total)
        self.bucket = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)


def inner_mask(first: np.ndarray, total: int) -> np.ndarray:
    """0 at the first letter of each word, where the letter before last belongs to another word."""
    mask = np.ones(total, np.uint32)
    mask[first] = 0
    return mask


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> dict:
    """Counts of trigram buckets and scripts by language, over all rows with both columns.

    A language costs a megabyte wherever the model is held; a label column with
    more than ``max_languages`` values is refused as a whole, never cut.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages if the executors' memory allows it")
    width = BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: k for k, lang in enumerate(langs)}
        sums = np.zeros((len(langs), width), np.int64)
        for batch in batches:
            own = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for chunk in chunks(batch.column(1)):
                w = Letters(chunk)
                mine = own[chunk.first : chunk.first + len(chunk)]
                for k in np.unique(mine):
                    words = np.repeat(mine == k, w.count)
                    size = w.end - w.start
                    sums[k, :BUCKETS] += np.bincount(w.bucket[np.repeat(words, size + 1)], minlength=BUCKETS)
                    sums[k, BUCKETS:] += np.bincount(w.script[words], weights=size[words], minlength=len(SCRIPTS)).astype(np.int64)
        k, b = np.nonzero(sums)
        for i in range(0, len(k), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[part].astype(np.int32)), pa.array(b[part].astype(np.int32)), pa.array(sums[k[part], b[part]])], names=["k", "b", "n"])

    counted = labelled.mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")) if langs else None
    sums = np.zeros((len(langs), width), np.int64)
    if counted is not None:
        rows = counted.toArrow()
        sums[rows["k"].to_numpy(), rows["b"].to_numpy()] = rows["n"].to_numpy()
    grams, scripts = sums[:, :BUCKETS], sums[:, BUCKETS:].astype(float)
    logp = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)
    allowed = scripts > CANDIDATE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    allowed[:, ~allowed.any(axis=0)] = True
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T), "allowed": np.ascontiguousarray(allowed.T)}


def viterbi(scores: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: documents in step, longest first."""
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    at, length = first[order], count[order]
    active = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # documents with more than t words
    value = np.zeros((len(count), scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, bool)  # the label was switched to at this word
    source = np.zeros(len(scores), np.int16)  # the best label before it
    for t, n in enumerate(active):
        v = value[:n]
        if t:
            best = v.argmax(axis=1)
            other = v[np.arange(n), best] - switch
            row = at[:n] + t
            came[row] = v < other[:, None]
            source[row] = best
            np.maximum(v, other[:, None], out=v)
        v += scores[at[:n] + t]
    label = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        row = at[:n] + t
        now = label[:n]
        labels[row] = now
        if t:
            label[:n] = np.where(came[row, now], source[row], now)
    return labels


def with_language(docs: DataFrame, model: dict, column: str, *, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """The input with ``column``, a struct of ``lang_pred``, ``score`` and, if asked for, ``spans``.

    Only the text travels to the Python workers and only the struct comes back.
    Spans are array<struct<start,end,lang>> in code points, one for each run of
    words with one label.
    """
    langs, logp, allowed = model["langs"], model["logp"], model["allowed"]

    def label(texts: pa.Array) -> pa.StructArray:
        spans: list[list[dict]] = []
        held: list[Letters] = []
        parts: list[np.ndarray] = []
        for chunk in chunks(texts) if langs else []:
            w = Letters(chunk)
            if len(w.start):
                s = np.add.reduceat(logp[w.bucket], w.first, axis=0)
                s[~allowed[w.script]] = -1e5
            else:
                s = np.zeros((0, len(langs)), np.float32)
            del w.bucket, w.first, w.script
            held.append(w)
            parts.append(s)
        count = np.concatenate([w.count for w in held]) if held else np.zeros(len(texts), np.int64)
        scores = np.concatenate(parts) if held else np.zeros((0, 1), np.float32)
        parts.clear()
        labels = viterbi(scores, count, SWITCH)
        del scores
        size = np.concatenate([w.end - w.start for w in held]) if held else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(count)), count)
        letters = np.bincount(doc * max(1, len(langs)) + labels, weights=size, minlength=len(count) * max(1, len(langs))).reshape(len(count), max(1, len(langs)))
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        names = [langs[b] if t else "und" for b, t in zip(best, total, strict=True)]
        shares = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)
        columns = [pa.array(names, pa.string()), pa.array(shares, pa.float64())]
        if with_spans:
            at = 0
            for w in held:
                where = 0
                for d, c in enumerate(w.count):
                    own = labels[at : at + c]
                    cut = np.flatnonzero(np.diff(own)) + 1
                    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [c]))
                    base = w.doc_start[d]
                    spans.append([{"start": int(w.start[where + i] - base), "end": int(w.end[where + j - 1] - base), "lang": langs[own[i]]} for i, j in zip(begin, end, strict=True)] if c else [])
                    at += c
                    where += c
            columns.append(pa.array(spans or [[] for _ in names], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "spans"][: len(columns)])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [label(part) for part in pieces(texts, PIECE)]
            yield pa.concat_arrays(done) if done else label(texts)

    kind = "lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    bounded_batches(docs.sparkSession)
    # not deterministic for Spark, so that a filter on the result doesn't run the model a second time
    return docs.withColumn(column, F.arrow_udf(run, kind).asNondeterministic()(F.col(text_col)))


def predict(docs: DataFrame, model: dict, *, keep: list[str] | None = None, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` of every text, and its ``spans`` if asked for.

    ``keep`` names the columns to carry along, the id by default; columns named
    like those three give way to them.
    """
    made = ["lang_pred", "score", *["spans"] * with_spans]
    kept = [c for c in (["doc_id"] if keep is None else keep) if c not in made]
    found = fresh("_found", docs)
    return with_language(docs, model, found, text_col=text_col, with_spans=with_spans).select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in made])


def train_folds(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> dict:
    """The model of the rows whose crc32 of the id modulo ``folds`` is not ``held``."""
    return train(docs.where(F.crc32(F.col(id_col).cast("string")) % folds != held), text_col=text_col, lang_col=lang_col)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, keep: list[str] | None = None, with_spans: bool = False) -> DataFrame:
    """Learn from the rows whose crc32 of the id modulo ``folds`` is not ``held`` and predict all."""
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    model = train_folds(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds, held=held)
    out = predict(docs, model, keep=[id_col, *[c for c in keep or [] if c != id_col]], text_col=text_col, with_spans=with_spans)
    return out.withColumn("held_out", F.coalesce(fold == held, F.lit(False)))
