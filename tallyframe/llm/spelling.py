"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted over all texts.  Two words are near if one inserted, deleted or
replaced code point makes one of the other; a word's *form* is its near word of
largest count where that is at least ten times its own, and its *root* is where
the forms end.

Near words are found in a reduced alphabet: letters are dealt to a few symbols,
balanced by their counts; each reduced word's whole neighbourhood of one edit is
generated, joined to the reduced vocabulary, and what meets is verified on the
original words.  An edit of the original is one edit or none of the reduced word,
so nothing is missed, whatever the symbols.  Of a pair's two neighbourhoods the
one of the smaller key is joined, which halves what is shuffled.

Reduced words are keyed by polynomial hashes modulo 2^64, and the keys of a
neighbourhood follow from running sums: a word of any length has keys in
proportion to its length, never texts.  Equal keys of unlike words cost a failed
verification, no result.  The number of symbols grows with the counted vocabulary
(the tenth root, at least four), so that a key keeps few words; the results don't
depend on it.

Defined results: null and empty texts hold no word; a null id counts as the empty
text in the edit by checksum; repeated rows count each time; ties of a form go to
the smallest word in code-point order; an empty table, or one without words that
repeat, gives an empty result; further columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
EDIT_EVERY = 31
#: Distinct words a task holds before it passes its counts on.
HELD = 200_000
#: Keys a task holds at once.
KEYS = 1 << 20

#: Letters A-Z, a-z and U+00C0 to U+00FF as UTF-8, after A-Z became a-z.
_RUN = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _words_of(doc_id: str | None, text: bytes, least: int) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of one text, each run edited where its checksum says so."""
    began = zlib.crc32(((doc_id or "") + ":").encode())
    for run, n in Counter(m[0] for m in _RUN.finditer(text.translate(_LOWER)) if m.end() - m.start() >= least).items():
        h = zlib.crc32(run, began)
        if h % EDIT_EVERY == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        if len(run) - run.count(b"\xc3") >= least:
            yield run, n


def _counter(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                if (raw := text.cast(pa.binary()).as_py()) is not None:
                    for word, n in _words_of(doc_id.as_py(), raw, least):
                        held[word] += n
                    if len(held) >= HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of whole texts with at least ``min_length`` code points and ``min_count`` occurrences.

    Tasks count what they read and pass on bounded tables of counts, so a word
    that every text holds travels once for each such table.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = texts.mapInArrow(_counter(min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_symbols(words: DataFrame, symbols: int) -> dict[str, int]:
    """Letters dealt to ``symbols`` symbols, the most frequent first, each to the symbol with the least so far.

    The driver gets one row for each distinct letter.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    load, dealt = [0] * symbols, {}
    for r in sorted(letters, key=lambda r: (-r["count"], r["c"])):
        at = load.index(min(load))
        load[at] += r["count"]
        dealt[r["c"]] = at + 1
    return dealt


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def neighbour_keys(reduced: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of all one-edit neighbours of reduced words of one length, a row for each word, repeats included; the word's own key comes first."""
    k, n = reduced.shape
    power = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros((k, n + 1), np.uint64)
        np.cumsum(reduced * power[:n], axis=1, out=sums[:, 1:])
        whole = sums[:, -1:]
        deleted = sums[:, :-1] + (whole - sums[:, 1:]) * np.uint64(_INVERSE)
        parts = [whole, deleted]
        for c in range(1, symbols + 1):
            parts.append(whole + (np.uint64(c) - reduced) * power[:n])
            parts.append(sums + np.uint64(c) * power + (whole - sums) * np.uint64(_BASE))
    return np.hstack(parts)


def _keyed(of: dict[str, int], symbols: int):
    table = {ord(c): s for c, s in of.items()}

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for w in batch.column("word").to_pylist():
                by_length.setdefault(len(w), []).append(w)
            for n, words in by_length.items():
                step = max(1, KEYS // ((2 * symbols + 1) * (n + 1)))
                for at in range(0, len(words), step):
                    some = words[at : at + step]
                    points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
                    codes, inverse = np.unique(points, return_inverse=True)
                    yield some, np.array([table.get(int(c), 1) for c in codes], np.uint64)[inverse].reshape(len(some), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, reduced in chunks(batches):
            keys = neighbour_keys(reduced, symbols).view(np.int64)
            own = keys[:, 0].copy()
            keys.sort(axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            new &= keys >= own[:, None]
            ends = np.concatenate([[0], np.cumsum(new.sum(axis=1))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[new]))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(own), listed], ["word", "own", "keys"])

    return run


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, near): every two words of ``words.word`` (distinct) that are one edit apart, in both orders."""
    if symbols is None:
        symbols = max(4, int(np.ceil(max(words.count(), 1) ** 0.1)))
    bounded_batches(words.sparkSession, 1 << 20)
    keyed = materialize(words.select("word").mapInArrow(_keyed(letter_symbols(words, symbols), symbols), "word string, own long, keys array<long>"), "neighbours")
    asked = keyed.select(F.col("word").alias("a"), F.posexplode("keys").alias("place", "key"))
    held = keyed.select(F.col("word").alias("b"), F.col("own").alias("key"))
    # Place 0 is the word's own key, under which words of one key meet in both orders; elsewhere each pair meets once.
    met = asked.join(held.hint("shuffle_hash"), "key").where("place > 0 or a < b").where("abs(length(a) - length(b)) <= 1").where(F.levenshtein("a", "b", 1) == 1)
    pairs = materialize(met.select("a", "b"), "near")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))


def variant_groups(words: DataFrame, *, ratio: int = RATIO, symbols: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n; words distinct).

    Counts rise by ``ratio`` from a word to its form, so the chains to the roots
    are short; each round joins every word to its form's form.
    """
    near = near_pairs(words, symbols)
    met = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    # The first by falling count, then by the text's bytes, which order as code points do.
    best = F.min(F.struct((-F.col("m")).alias("less"), "near"))
    told = met.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).withColumn("m", -F.col("best.less"))
    enough = F.col("m") >= ratio * F.col("n")
    forms = words.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("m")).alias("form_n"))
    forms = materialize(forms, "forms")
    chains = forms.where("form is not null").select("word", F.col("form").alias("root"))
    written = None
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(chains.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if written is not None:
            discard(written)
        chains, written = after.select("word", "root"), after
        if after.where("moved").isEmpty():
            break
    return forms.join(chains, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variant_groups` of the words that :func:`count_words` finds in ``docs``."""
    return variant_groups(materialize(count_words(docs, id_col=id_col, text_col=text_col), "words"))
