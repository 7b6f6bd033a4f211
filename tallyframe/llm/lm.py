"""Language-model scores by logistic context mixing.

The model predicts a text's UTF-8 bytes bit by bit, then an end mark.  For each
bit, one predictor for each order from 0 to ``ORDER`` looks up how often 0 and 1
followed its hashed context (the bytes before, and the bits of this byte so far).
A mixer adds up the predictors' log odds with weights that a gate selects (the
bit's place, the longest context seen before, and how far back the last white space
is) and that are learned online, one
small batch after the other; a final table, indexed by the bits so far and the
mixer's own log odds, refines the probability by what came true.

What is gathered.  All training texts are counted: their words, and their
sequences of ``ORDER`` bytes and the next one, first within tasks and then by
Spark.  The predictors' tables, the weights and the refinement are all learned
from the counted sequences, each weighted by its count, and each taken out of its
own contexts' counts by one occurrence, as an online model would not have seen it.
Contexts are counted in full before one of them gets a slot, and the weights take
the sequences in parts, batches and an order that hashes and counts decide, so the
model is the same however the rows of the input are dealt.
The tables grow with the counted sequences up to ``1 << MAX_BITS`` slots for each
order, so that they can travel to all tasks; the counts stay distributed.  Slots
bear a check of their context, the most frequent context of a slot keeps it, and a
context that finds a foreign slot is unseen.

Scoring.  A task keeps the model's probabilities of recent sequences in a table of
fixed size and evaluates the model for those it lacks.  Each text is then read in
order and the probabilities are refined adaptively by what the text itself has
shown so far: behind a context of 5 bytes, and again of 11, that came ``n`` times
before in this text and ``s`` times with the byte at hand, a probability ``p``
becomes ``(s + k*p) / (n + k)``.  How far a text follows itself is learned online
as well: the model alone and one refinement for each pair of ``STRENGTHS`` start
with equal weights, which every byte multiplies by what each gave it.  The base score needs the training count of each word: the ``COMMON`` most
frequent words (a fixed number) are looked up in the task, and the others go
through a join on the word's 64-bit hash.

The driver holds at most ``(ORDER + 1) << MAX_BITS`` slots of 8 bytes (100 MB) and
``COMMON`` words of 16 bytes, whatever the input.

Defined results: a null text is the empty one (one token, its end; its bits per
byte are those of the end mark); a null id is in no fold, so neither trains nor is
held out; rows that repeat an id or a text are scored each by itself; with nothing
to learn from every bit has probability 1/2; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textbytes import U64, chunks, mix, words

ORDER = 5
MAX_BITS = 21
COMMON = 1 << 18
TOGETHER = 1 << 15
CACHE_BITS = 20
START, END = 0xFE, 0xFF  # bytes that UTF-8 doesn't have
PRIOR = 0.08
GATES = 8 * (ORDER + 2) * (ORDER + 1)
INPUTS = ORDER + 2
REFINED = (256, 33)
BATCH = 512
#: Counted sequences that a learning task takes.
SEQUENCES = 400_000
RATE = 0.3
#: Counts without a dense place that a task holds before it adds them up and hands them on.
HEAP = 1 << 21
#: For each refinement its k behind 5 and behind 11 bytes: large ones trust the model, small ones the text.
STRENGTHS = ((24.0, 6.0), (8.0, 2.0), (2.0, 0.5))


def sequences(chunk) -> tuple[np.ndarray, np.ndarray]:
    """The packed sequences of ORDER bytes and the next one, and how many each text has."""
    raw, cuts = chunk.data.tobytes(), chunk.starts.tolist()
    head, tail = bytes([START]) * ORDER, bytes([END])
    joined = np.frombuffer(b"".join([head + raw[i:j] + tail for i, j in zip(cuts[:-1], cuts[1:], strict=True)]), np.uint8).astype(np.uint64)
    n = len(joined) - ORDER
    packed = joined[:n].copy()
    for k in range(1, ORDER + 1):
        packed <<= U64(8)
        packed |= joined[k : k + n]
    count = np.diff(chunk.starts) + 1
    begin = np.cumsum(count + ORDER) - (count + ORDER)
    if len(count) > 1:
        keep = np.ones(n, bool)
        for k in range(ORDER):
            keep[begin[1:] - ORDER + k] = False
        packed = packed[keep]
    return packed, count


def earlier(key: np.ndarray) -> np.ndarray:
    """How often each 64-bit key stands before its place."""
    n = len(key)
    at, low = np.arange(n, dtype=np.uint64), U64(max(1, (n - 1).bit_length()))
    sorted_ = key >> low
    sorted_ <<= low
    sorted_ |= at  # place and key in one word sort fastest
    sorted_.sort()
    order = (sorted_ & ((U64(1) << low) - U64(1))).view(np.int64)
    full = key[order]
    new = full[1:] != full[:-1]
    sorted_ >>= low
    if np.count_nonzero(new) != np.count_nonzero(sorted_[1:] != sorted_[:-1]):  # keys that differ in the bits left out
        order = np.argsort(key, kind="stable")
        full = key[order]
        new = full[1:] != full[:-1]
    place = at.view(np.int64)
    first = np.zeros(n, np.int64)
    np.multiply(place[1:], new, out=first[1:])
    out = np.empty(n, np.float32)
    out[order] = place - np.maximum.accumulate(first)
    return out


def adapt(packed: np.ndarray, count: np.ndarray, model: np.ndarray) -> np.ndarray:
    """log10 probability of each text, read in order, from the model's log10 probability of each byte."""
    begin = np.cumsum(count) - count
    place = np.arange(len(packed)) - np.repeat(begin, count)
    salt = np.repeat(np.arange(len(count), dtype=np.uint64) * U64(0x9E3779B97F4A7C15), count)

    def back(values: np.ndarray, step: int, outside: int) -> np.ndarray:
        out = np.full(len(values), outside, values.dtype)
        out[step:] = np.where(place[step:] >= step, values[:-step], values.dtype.type(outside))
        return out

    start = int.from_bytes(bytes([START]) * (ORDER + 1), "big")
    grams = [packed & U64((1 << 8 * ORDER) - 1), packed]
    grams += [packed + mix(back(packed, step, start)) for step in (ORDER, ORDER + 1)]  # 11 and 12 bytes
    seen = [earlier(mix(g + salt)) for g in grams]
    behind = [(back(seen[i], 1, 0), seen[i + 1]) for i in (0, 2)]
    ten = math.log(10)
    given = np.exp(model * np.float32(ten))
    sums = [np.add.reduceat(model.astype(np.float64), begin)]
    for strength in STRENGTHS:
        p = given
        for k, (n, s) in zip(strength, behind, strict=True):
            p = (s + np.float32(k) * p) / (n + np.float32(k))
        sums.append(np.add.reduceat(np.log(np.maximum(p, np.float32(1e-30))).astype(np.float64), begin) / ten)
    every = np.array(sums)
    best = every.max(axis=0)
    return best + np.log10((10 ** (every - best)).mean(axis=0))


class Tally:
    """Counts of 64-bit keys, held sorted and merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.loose.append(keys)
        self.size += len(keys)
        if self.size > 1 << 21:
            self.settle()

    def settle(self) -> None:
        if self.loose:
            self.parts.append(np.unique(np.concatenate(self.loose), return_counts=True))
            self.loose, self.size = [], 0
        if len(self.parts) > 4:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([p[1] for p in self.parts])[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[first], np.add.reduceat(counts, first))]

    def rows(self, kind: int, step: int = 200_000) -> Iterator[pa.RecordBatch]:
        self.settle()
        if self.parts:
            self.merge()
            keys, counts = self.parts[0]
            for i in range(0, len(keys), step):
                k = keys[i : i + step].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(counts[i : i + step].astype(np.int64))], names=["kind", "key", "n"])
        self.parts = []

    @property
    def held(self) -> int:
        return sum(len(p[0]) for p in self.parts)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies = [Tally(), Tally()]
    texts = 0
    for batch in batches:
        texts += batch.num_rows
        for chunk in chunks(batch.column(0)):
            tallies[0].add(words(chunk).hash)
            tallies[1].add(sequences(chunk)[0])
        for kind, tally in enumerate(tallies):
            if tally.held > 4_000_000:  # a bounded memory: Spark adds up what comes twice
                yield from tally.rows(kind)
    for kind, tally in enumerate(tallies):
        yield from tally.rows(kind)
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])


def _contexts(packed: np.ndarray) -> list[np.ndarray]:
    before = packed >> U64(8)
    return [((before & U64((1 << 8 * o) - 1)) + U64(o + 1)) * U64(0x9E3779B97F4A7C15) for o in range(ORDER + 1)]


def _slots(contexts: list[np.ndarray], node: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slot and check (1 to 255) of each context with the bits of the byte so far, by order."""
    step = node.astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    for o, c in enumerate(contexts):
        h = c ^ step
        h ^= h >> U64(32)
        h *= U64(0xBF58476D1CE4E5B9)
        yield (h >> U64(64 - bits)).astype(np.int64) + (o << bits), ((h >> U64(20)) & U64(0xFF)).astype(np.uint32) | np.uint32(1)


def _bits(packed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bit, bits of the byte so far behind a leading 1) for each of the 8 bits."""
    byte = (packed & U64(255)).astype(np.int64)
    for place in range(7, -1, -1):
        yield place, (byte >> place) & 1, (byte | 256) >> (place + 1)


def _cells(cell: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(cell), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (cell, n0, n1)], names=["cell", "n0", "n1"])


def _added(cell: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of both counts for each distinct cell."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    return cell[first], np.add.reduceat(n0[order], first), np.add.reduceat(n1[order], first)


def _tables(bits: int):
    """Counts of 0 and 1 by slot and check, none left out.

    The first check that a task meets in a slot is added up in a dense table of
    fixed size, the others in bounded heaps; Spark adds up what several tasks or
    heaps bring, so the sums don't depend on how sequences are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (ORDER + 1) << bits
        sums, owner = np.zeros((2, size), np.int64), np.zeros(size, np.uint8)
        others: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:  # frequent sequences come first and take the dense places
            packed, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            contexts = _contexts(packed)
            for _, bit, node in _bits(packed):
                for slot, check in _slots(contexts, node, bits):
                    free = np.flatnonzero(owner[slot] == 0)[::-1]
                    owner[slot[free]] = check[free]
                    own = owner[slot] == check
                    for b in (0, 1):
                        mine = own & (bit == b)
                        np.add.at(sums[b], slot[mine], n[mine])
                    rest = np.flatnonzero(~own)
                    if len(rest):
                        others.append(((slot[rest] << 8) | check[rest].astype(np.int64), n[rest] * (1 - bit[rest]), n[rest] * bit[rest]))
                        held += len(rest)
            if held > HEAP:
                yield from _cells(*_added(*(np.concatenate(x) for x in zip(*others, strict=True))))
                others, held = [], 0
        if others:
            yield from _cells(*_added(*(np.concatenate(x) for x in zip(*others, strict=True))))
        used = np.flatnonzero(owner)
        yield from _cells((used << 8) | owner[used], sums[0, used], sums[1, used])

    return run


def _dealt(followed: DataFrame, parts: int) -> DataFrame:
    """The sequences in parts and an order that only they and their number decide."""
    return followed.repartition(parts, "key").sortWithinPartitions(F.xxhash64("key"), "key")


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences and their counts, ``size`` at a time wherever the batches end."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy().view(np.uint64)])
        counts = np.concatenate([counts, batch.column(1).to_numpy()])
        whole = len(keys) // size * size
        for i in range(0, whole, size):
            yield keys[i : i + size], counts[i : i + size]
        keys, counts = keys[whole:], counts[whole:]
    if len(keys):
        yield keys, counts


def _since_space(packed: np.ndarray) -> np.ndarray:
    """How many bytes lie behind the last white space, control or start byte, up to ORDER."""
    out = np.full(len(packed), ORDER, np.int64)
    for k in range(ORDER, 0, -1):
        byte = (packed >> U64(8 * k)) & U64(255)
        out[(byte <= U64(32)) | (byte == U64(START))] = k - 1
    return out


class Model:
    def __init__(self, counts: np.ndarray, check: np.ndarray, bits: int) -> None:
        self.counts, self.check, self.bits = counts, check, bits  # uint16 pairs, large counts scaled down together
        self.weights = np.full((GATES, INPUTS), 0.35, np.float32)
        self.weights[:, -1] = 0
        self.refined: np.ndarray | None = None
        self.cells: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """Tables travel compressed: most slots are empty or hold small counts."""
        return self.__dict__ | {"counts": zlib.compress(self.counts.tobytes(), 1), "check": zlib.compress(self.check.tobytes(), 1), "cells": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.counts = np.frombuffer(zlib.decompress(state["counts"]), np.uint16).reshape(-1, 2)
        self.check = np.frombuffer(zlib.decompress(state["check"]), np.uint8)

    def inputs(self, contexts: list[np.ndarray], since: np.ndarray, place: int, bit: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For learning: log odds of each predictor with a constant, and the gate; the occurrence at hand is not yet known."""
        x = np.empty((len(bit), INPUTS), np.float32)
        seen, rows = np.zeros(len(bit), np.int64), np.arange(len(bit))
        for o, (slot, check) in enumerate(_slots(contexts, node, self.bits)):
            n = self.counts[slot].astype(np.float32)
            n[self.check[slot] != check] = 0
            n[rows, bit] = np.maximum(n[rows, bit] - 1, 0)
            n += PRIOR
            x[:, o] = np.log(n[:, 1] / n[:, 0])
            seen = np.where(n.sum(axis=1) > 2 * PRIOR + 0.5, o + 1, seen)
        x[:, -1] = 0.3
        return x, (place * (ORDER + 1) + since) * (ORDER + 2) + seen

    def ready(self) -> None:
        """For scoring: a slot's check and its log odds in one cell, in place of the counts."""
        odds = np.empty(len(self.counts), np.float16)
        for i in range(0, len(odds), 1 << 20):
            n = self.counts[i : i + (1 << 20)].astype(np.float32) + np.float32(PRIOR)
            odds[i : i + (1 << 20)] = np.log(n[:, 1] / n[:, 0])
        self.cells = (self.check.astype(np.uint32) << np.uint32(16)) | odds.view(np.uint16)
        self.counts = self.check = np.zeros((0, 2), np.uint16)

    def refine(self, odds: np.ndarray, node: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(odds, -14, 14)))
        if self.refined is not None:
            at = np.clip(odds * 2 + 16, 0, 31.999)
            low = at.astype(np.int64)
            part = at - low
            p = 0.5 * p + 0.5 * (self.refined[node, low] * (1 - part) + self.refined[node, low + 1] * part)
        return np.clip(p, 1e-6, 1 - 1e-6)

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each sequence after those before it."""
        if self.cells is None:
            self.ready()
        total = np.zeros(len(packed), np.float64)
        contexts, since, by_input = _contexts(packed), _since_space(packed), np.ascontiguousarray(self.weights.T)
        for place, bit, node in _bits(packed):
            seen, inputs = np.zeros(len(packed), np.int64), []
            for o, (slot, check) in enumerate(_slots(contexts, node, self.bits)):
                cell = self.cells[slot]
                hit = (cell >> np.uint32(16)) == check
                inputs.append((cell & np.uint32(0xFFFF)).astype(np.uint16).view(np.float16).astype(np.float32) * hit)
                seen[hit] = o + 1
            gate = (place * (ORDER + 1) + since) * (ORDER + 2) + seen
            odds = by_input[-1][gate] * np.float32(0.3)
            for x, w in zip(inputs, by_input, strict=False):
                odds += x * w[gate]
            p = self.refine(odds, node)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def _learn_weights(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, square, total = model.weights.copy(), np.full(model.weights.shape, 1e-2, np.float32), 0.0
        for packed, counts in _groups(batches, BATCH):
            n = counts.astype(np.float32)
            total += float(counts.sum())
            contexts, since = _contexts(packed), _since_space(packed)
            for place, bit, node in _bits(packed):
                x, gate = model.inputs(contexts, since, place, bit, node)
                p = 1 / (1 + np.exp(-np.clip((x * w[gate]).sum(axis=1), -14, 14)))
                push = ((bit - p) * n).astype(np.float32)[:, None] * x
                g, mass = np.zeros_like(w), np.zeros(len(w), np.float32)
                np.add.at(g, gate, push)
                np.add.at(mass, gate, n)
                g /= np.maximum(mass, 1e-9)[:, None]
                square += g * g
                w += RATE * g / np.sqrt(square) * 0.1
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([w.ravel().astype(np.float64)], pa.list_(pa.float64()))], names=["total", "w"])

    return run


def _learn_refinement(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, *REFINED), np.float64)
        for packed, counts in _groups(batches, 8192):
            n, contexts, since = counts.astype(np.float64), _contexts(packed), _since_space(packed)
            for place, bit, node in _bits(packed):
                x, gate = model.inputs(contexts, since, place, bit, node)
                at = np.clip((x * model.weights[gate]).sum(axis=1) * 2 + 16, 0, 31.999)
                low = at.astype(np.int64)
                part = at - low
                for b in (0, 1):
                    m = bit == b
                    np.add.at(sums[b], (node[m], low[m]), (n * (1 - part))[m])
                    np.add.at(sums[b], (node[m], low[m] + 1), (n * part)[m])
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["s"])

    return run


def _vector_sum(df: DataFrame, column: str, by: str | None = None) -> np.ndarray | None:
    """Sum of equally long arrays over all rows, element by element, by Spark; in decimals, which have no order."""
    value = (F.col("v") * F.col("t") if by else F.col("v")).cast("decimal(38,10)")
    rows = df.select(*([F.col(by).alias("t")] if by else []), F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum(value).cast("double").alias("s"), *([F.sum("t").alias("t")] if by else [])).toArrow()
    if not rows.num_rows:
        return None
    out = np.zeros(rows.num_rows)
    out[rows["i"].to_numpy()] = rows["s"].to_numpy() / (np.maximum(rows["t"].to_numpy(), 1e-9) if by else 1)
    return out


def train(texts: DataFrame) -> tuple[Model, DataFrame, int]:
    """The model of a one-column table of texts, its word counts (key, n), and its number of texts."""
    counted = materialize(texts.mapInArrow(_gather, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    n_texts = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    followed = counted.where("kind = 1").select("key", "n")
    n_sequences = followed.count()
    bits = min(MAX_BITS, max(12, (4 * n_sequences).bit_length()))
    parts = 1 + n_sequences // SEQUENCES  # tables of a fixed size add up best over many sequences
    cells = followed.coalesce(parts).sortWithinPartitions(F.col("n").desc(), "key").mapInArrow(_tables(bits), "cell long, n0 long, n1 long")
    cells = cells.select(F.shiftright("cell", 8).cast("int").alias("slot"), "cell", "n0", "n1").repartition("slot").groupBy("slot", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    slots = cells.groupBy("slot").agg(F.max(F.struct((F.col("n0") + F.col("n1")).alias("n"), F.col("cell").bitwiseAND(F.lit(255)).alias("check"), "n0", "n1")).alias("s")).select("slot", "s.check", "s.n0", "s.n1")
    scale = F.greatest(F.lit(1.0), F.greatest("n0", "n1") / 60000)
    small = lambda c: F.when(F.col(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.round(F.col(c) / scale))).cast("long")
    rows = slots.select("slot", (small("n0") + F.shiftleft(small("n1"), 16) + F.shiftleft(F.col("check").cast("long"), 32)).alias("cell")).toArrow()
    counts, check = np.zeros((ORDER + 1) << bits, np.uint32), np.zeros((ORDER + 1) << bits, np.uint8)
    for part in rows.to_batches():
        at, cell = part.column(0).to_numpy(), part.column(1).to_numpy()
        counts[at], check[at] = (cell & 0xFFFFFFFF).astype(np.uint32), (cell >> 32).astype(np.uint8)
    del rows
    model = Model(counts.view(np.uint16).reshape(-1, 2), check, bits)
    w = _vector_sum(_dealt(followed, parts).mapInArrow(_learn_weights(model), "total double, w array<double>"), "w", "total") if n_texts else None
    if w is not None:
        model.weights = w.reshape(GATES, INPUTS).astype(np.float32)
        sums = _vector_sum(_dealt(followed, parts).mapInArrow(_learn_refinement(model), "s array<double>"), "s").reshape(2, *REFINED)
        centre = 1 / (1 + np.exp(-(np.arange(REFINED[1]) - 16) / 2))
        model.refined = ((sums[1] + 20 * centre) / (sums.sum(axis=0) + 20)).astype(np.float32)
    return model, counted.where("kind = 0").select("key", "n"), n_texts


def _score(model: Model, known: tuple[np.ndarray, np.ndarray]):
    """A row for each text, with its rarer words and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = np.full(1 << CACHE_BITS, ~U64(0)), np.zeros(1 << CACHE_BITS, np.float32)  # no sequence is all ones
        common, common_log = known
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.first, len(chunk))
                packed, count = sequences(chunk)
                at = (packed * U64(0x9E3779B97F4A7C15) >> U64(64 - CACHE_BITS)).astype(np.int64)
                value = logs[at]
                missed = np.flatnonzero(keys[at] != packed)
                if len(missed):
                    new, back = np.unique(packed[missed], return_inverse=True)
                    fresh = np.concatenate([model.log10(new[i : i + 8192]) for i in range(0, len(new), 8192)]).astype(np.float32)
                    value[missed] = fresh[back]
                    place = (new * U64(0x9E3779B97F4A7C15) >> U64(64 - CACHE_BITS)).astype(np.int64)
                    keys[place], logs[place] = new, fresh
                score, ends, i, first = [], np.cumsum(count), 0, 0
                while i < len(count):  # a few texts at a time, so that the arrays stay in cache
                    j = max(i + 1, int(np.searchsorted(ends, first + TOGETHER, "right")))
                    score.append(adapt(packed[first : ends[j - 1]], count[i:j], value[first : ends[j - 1]]))
                    i, first = j, int(ends[j - 1])
                score = np.concatenate(score)
                w = words(chunk)
                where = np.minimum(np.searchsorted(common, w.hash), max(0, len(common) - 1))
                hit = common[where] == w.hash if len(common) else np.zeros(len(w.hash), bool)
                base = np.bincount(w.doc[hit], weights=common_log[where[hit]] if len(common) else None, minlength=len(chunk)).astype(np.float64)
                n_known = np.bincount(w.doc[hit], minlength=len(chunk))
                rare, doc = w.hash[~hit], w.doc[~hit]
                order = np.lexsort((rare, doc))
                rare, doc = rare[order], doc[order]
                new = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])))[: len(rare)])
                times = np.diff(np.append(new, len(rare)))
                cuts = pa.array(np.searchsorted(doc[new], np.arange(len(chunk) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (rare[new].view(np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([ids, *lists, *(pa.array(x.astype(np.int64)) for x in (np.diff(chunk.starts), w.count, n_known)), pa.array(base), pa.array(score)], names=["id", "rare", "times", "bytes", "n", "known", "base", "score"])

    return run


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0) -> DataFrame:
    """Learn from the rows whose crc32 of the id modulo ``folds`` is not ``held``; score all.

    Returns the id, ``held_out``, ``n_tokens`` (words and the end), ``n_known``,
    ``train_tokens``, ``base_score`` (unigram with 0.1 added) and ``score``, both
    log10 probabilities of the text; and ``bits_per_byte``, the model's total bits
    over the text's bytes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fold = F.crc32(F.col("id").cast("string")) % folds
    model, counts, n_texts = train(rows.where(fold != held).select("text"))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, v = (total["n"] or 0) + n_texts, total["v"] + (n_texts > 0)
    floor = float(np.log10(n_train + 0.1 * (v + 1)))
    top = counts.orderBy(F.col("n").desc(), "key").limit(COMMON).toArrow()
    order = np.argsort(top["key"].to_numpy().view(np.uint64))
    known = top["key"].to_numpy().view(np.uint64)[order], np.log10(top["n"].to_numpy()[order] + 0.1)

    scored = rows.mapInArrow(_score(model, known), f"id {rows.schema['id'].dataType.simpleString()}, rare array<long>, times array<long>, bytes long, n long, known long, base double, score double")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # the row's number is written, so it holds for both reads
    rare = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    joined = rare.join(counts.withColumnRenamed("key", "word"), "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rest"))
    out = scored.join(joined, "row", "left")
    end = float(np.log10(n_texts + 0.1))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(n_texts > 0)).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + end - (F.col("n") + 1) * floor).alias("base_score"),
        "score",
        (F.col("score") * (-math.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
