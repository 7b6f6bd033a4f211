"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Everything runs inside tasks on record batches; documents are taken together in
chunks of a few hundred kilobytes so that temporaries stay in cache, and a
document longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_UNBASE = pow(_BASE, -1, 2**64)
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if _POWERS["n"] < n:
        size = 1 << max(19, int(n).bit_length())
        for key, base in (("up", _BASE), ("down", _UNBASE)):
            a = np.ones(size, np.uint64)
            a[1:] = U64(base)
            _POWERS[key] = np.multiply.accumulate(a)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Chunk:
    first: int  # row of the first document
    starts: np.ndarray  # byte offset of each document, and the end
    data: np.ndarray  # uint8

    def __len__(self) -> int:
        return len(self.starts) - 1


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole documents of about ``size`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield Chunk(i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        i = j


def pieces(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The column in pieces of about ``size`` bytes; a longer text is alone in its piece."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(i, j - i)
        i = j


@dataclass
class Words:
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    doc: np.ndarray  # document of each word, within the chunk
    count: np.ndarray  # words of each document
    hash: np.ndarray  # 64-bit hash of each word, A-Z lower-cased


def words(chunk: Chunk) -> Words:
    data, n = chunk.data, len(chunk.data)
    full = ~_SPACE[data]
    if n:
        begins = full.copy()
        begins[1:] &= ~full[:-1]
        ends = full.copy()
        ends[:-1] &= ~full[1:]
        edge = chunk.starts[(chunk.starts > 0) & (chunk.starts < n)]
        begins[edge] |= full[edge]
        ends[edge - 1] |= full[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    else:
        start = end = np.zeros(0, np.int64)
    cuts = np.searchsorted(start, chunk.starts)
    count = np.diff(cuts)
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, np.repeat(np.arange(len(chunk)), count), count, h)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first columns, of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and any(held[-1].column(k)[-1] != part.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
