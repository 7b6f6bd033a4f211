"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors are put in lexicographic order of a number of ``BITS``
concatenated random hash bits (signs of projections), cut into blocks, and each
block is compared with itself and the next one by one matrix product, so every
vector meets at least ``window`` neighbours on both sides.  The order is Spark's
range partitioning and sort, by (pass, hash, id), so equal hashes spread over
partitions; the pairs that straddle a partition's edge are left to other passes.

How many passes there are is not fixed.  Rounds of ``passes`` passes, each with
planes of its own, go on until ``IDLE`` rounds in a row join no two components:
vectors that lie densely (one topic) agree in many bits, so that a pass finds
fewer of their pairs, and get the rounds that they need.  The window grows with
the square root of the number of vectors.  Links joined so far are united across
passes by alternating large-star and small-star.

Links are then counted exactly within each component: its vectors are dealt to
blocks of about ``BLOCK`` and every two blocks are compared by one matrix
product, which returns counts and no pairs.  So a group larger than the window
loses no link between its members.  Vectors with equal components are one class
and are counted with their number.

What is found is not certain: a pair is missed if all rounds miss it and its ends
aren't joined by others.  The README has the recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different length; a null id
stands alone; rows that repeat an id with equal vectors are one node; where an id
has different vectors each has links of its own (those of one id with each other
too) and the id unites their components; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, unite_ids
from .textbytes import runs

BITS = 64
BLOCK = 1024
#: Vectors of a tile that meets the window behind it: a task holds so many rows of cosines, however large the window.
TILE = 512
SEED = 4127
#: Rounds in a row without a new link after which the passes end.
IDLE = 2


def _planes(dim: int, passes: int, turn: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim, turn])).standard_normal((dim, passes * BITS))


def _normal(v: np.ndarray) -> np.ndarray:
    """Rows of a matrix in double precision at length 1, each computed by itself."""
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _good(kind: str):
    """The vectors that can be linked, as bytes of the input's precision, and a digest of their direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            digests: list[bytes | None] = []
            for cell in batch.column(1):
                v = None
                if cell.is_valid and cell.values.null_count == 0 and len(cell.values):
                    v = cell.values.to_numpy(zero_copy_only=False).astype(kind)
                    v = v if np.isfinite(v).all() and v.any() else None
                raw.append(None if v is None else v.tobytes())
                digests.append(None if v is None else hashlib.blake2b(_normal(v.astype(np.float64)[None]).tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(digests, pa.binary())], names=["id", "unit", "digest"])

    return run


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y are linked: a matrix product, and the exact sum where that is too close to tell.

    So a pair is decided alike in whatever blocks it meets.
    """
    cosine = x @ y.T
    near = cosine >= threshold
    for i, j in np.argwhere(np.abs(cosine - threshold) < 1e-11):
        near[i, j] = math.fsum(x[i] * y[j]) >= threshold
    return near


def _deal(passes: int, turn: int, kind: str):
    """Each vector once for each pass of the round, with its hash there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                size = np.array([len(u) for u in batch.column(1).to_pylist()])
                for n in np.unique(size).tolist():
                    part = batch.take(pa.array(np.flatnonzero(size == n)))
                    if n not in planes:
                        planes[n] = _planes(n // np.dtype(kind).itemsize, passes, turn)
                    hashes = np.packbits(_matrix(part.column(1), kind) @ planes[n] > 0, axis=1).view(">i8").astype(np.int64)
                    for k in range(passes):
                        same = [pa.array(np.full(len(part), x, np.int32)) for x in (k, n)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(hashes[:, k].copy()), *part.columns], names=["pass", "dim", "hash", "id", "unit"])

    return run


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return _normal(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64))


def _neighbours(threshold: float, window: int, kind: str):
    """Edges (a, b) from each vector of a block to the smallest of those it is joined with there."""

    def stretch(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for s in range(0, len(ids), TILE):
            block = v[s : s + TILE + window]
            near = _near(block[:TILE], block, threshold)
            at = np.arange(len(near))
            near[at, at] = False
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            near, every = near[rows], ids[s : s + len(block)]
            label = every.copy()
            while True:
                low = np.minimum(np.where(near, label, np.iinfo(np.int64).max).min(axis=1), label[rows])
                after = label.copy()
                np.minimum.at(after, rows, low)
                np.minimum(after, np.where(near, low[:, None], np.iinfo(np.int64).max).min(axis=0), out=after)
                if (after == label).all():
                    break
                label = after
            joined = label != every
            left.append(every[joined])
            right.append(label[joined])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            # the last rows of the batch before come again, so that windows reach over its end
            table = pa.Table.from_batches([tail, batch] if tail is not None else [batch]).combine_chunks()
            whole = table.to_batches()[0] if table.num_rows else batch
            for run_ in runs(iter([whole]), 2):
                if run_.num_rows > 1:
                    t = run_.combine_chunks()
                    a, b = stretch(t.column("id").to_numpy(), _matrix(t.column("unit").combine_chunks(), kind))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            tail = whole.slice(max(0, whole.num_rows - window))

    return run


def _count(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, 3):
            tile = tile.combine_chunks()
            i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
            ids, copies = tile.column("id").to_numpy(), tile.column("copies").to_numpy().astype(np.float64)
            v, block = _matrix(tile.column("unit").combine_chunks(), kind), tile.column("block").to_numpy()
            if i == j:
                near = _near(v, v, threshold)
                np.fill_diagonal(near, False)
                out_ids, out = ids, near @ copies
            else:
                p, q = block == i, block == j
                near = _near(v[p], v[q], threshold)
                out_ids, out = np.concatenate((ids[p], ids[q])), np.concatenate((near @ copies[q], near.T @ copies[p]))
            yield pa.RecordBatch.from_arrays([pa.array(out_ids), pa.array(np.rint(out).astype(np.int64))], names=["id", "links"])

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, passes: int = 8, window: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``n_links``, ``component_id`` and ``kept``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    rows = rows.select("id", F.col("v").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    units = materialize(rows.mapInArrow(_good(kind), "id long, unit binary, digest binary"), "units")
    good = units.where("digest is not null and id is not null")
    none = F.lit(b"")
    several = units.where("id is not null").groupBy("id").agg(F.min(F.coalesce("digest", none)).alias("x"), F.max(F.coalesce("digest", none)).alias("y")).where("x <> y")
    if several.isEmpty():
        found = _links(good, threshold, passes, window, kind)
        out = units.select("id").join(found, F.col("id") == F.col("k"), "left")
    else:  # an id has several vectors: each is a node, and the ids unite the nodes' components at the end
        nodes = materialize(good.dropDuplicates(["id", "digest"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
        found = materialize(_links(nodes.select(F.col("node").alias("id"), "unit", "digest"), threshold, passes, window, kind), "linked")
        own = nodes.select("id", "digest", "node").join(found, F.col("node") == F.col("k")).select("id", "digest", "links", "component")
        by_id = unite_ids(own.select("id", "component"))
        own = own.select(F.col("id").alias("i"), F.col("digest").alias("d"), "links")
        out = units.select("id", "digest").join(own, (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")), "left")
        out = out.join(by_id.withColumnRenamed("id", "j"), F.col("id") == F.col("j"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _links(good: DataFrame, threshold: float, passes: int, window: int, kind: str) -> DataFrame:
    """(k, links, component) of vectors (id, unit, digest); an id has one vector."""
    classes = good.groupBy("digest").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    ranked = materialize(good.select("id", "digest").join(classes, "digest").select("id", "rep", "copies").distinct(), "classes")
    firsts = good.join(ranked.where("id = rep").select("id", "copies").dropDuplicates(["id"]), "id").dropDuplicates(["id"])
    firsts = materialize(firsts.select("id", "copies", "unit"), "firsts")

    reach = max(window, min(4096, 2 * math.isqrt(firsts.count())))
    nodes, turn, idle = None, 0, 0
    while idle < IDLE:
        dealt = firsts.select("id", "unit").mapInArrow(_deal(passes, turn, kind), "pass int, dim int, hash long, id long, unit binary")
        dealt = dealt.repartitionByRange("pass", "dim", "hash", "id").sortWithinPartitions("pass", "dim", "hash", "id")
        edges = materialize(dealt.mapInArrow(_neighbours(threshold, reach, kind), "a long, b long").distinct(), "pairs")
        if nodes is not None:  # links between what is not yet joined
            a, b = (nodes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
            edges = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
            edges = materialize(edges, "joining")
        turn, idle = turn + 1, idle + 1 if edges.isEmpty() else 0
        if not idle:
            known = edges if nodes is None else edges.unionByName(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")))
            nodes = materialize(connected_components(known), "components")
    if nodes is None:
        nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

    sizes = nodes.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    inside = firsts.join(nodes.withColumnRenamed("node", "id"), "id").join(sizes, "component").select("component", "id", "copies", "unit", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    tiles = inside.select("component", F.inline(others), "id", "copies", "unit", "block")
    tiles = tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = tiles.mapInArrow(_count(threshold, kind), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))

    by_rep = nodes.select(F.col("node").alias("rep"), "component").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    found = ranked.join(by_rep, "rep", "left").select(F.col("id").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    return found.groupBy("k").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
