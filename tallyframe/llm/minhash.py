"""MinHash near-duplicate detection.

Universal hash minima over word shingles, banding, verification by signature and
then on the full sets, and components by alternating large-star and small-star.

Sets.  A-Z are lower-cased and words are runs of other characters than space and
the controls 9 to 13.  A document's set is its distinct shingles of ``width``
words; with fewer words the whole sequence is the one shingle; without words or
text the set is empty.  A shingle is held as a 64-bit hash, so two different
shingles of one pair of documents fall together with a probability below 1e-11
even for sets of ten thousand.

Links.  Two documents are linked if ``100 * |A & B| >= percent * |A | B|``.

How the work is kept linear in the input:

* documents with equal sets are one class, represented by its smallest id, so
  exact copies cost one signature in the bands however many there are;
* a band key is kept only if at least two classes have it;
* within a key no pairs are emitted.  First each member is compared with one hub
  of its key; that joins most of a group.  Keys that still hold several
  components are dealt to blocks of bounded size, and every two blocks of a key
  are compared inside a task, which returns no pairs but only those links that
  join two components.  Pairs inside a component need no comparison, as they
  can't change it.  So every pair that shares a key is compared or already
  connected, without a limit on members or partners;
* a pair with several common keys is compared in the smallest of them alone;
* pairs are first sieved by set size, which is exact, and by the signature of
  the candidates: one bit of each of ``SKETCH`` minima, which must agree as
  expected at the threshold, less 4.5 deviations (a link at the very threshold
  is lost with a probability below 4e-6).

Defined results: a null or empty text has ``n_shingles`` 0 and stands alone; a
null id stands alone with null component and ``kept`` true; rows that repeat an
id are one document under that id, joined to all that any of its texts is linked
with (``n_shingles`` is of the row's own text); an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, discard, materialize, unite_ids
from .textbytes import U64, chunks, mix, runs, words

#: 32 bands of 4 minima: a pair at similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
#: Minima of candidates whose lowest bits make up the signature for verification.
SKETCH = 1024
#: Members, and bytes of their sets, in a block of a key.
BLOCK, BLOCK_BYTES = 1024, 16 << 20

_rng = np.random.Generator(np.random.PCG64(977))
_A = (_rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)[:, None]
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * U64(2) + U64(1)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in row order."""
    salt = _STEP[:width]
    for chunk in chunks(column):
        w = words(chunk)
        h = w.hash
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += h[k : k + n] * salt[k]
        rolled = mix(rolled)
        at = 0
        for count in w.count:
            if count >= width:
                yield np.unique(rolled[at : at + count - width + 1])
            elif count:
                short = (h[at : at + count] * salt[:count]).sum(keepdims=True) + U64(int(count))
                yield mix(short)
            else:
                yield np.zeros(0, np.uint64)
            at += count


def minima(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The minimum under each of the first universal hash functions a*x+b modulo 2^32."""
    x = (shingles >> U64(32)).astype(np.uint32)
    low = np.full(hashes, 0xFFFFFFFF, np.uint32)
    step = max(64, (1 << 17) // hashes)
    for i in range(0, len(x), step):
        values = _A[:hashes] * x[None, i : i + step]
        values += _B[:hashes]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, bands = [], [], []
            for s in shingle_sets(batch.column(1), width):
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(minima(s, BANDS * ROWS)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])

    return run


def _candidates(width: int):
    """Set, signature and short band keys of each candidate."""
    words = SKETCH // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sets, bands, bits = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                low = minima(s, SKETCH)
                counts.append(len(s))
                sets.append(s.tobytes())
                bands.append(band_keys(low).astype(np.int32))
                bits.append(np.packbits(((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).view(np.int64))
            table = np.array(bits, np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int32())), pa.array([b.tobytes() for b in bits], pa.binary()), *(pa.array(table[:, k]) for k in range(words))], names=["id", "n", "shingles", "short", "bits", *(f"s{k}" for k in range(words))])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare_blocks(percent: int, most_differ: int):
    """Links between components (a, b) within two blocks of a key; a tile is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, 3):
            tile = tile.combine_chunks()
            key = tile.column("key")[0].as_py() & 0xFFFFFFFF
            key = key - (1 << 32) if key >> 31 else key
            i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
            comp, n, block = (tile.column(c).to_numpy() for c in ("comp", "n", "block"))
            bits = np.frombuffer(b"".join(tile.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
            short = np.array(tile.column("short").to_pylist(), np.int64).reshape(len(n), -1)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("shingles").combine_chunks()]
            root = {c: c for c in comp.tolist()}

            def find(c: int, root: dict = root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            now = comp.copy()
            links = []
            for a in range(len(n)) if i == j else np.flatnonzero(block == i):
                others = np.arange(a + 1, len(n)) if i == j else np.flatnonzero(block == j)
                others = others[(now[others] != now[a]) & (100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a]))]
                others = others[np.bitwise_count(bits[others] ^ bits[a]).sum(axis=1) <= most_differ]
                common = np.where(short[others] == short[a], short[others], np.int64(1) << 40)
                others = others[common.min(axis=1, initial=np.int64(1) << 41) == key]
                if not len(others):
                    continue
                every = np.concatenate([sets[b] for b in others])
                at = np.minimum(np.searchsorted(sets[a], every), len(sets[a]) - 1)
                same = np.add.reduceat((sets[a][at] == every).astype(np.int64), np.cumsum(n[others]) - n[others])
                for b in others[100 * same >= percent * (n[a] + n[others] - same)]:
                    x, y = find(int(comp[a])), find(int(comp[b]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((x, y))
                        now[(now == x) | (now == y)] = min(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) after links between components."""
    if links.isEmpty():
        return labels
    merged = connected_components(links)
    after = labels.join(merged.withColumnRenamed("node", "comp"), "comp", "left")
    return materialize(after.select("id", F.coalesce("component", "comp").alias("comp")), "labels")


def _by_rows(texts: DataFrame, signed: DataFrame, width: int, percent: int, id_col: str) -> DataFrame:
    """The result where an id has different texts: rows are the nodes, and the ids unite their components at the end."""
    numbered = materialize(texts.where("id is not null").withColumn("node", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, width=width, percent=percent, id_col="node")
    found = materialize(numbered.select("node", "id").join(found.select("node", "n_shingles", F.col("component_id").alias("component")), "node"), "found")
    out = found.select("id", "n_shingles").join(unite_ids(found.select("id", "component")), "id")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))
    return out.unionByName(signed.where("id is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its set size, component, and whether it is kept.

    Returns ``doc_id``, ``n_shingles`` long, ``component_id`` (smallest id that
    can be reached over links, its own included) and ``kept`` (its id is the
    component's).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_signatures(width), "id long, n long, digest binary, bands array<long>"), "signatures")

    several = signed.where("id is not null").groupBy("id").agg(F.min(F.coalesce("digest", F.lit(b""))).alias("x"), F.max(F.coalesce("digest", F.lit(b""))).alias("y")).where("x <> y")
    if not several.isEmpty():
        return _by_rows(texts, signed, width, percent, id_col)

    # classes of equal sets
    copies = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("digest", "rep")
    copies = materialize(copies, "copies")
    members = materialize(signed.select("id", "n", "digest").join(broadcast_if_small(copies, copies.count()), "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "classes")

    # members of keys that at least two classes have
    banded = signed.where("id is not null").join(members.where("n > 0 and id = rep").select("id").distinct(), "id", "left_semi")
    banded = banded.dropDuplicates(["id"]).select("id", F.explode("bands").alias("key"))
    banded = materialize(banded, "banded")
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    open_rows = materialize(banded.join(shared, "key").select("key", "id"), "keys")
    discard(banded)

    # sets and signatures of those
    wanted = materialize(open_rows.select("id").distinct(), "wanted")
    chosen = texts.where("id is not null").join(broadcast_if_small(wanted, wanted.count()), "id", "left_semi").dropDuplicates(["id"])
    bits = [f"s{k}" for k in range(SKETCH // 64)]
    candidates = materialize(chosen.mapInArrow(_candidates(width), "id long, n long, shingles binary, short array<int>, bits binary, " + ", ".join(f"{k} long" for k in bits)), "candidates")
    signatures = candidates.select("id", "n", "short", *bits)
    sets = candidates.select("id", "shingles")

    agree = 0.5 + percent / 200
    low = int(SKETCH * agree - 4.5 * (SKETCH * agree * (1 - agree)) ** 0.5)
    near = (
        (F.col("x.key") == F.col("h.key"))
        & (F.col("x.id") != F.col("h.id"))
        & (100 * F.least("x.n", "h.n") >= percent * F.greatest("x.n", "h.n"))
        & (sum(F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"h.{k}"))) for k in bits) <= SKETCH - low)
        & (F.array_min(F.array_intersect("x.short", "h.short")) == F.shiftright(F.shiftleft("x.key", 32), 32).cast("int"))
    )
    # one hub for each key
    hubs = open_rows.groupBy("key").agg(F.min("id").alias("id"))
    hubs, x = hubs.join(signatures, "id").alias("h"), open_rows.join(signatures, "id").alias("x")
    pairs = x.join(hubs, near).select(F.col("h.id").alias("a"), F.col("x.id").alias("b")).distinct()
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    full = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").select("a", "b", "left", "right")
    found = materialize(full.mapInArrow(_confirm(percent), "a long, b long"), "links")
    labels = _relabel(wanted.withColumn("comp", F.col("id")), found)

    # what is left: keys with several components, block against block
    rows = materialize(open_rows.join(labels, "id").join(signatures.select("id", "n"), "id"), "members")
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    several = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("comps > 1")
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("n") * 8 / BLOCK_BYTES)).cast("int")
    dealt = rows.drop("n").join(several.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    dealt = dealt.join(candidates.select("id", "n", "short", "bits", "shingles"), "id").select("key", F.inline(tiles), "id", "comp", "n", "block", "short", "bits", "shingles")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(dealt.mapInArrow(_compare_blocks(percent, SKETCH - low), "a long, b long").distinct(), "links")
    labels = _relabel(labels, found)
    for step in (signed, open_rows, candidates, rows):
        discard(step)
    comps = labels.select(F.col("id").alias("node"), F.col("comp").alias("component"))

    out = members.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
