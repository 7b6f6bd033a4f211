"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Entries become integers, ``x = floor(64 * c) + 1000000``.  The covariance is exact:
vectors are centred by whole numbers next to the mean, their products are added up
as integers (float products of blocks so small that no sum is rounded), and the
rest of the mean is taken off in integers too.  So it does not depend on how the
rows are dealt, and no digits cancel.

The covariance is split recursively: the polar factor of ``V - s I`` is its matrix
sign, ``(U + I) / 2`` projects on the invariant subspace above the shift, and both
sides go on until they are of size one or multiples of the identity.  Components
travel to the tasks as one small matrix (dimension by 32) and whiten every row.

Only sums by dimension reach the driver: they don't grow with the rows.

Defined results: rows whose vector is null or holds a null or a non-finite entry are
dropped, as are entries too large for an exact 64-bit integer (their vector counts
as non-finite); of vectors of several lengths the commonest length counts (the
longer of two), others can't be projected and are dropped.  A component without
variance (eigenvalue below d * 2^-52 of the largest) can't be whitened and is
left out, so equal vectors, a single one, or an empty table give no rows.  Rows
that repeat an id, or have none, are rows of their own.  A ``deviation`` beyond a
long is null.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LONG = 1 << 63
#: Largest entry (absolute) whose x is an exact long.
LARGEST = 2.0**55


def qdwh_polar(a: np.ndarray, tol: float = 4e-16) -> np.ndarray:
    """Orthogonal polar factor by QR-based dynamically weighted Halley iterations."""
    n = a.shape[0]
    x = a / max(np.linalg.norm(a, 2 if n <= 64 else "fro"), np.finfo(float).tiny)
    low = np.finfo(float).eps
    for _ in range(30):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
            new = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        else:
            new = (q / r) * x + (p - q / r) * np.linalg.solve(np.eye(n) + r * (x.T @ x), x.T).T
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if abs(1 - low) < 1e-15 and moved <= n * tol ** (1 / 3):
            break
    return x


def _bases(sign: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the positive and negative subspaces of a matrix sign; None where it is none."""
    n = sign.shape[0]
    if np.linalg.norm(sign @ sign - np.eye(n)) > 1e-8 * n:
        return None
    k = round((np.trace(sign) + n) / 2)
    if not 0 < k < n:
        return None
    projector = (sign + np.eye(n)) / 2
    # Subspace iteration with the projector: its columns of largest norm, orthogonalised, projected again.
    first = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    start = projector @ np.linalg.qr(np.hstack([projector[:, first], np.eye(n)]))[0][:, :n]
    u, _ = np.linalg.qr(start @ np.random.default_rng(7).standard_normal((n, k)))
    u, _ = np.linalg.qr(projector @ u)
    whole, _ = np.linalg.qr(np.hstack([u, np.eye(n) - u @ u.T]))
    return whole[:, :k], whole[:, k:n]


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    a = np.asarray(a, float)
    a = (a + a.T) / 2
    n = a.shape[0]
    whole = max(np.linalg.norm(a), np.finfo(float).tiny)
    done: list[tuple[float, np.ndarray]] = []
    open_ = [np.eye(n)]
    while open_:
        basis = open_.pop()
        k = basis.shape[1]
        if k == 0:
            continue
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        diagonal = np.diag(part)
        if k == 1 or np.linalg.norm(part - np.diag(diagonal)) <= 1e-15 * whole:
            done += [(float(diagonal[j]), basis[:, j]) for j in range(k)]
            continue
        split = None
        # The trace's share and the ends of the diagonal give shifts; one that meets an eigenvalue gives no sign.
        centre = diagonal.mean()
        spread = max(np.linalg.norm(part - centre * np.eye(k)) / np.sqrt(k), 1e-16 * whole)
        for shift in (np.median(diagonal), centre, *(centre + spread * t for t in (0.31, -0.37, 0.73, -0.83, 1.3, -1.3, 0.05, -0.05))):
            split = _bases(qdwh_polar(part - shift * np.eye(k)))
            if split is not None:
                break
        if split is None:
            done += [(float(diagonal[j]), basis[:, j]) for j in range(k)]
            continue
        open_ += [basis @ split[0], basis @ split[1]]
    values = np.array([d[0] for d in done])
    vectors = np.column_stack([d[1] for d in done]) if done else np.zeros((n, 0))
    return _refined(a, vectors[:, np.argsort(-values, kind="stable")])


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two correction steps: first-order mixing of components and of their lengths, so that errors square."""
    for _ in range(2):
        gram, mixed = np.eye(x.shape[1]) - x.T @ x, x.T @ a @ x
        values = np.diag(mixed) / (1 - np.diag(gram))
        gap = values[None, :] - values[:, None]
        off = np.abs(mixed - np.diag(np.diag(mixed))).max(initial=0.0) + np.abs(gram).max(initial=0.0) * np.abs(values).max(initial=0.0)
        far = np.abs(gap) > 4 * off
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = np.where(far, (mixed + values[None, :] * gram) / gap, gram / 2)
        np.fill_diagonal(turn, np.diag(gram) / 2)
        x = x + x @ turn
    # The largest components first, each orthogonal to those before it.
    x, r = np.linalg.qr(x)
    x = x * np.where(np.diag(r) < 0, -1.0, 1.0)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _vectors(batch: pa.RecordBatch, length: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as doubles) of a batch's usable vectors, by length."""
    column = batch.column("v")
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
    ends = np.cumsum(np.maximum(sizes, 0))
    for n in sorted(set(sizes.tolist())) if length is None else [length]:
        rows = np.flatnonzero(sizes == n)
        if n <= 0 or not len(rows):
            continue
        block = flat[(ends[rows] - n)[:, None] + np.arange(n)]
        with np.errstate(invalid="ignore"):
            good = (np.abs(block) <= LARGEST).all(axis=1)
        if good.any():
            yield rows[good], block[good]


def _integers(block: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as exact longs: the product is exact, as 64 is a power of two."""
    return np.floor(block * SCALE).astype(np.int64) + SHIFT


def _summed(parts: DataFrame, keys: str) -> list:
    """Sums of (keys, value as decimal text) over tasks, a row for each key, in exact decimals."""
    return parts.groupBy(*keys.split()).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()


def _fit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, dim, value): by length the sum of each dimension; dim -1 counts vectors, -2 bounds entries."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, block in _vectors(batch, None):
            x = _integers(block)
            one = held.setdefault(x.shape[1], [0, 0, [0] * x.shape[1]])
            one[0] += len(x)
            one[1] = max(one[1], int(np.abs(x).max()))
            small = one[1] * len(x) < LONG
            one[2] = [a + int(b) for a, b in zip(one[2], x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
    rows = [(n, j, v) for n, (count, _, sums) in held.items() for j, v in [(-1, count), *enumerate(sums)]]
    largest = [(n, -2, top) for n, (_, top, _) in held.items()]
    for out in (rows, largest):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([str(r[2]) for r in out])], ["length", "dim", "value"])


def _products(length: int, near: list[int]) -> Callable:
    """Sums of y and of y y^T as exact integers, y = x less a whole number next to the mean."""
    centre = np.array(near, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, any_ = np.zeros(length, object), np.zeros((length, length), object), False
        for batch in batches:
            for _, block in _vectors(batch, length):
                y, any_ = _integers(block) - centre, True
                top = max(1, int(np.abs(y).max()))
                step = (1 << 53) // (top * top)
                if step >= 1:
                    for at in range(0, len(y), min(step, 8192)):
                        z = y[at : at + min(step, 8192)].astype(float)
                        products = products + (z.T @ z).astype(np.int64).astype(object)
                else:
                    for row in y.astype(object):
                        products = products + np.outer(row, row)
                sums = sums + y.astype(object).sum(axis=0)
        if any_:
            i, j = np.triu_indices(length)
            first, second = [-1] * length + i.tolist(), list(range(length)) + j.tolist()
            value = [str(v) for v in sums] + [str(v) for v in products[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(value)], ["i", "j", "value"])

    return run


class Whitening:
    """Fitted components: eigenvalues, vectors, exact sums of the fit list."""

    def __init__(self, n: int, sums: list[int], top: int, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.top, self.values, self.vectors, self.trace = n, sums, top, values, vectors, trace

    @property
    def length(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S exactly, and x - S / n rounded once."""
        exact = self.n * (self.top + 1) * 2 < LONG
        moved = self.n * x - np.array(self.sums, np.int64) if exact else self.n * x.astype(object) - np.array(self.sums, object)
        return moved, (moved / self.n).astype(float)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, moved: np.ndarray) -> list[int | None]:
        top = int(np.abs(moved).max(initial=0))
        if moved.dtype == object or top * top * self.length >= LONG:
            return [v if v < LONG else None for v in (int((r.astype(object) ** 2).sum()) for r in moved)]
        return (moved * moved).sum(axis=1).tolist()


def _numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))


def fit(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of all vectors; None where nothing varies."""
    vectors = _numbers(df, id_col, vector_col).select("v")
    first = vectors.mapInArrow(_fit_sums, "length int, dim int, value string")
    added = F.sum(F.when(F.col("dim") != -2, F.col("value").cast("decimal(38,0)")))
    told = materialize(first.groupBy("length", "dim").agg(F.coalesce(added, F.max(F.col("value").cast("decimal(38,0)"))).alias("value")), "sums")
    counts = told.where("dim = -1").orderBy(F.desc("value"), F.desc("length")).limit(1).collect()
    if not counts:
        return None
    length, n = counts[0]["length"], int(counts[0]["value"])
    by_dim = {r["dim"]: int(r["value"]) for r in told.where(F.col("length") == length).collect()}
    sums = [by_dim[j] for j in range(length)]
    near = [(2 * s + n) // (2 * n) for s in sums]
    cells = _summed(vectors.mapInArrow(_products(length, near), "i int, j int, value string"), "i j")
    left = [s - n * m for s, m in zip(sums, near, strict=True)]
    covariance, trace = np.zeros((length, length)), 0
    for r in cells:
        i, j = r["i"], r["j"]
        if i >= 0:
            exact = n * int(r["value"]) - left[i] * left[j]
            covariance[i, j] = covariance[j, i] = exact / n**2
            trace += exact if i == j else 0
    values, components_ = spectral_components(covariance)
    good = np.flatnonzero(values > length * 2.0**-52 * max(values.max(initial=0.0), 0.0))[:components]
    if not len(good):
        return None
    return Whitening(n, sums, by_dim[-2], values[good], components_[:, good], trace / n**2)


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the measured covariance of what was whitened, less the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, any_ = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            for _, block in _vectors(batch, model.length):
                w, any_ = model.whitened(model.centred(_integers(block))[1]), True
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        if any_:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * k + i.tolist(), pa.int32()), pa.array(list(range(k)) + j.tolist(), pa.int32()), pa.array(np.concatenate([sums, products[i, j]]))], ["i", "j", "value"])

    cells = vectors.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    mean = {r["j"]: r["value"] / model.n for r in cells if r["i"] == -1}
    return max(abs(r["value"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in cells if r["i"] >= 0)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: see the columns of the registered query."""
    numbers = _numbers(df, id_col, vector_col)
    kind = dict(numbers.dtypes)["id"]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, id_col=id_col, vector_col=vector_col, components=components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = _identity_error(numbers.select("v"), model)
    sent = df.sparkSession.sparkContext.broadcast(model)  # dimension by components, whatever the rows
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        share = m.values / m.trace
        for batch in batches:
            for rows, block in _vectors(batch, m.length):
                moved, centred = m.centred(_integers(block))
                ids = batch.column("id").take(pa.array(np.repeat(rows, k)))
                much = pa.array(m.deviations(moved), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                size = len(rows) * k
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(size, m.n, np.int64)), much, pa.array(m.whitened(centred).ravel()), pa.array(np.tile(share, len(rows))), pa.array(np.full(size, error))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.mapInArrow(run, schema)
