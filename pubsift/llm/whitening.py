"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

1. Every entry becomes an integer (``floor(256 * c)``), so equal vectors, counts
   and sums are exact.  The fit list, each distinct vector once, is written.
2. One pass over the fit list sums it, a second one sums the products of the
   centred vectors: a task yields one d x d matrix, and tasks add those up.
3. The driver factors the scatter matrix (d x d, however many rows there are) as
   ``P L Lt Pt`` with the largest remaining diagonal first, then rotates pairs of
   columns of the triangular factor until all are orthogonal.  The squared column
   norms are the eigenvalues and the normalised columns the components; the
   scatter matrix itself is never rotated, so small eigenvalues keep their
   relative accuracy.
4. A last pass over the fit list measures how far the covariance of the whitened
   vectors is from the identity.

Cases: null vectors and vectors with null or non-finite entries are dropped; so
are vectors whose number of entries is not the commonest one of the table (ties:
the larger).  Repeated rows and repeated ids give rows each and count once in the
fit; a null vec_id stays null.  Directions of no variance are no components, so
fewer than ``k`` may come out (none for a table of equal vectors); an empty table
gives no rows.  Entries beyond 2^63 stand for 2^63 - 1 or -2^63.  A deviation
beyond 64 bits is null in ``deviation`` and given by ``deviation_text``.  Further
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace

COMPONENTS = 4
SCALE = 256.0
FAN_IN = 64                     # partial sums are added in this many tasks, then in one
BATCH_ROWS = 4096


# --- vectors as keys --------------------------------------------------------

def quantize(values: np.ndarray) -> np.ndarray:
    """``floor(256 * c)`` as 64-bit integers, at most 2^63 - 1."""
    x = np.floor(SCALE * values.astype(np.float64))
    out = np.clip(x, -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)
    out[x >= 2.0 ** 63] = np.iinfo(np.int64).max
    return out


def pack_vector(x: np.ndarray) -> bytes:
    """The shortest of 2, 4 or 8 bytes an entry; equal vectors give equal bytes."""
    for kind in ("<i2", "<i4"):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return kind[-1].encode() + x.astype(kind).tobytes()
    return b"8" + x.astype("<i8").tobytes()


def vector_keys(vectors: pa.Array) -> list[bytes | None]:
    """The packed integers of the vectors of a list array; None for unusable ones."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    flat = vectors.flatten()
    value = flat.to_numpy(zero_copy_only=False)         # a null entry becomes nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
    x = quantize(np.where(np.isfinite(value), value, 0.0))
    return [pack_vector(x[i:j]) if ok else None for i, j, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), usable.tolist())]


def keyed(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """``(vec_id, dim, key)`` of the usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            keys = vector_keys(lists)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lists.value_lengths().cast(pa.int32()), pa.array(keys, pa.binary())],
                names=["vec_id", "dim", "key"])

    picked = rows.select(F.col(row_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    id_type = picked.schema["vec_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"vec_id {id_type}, dim int, key binary").where(F.col("key").isNotNull())


# --- sums over the fit list ---------------------------------------------------

def unpack_vectors(keys: list[bytes]) -> np.ndarray:
    """Vectors of one dimension as rows; those of one width are read together."""
    width = np.array([k[0] for k in keys])
    out = None
    for kind in np.unique(width).tolist():
        some = np.flatnonzero(width == kind)
        raw = np.frombuffer(b"".join(keys[i] for i in some.tolist()), np.uint8).reshape(len(some), -1)
        x = np.ascontiguousarray(raw[:, 1:]).view(f"<i{chr(kind)}")
        out = np.empty((len(keys), x.shape[1]), np.int64) if out is None else out
        out[some] = x
    return out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        keys = batch.column("key").to_pylist()
        for i in range(0, len(keys), BATCH_ROWS):
            yield unpack_vectors(keys[i:i + BATCH_ROWS])


def _summed(rows: DataFrame, partial, shape: tuple[int, ...], kind: str) -> np.ndarray:
    """Add up ``partial(vectors)`` of all batches: one array a task, added up by
    ``FAN_IN`` tasks, then by one."""

    def as_batch(total) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    def each(batches):
        total = np.zeros(shape, kind)
        for x in _matrices(batches):
            total += partial(x)
        yield as_batch(total)

    def add(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            for m in batch.column("m"):
                total += np.frombuffer(m.as_py(), kind).reshape(shape)
        yield as_batch(total)

    parts = rows.mapInArrow(each, "m binary")
    for tasks in (FAN_IN, 1):
        parts = parts.repartition(tasks).mapInArrow(add, "m binary")
    return np.frombuffer(parts.first()["m"], kind).reshape(shape)


def column_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension.  High and low halves
    are added apart, so sums of 2^31 vectors of any size fit."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    total = [int(v) for v in _summed(fit, halves, (2 * dim + 1,), "<i8")]
    return total[0], [(h << 32) + low for h, low in zip(total[1:dim + 1], total[dim + 1:])]


def scatter_matrix(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum of the products of centred vectors."""

    def products(x: np.ndarray) -> np.ndarray:
        y = x - mean
        return y.T @ y

    return _summed(fit, products, (len(mean), len(mean)), "<f8")


# --- eigenvectors -------------------------------------------------------------

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)`` with ``a[order][:, order] = L Lt``; L has a column for each
    pivot above the rounding level of its own entry."""
    a = a.copy()
    n = len(a)
    order, rank = np.arange(n), 0
    factor = np.zeros((n, n))
    floor = n * np.finfo(float).eps * a.diagonal()
    for k in range(n):
        left = np.where(a.diagonal()[k:] > floor[order[k:]], a.diagonal()[k:], -np.inf)
        p = k + int(np.argmax(left))
        if left[p - k] <= 0:
            break
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
        rank = k + 1
    return factor[:, :rank], order


def _pairings(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of 0 .. n - 1 that cover every pair once."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        a, b = np.array(seats[:len(seats) // 2]), np.array(seats[:len(seats) // 2 - 1:-1])
        real = (a < n) & (b < n)
        yield a[real], b[real]
        seats = [seats[0], seats[-1], *seats[1:-1]]


def orthogonal_columns(m: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal (one-sided Jacobi).  The
    pairs of a round share no column and are rotated together."""
    m = m.copy()
    tolerance = max(m.shape) * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for i, j in _pairings(m.shape[1]):
            if not len(i):
                continue
            x, y = m[:, i], m[:, j]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(gamma) / np.sqrt(np.maximum(alpha * beta, np.finfo(float).tiny))
            worst = max(worst, float(off.max()))
            turn = off > tolerance
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            m[:, i], m[:, j] = c * x - s * y, s * x + c * y
        if worst <= tolerance:
            return m
    return m


def principal_axes(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``scatter / n``, falling, and unit eigenvectors as columns;
    directions of no variance are left out."""
    factor, order = pivoted_cholesky(scatter)
    turned = orthogonal_columns(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    by_size = np.argsort(-norms, kind="stable")
    by_size = by_size[norms[by_size] > 0]
    axes = np.zeros((len(scatter), len(by_size)))
    axes[order] = turned[:, by_size] / norms[by_size]
    return norms[by_size] ** 2 / n, axes


# --- the operator -------------------------------------------------------------

class Whitener:
    """Exact sums, components and measures of one fit list."""

    def __init__(self, fit: DataFrame, dim: int, k: int = COMPONENTS):
        self.n, self.sums = column_sums(fit, dim)
        self.mean = np.array([s / self.n for s in self.sums])
        scatter = scatter_matrix(fit, self.mean)
        values, axes = principal_axes(scatter, self.n)
        self.values, self.axes = values[:k], axes[:, :k]
        self.explained = self.values * self.n / np.trace(scatter) if len(values) else self.values
        self.projection = self.axes / np.sqrt(self.values)
        self.identity_error = 0.0
        if len(self.values):
            mean, projection = self.mean, self.projection

            def products(x: np.ndarray) -> np.ndarray:
                w = (x - mean) @ projection
                return w.T @ w

            whitened = _summed(fit, products, (len(self.values),) * 2, "<f8") / self.n
            self.identity_error = float(np.abs(whitened - np.eye(len(self.values))).max())

    def apply(self, rows: DataFrame) -> DataFrame:
        """One row per ``keyed`` row and component."""
        n, sums, mean, projection = self.n, self.sums, self.mean, self.projection
        exact = np.array(sums, dtype=object)

        def deviations(x: np.ndarray) -> list[int]:
            largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
            if len(sums) * largest ** 2 < 1 << 63:
                return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            return ((n * x.astype(object) - exact) ** 2).sum(axis=1).tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, keys = batch.column("vec_id"), batch.column("key").to_pylist()
                for i in range(0, len(keys), BATCH_ROWS):
                    x = unpack_vectors(keys[i:i + BATCH_ROWS])
                    exactly = deviations(x)
                    white = (x - mean) @ projection
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(i, len(x)),
                        pa.array([d if d < 1 << 63 else None for d in exactly], pa.int64()),
                        pa.array([str(d) for d in exactly], pa.string()),
                        pa.array(list(white), pa.list_(pa.float64()))],
                        names=["vec_id", "deviation", "deviation_text", "white"])

        id_type = rows.schema["vec_id"].dataType.simpleString()
        done = rows.select("vec_id", "key").mapInArrow(
            run, f"vec_id {id_type}, deviation long, deviation_text string, white array<double>")
        share = F.array(*[F.lit(float(e)) for e in self.explained])
        return done.select("vec_id", "deviation", "deviation_text", F.posexplode("white").alias("_at", "whitened")).select(
            "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
            "whitened", F.element_at(share, F.col("_at") + 1).alias("explained"),
            F.lit(self.identity_error).alias("identity_error"), "deviation_text")


EMPTY = ("component int, n long, deviation long, whitened double, explained double, identity_error double, "
         "deviation_text string")


def whiten(rows: DataFrame, k: int = COMPONENTS, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_text)`` for every usable row and component up to ``k``."""
    spark = rows.sparkSession
    ws = Workspace(spark, "whitening")
    usable = ws.put(keyed(rows, vector, row_id), "keyed")
    commonest = usable.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if commonest is None or commonest["dim"] == 0:
        id_type = usable.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {id_type}, {EMPTY}")
    usable = usable.where(F.col("dim") == commonest["dim"])
    fit = ws.put(usable.select("key").distinct(), "fit")
    whitener = Whitener(fit, commonest["dim"], k)
    ws.drop("fit")
    return whitener.apply(usable)
