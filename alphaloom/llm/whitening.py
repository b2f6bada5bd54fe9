"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are put on a grid of whole numbers first, x = floor(SCALE * c) + SHIFT, so that equal vectors are equal
bytes and sums and deviations are exact. ``fit`` looks at each distinct vector once: one shuffle of packed
vectors (repeats go before it), written; then their number and sums (whole numbers of any size), then the scatter of
x less its mean, a matrix per task that is added up row by row, so what reaches the driver is one matrix of the
vectors' dimension, whatever their number.

Cholesky with the largest remaining diagonal first stops where the rest is rounding: its rank is that of the data.
Rotations from the right make the columns of the factor orthogonal; as the scatter is factor times its transpose,
the squared column norms are then its eigenvalues and the normalised columns its eigenvectors, and small
ones keep their digits, as nothing is squared. ``Whitening.apply`` is one pass without a shuffle.

Defined cases: a row is dropped if its vector is null or empty, holds a null or a non-finite entry, or has
another dimension than most distinct vectors (of two as frequent, the larger counts); a null id is kept; repeated rows are
one vector in the fit and a row each in the result; entries beyond 2**62 on the grid count as 2**62, and a deviation
beyond 64 bits is null; components of no variance are left out, so a table of one distinct vector, or an empty one, gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import prepare, table, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Tasks that make a scatter matrix each; they read whatever there is.
SCATTER_TASKS = 4096
_LIMIT = 1 << 62
_KINDS = [np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _grids(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension in the batch: the rows with a sound vector of it, and those vectors on the grid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten().fill_null(np.nan), np.float64)
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    sound = (bad[ends] == bad[ends - sizes]) & (sizes > 0)
    out = []
    for size in np.unique(sizes[sound]).tolist():
        rows = np.flatnonzero(sound & (sizes == size))
        picked = values[(ends[rows] - size)[:, None] + np.arange(size)]
        out.append((rows, np.clip(np.floor(picked * SCALE), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT))
    return out


def _pack(x: np.ndarray) -> bytes:
    """A vector less SHIFT in the narrowest integers that hold it: equal vectors, equal bytes."""
    x = x - SHIFT
    low, high = int(x.min()), int(x.max())
    kind = next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind).tobytes()


def _packed(batches):
    for batch in batches:
        for rows, x in _grids(batch.column(0)):
            seen = list({_pack(v) for v in x})
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), x.shape[1], np.int32)), pa.array(seen, pa.binary())], ["dim", "x"])


def _unpacked(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    raw = batch.column(0).to_pylist()
    out = np.empty((len(raw), dim), np.int64)
    for k, v in enumerate(raw):
        out[k] = np.frombuffer(v, _KINDS[{2: 0, 4: 1, 8: 2}[len(v) // dim]])
    return out + SHIFT


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they hold it, else Python's."""
    if n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums)) < _LIMIT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; null beyond 64 bits."""
    most = int(np.abs(d).max(initial=0))
    if d.dtype != object and d.shape[1] * most * most < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    exact = (sum(int(v) * int(v) for v in row) for row in d)
    return [s if s < 1 << 63 else None for s in exact]


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower trapezoidal factor f and order p with a[p][:, p] = f f'; it ends where the rest is rounding."""
    size = len(a)
    order, left = np.arange(size), np.diag(a).copy()
    floor = size * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    f = np.zeros((size, size))
    for k in range(size):
        p = k + int(np.argmax(left[order[k:]]))
        if left[order[p]] <= floor:
            return f[:, :k], order
        order[[k, p]] = order[[p, k]]
        f[[k, p], :k] = f[[p, k], :k]
        at, rest = order[k], order[k + 1 :]
        f[k, k] = np.sqrt(left[at])
        f[k + 1 :, k] = (a[rest, at] - f[k + 1 :, :k] @ f[k, :k]) / f[k, k]
        left[rest] -= f[k + 1 :, k] ** 2
    return f, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` rotated from the right until its columns are orthogonal; a sweep meets every pair once, in rounds of disjoint pairs."""
    rows = factor.T.copy()
    count = len(rows) + len(rows) % 2
    seats = np.arange(count)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(count - 1):
            p, q = seats[: count // 2], seats[count // 2 :][::-1]
            p, q = p[(p < len(rows)) & (q < len(rows))], q[(p < len(rows)) & (q < len(rows))]
            a, b = rows[p], rows[q]
            low, high, both = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            scale = np.sqrt(low * high)
            turn = np.abs(both) > 1e-16 * scale
            worst = max(worst, float((np.abs(both[turn]) / scale[turn]).max(initial=0.0)))
            if turn.any():
                zeta = (high[turn] - low[turn]) / (2 * both[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                c, s = c[:, None], (c * t)[:, None]
                rows[p[turn]], rows[q[turn]] = c * a[turn] - s * b[turn], s * a[turn] + c * b[turn]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if worst < 1e-15 * max(1, len(rows)):
            break
    return rows.T


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` found: vectors, their sums, the leading components as columns, eigenvalues, total variance, and how far from the identity the covariance of the whitened vectors is."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ (self.components / np.sqrt(self.eigenvalues))

    def apply(self, df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """A row per sound vector and component, numbered from 1."""
        found, count = self, len(self.eigenvalues)

        def run(batches):
            for batch in batches:
                for rows, x in _grids(batch.column(1)) if count else []:
                    if x.shape[1] != len(found.sums):
                        continue
                    d = _deviations(x, found.n, found.sums)
                    each = lambda values: np.repeat(values, count)
                    square = pa.array(_squares(d), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(each(rows))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * count, found.n)),
                            square.take(pa.array(each(np.arange(len(rows))))), pa.array(found.whitened(d).ravel()), pa.array(np.tile(found.eigenvalues / found.trace, len(rows))), pa.array(np.full(len(rows) * count, found.identity_error)),
                        ],
                        [key, *(c.split()[0] for c in OUT.split(", "))],
                    )

        picked = df.select(F.col(key), F.col(vector).cast("array<double>").alias("_vector"))
        return picked.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {OUT}")


def _added(parts: DataFrame, size: int, rows: int) -> np.ndarray:
    """The sum of the tasks' matrices, which come as rows (row, values): each row is added up in one task."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[row] = sums.get(row, 0.0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["row", "v"])

    out = np.zeros((rows, size))
    for r in parts.repartition("row").mapInArrow(run, "row int, v binary").collect():
        out[r["row"]] = np.frombuffer(r["v"])
    return out


def _matrix(size: int, rows: int, of):
    """A task of mapInArrow: the sum over batches of the matrix that ``of`` makes of each, as rows."""

    def run(batches):
        total = np.zeros((rows, size))
        for batch in batches:
            total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array([v.tobytes() for v in total], pa.binary())], ["row", "v"])

    return run


def fit(spark: SparkSession, df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct sound vectors of ``df``; see the module's docstring."""
    prepare(spark)
    every = written(spark, df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(_packed, "dim int, x binary").distinct(), "vectors")
    most = every.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    dim, n = most["dim"], most["n"]
    own = every.where(F.col("dim") == dim).select("x").coalesce(SCATTER_TASKS)

    def add(batches):
        total = [0] * dim
        for batch in batches:
            x = _unpacked(batch, dim)
            fits = len(x) * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) < 1 << 63
            total = [a + int(b) for a, b in zip(total, (x if fits else x.astype(object)).sum(axis=0))]
        # in two halves, as sums may be beyond 64 bits
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([t >> 32 for t in total], pa.int64()), pa.array([t & 0xFFFFFFFF for t in total], pa.int64())], ["i", "high", "low"])

    halves = own.mapInArrow(add, "i int, high long, low long").groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    sums = [0] * dim
    for r in halves.collect():
        sums[r["i"]] = (int(r["high"]) << 32) + int(r["low"])

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return _deviations(_unpacked(batch, dim), n, sums).astype(np.float64) / n

    def scatter(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(batch)
        return y.T @ y

    v = _added(own.mapInArrow(_matrix(dim, dim, scatter), "row int, v binary"), dim, dim) / n
    factor, order = pivoted_cholesky(v)
    turned = jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    best = np.argsort(-norms, kind="stable")[:components]
    columns = np.zeros((dim, len(best)))
    columns[order] = turned[:, best] / norms[best]
    found = Whitening(n, sums, columns, norms[best] ** 2, float(np.trace(v)), 0.0)
    if not len(best):
        return found

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = found.whitened(_deviations(_unpacked(batch, dim), n, sums))
        return np.vstack((w.T @ w, w.sum(axis=0)))

    count = len(best)
    moments = _added(own.mapInArrow(_matrix(count, count + 1, products), "row int, v binary"), count, count + 1) / n
    covariance = moments[:count] - np.outer(moments[count], moments[count])
    return Whitening(n, sums, columns, found.eigenvalues, found.trace, float(np.abs(covariance - np.eye(count)).max()))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return fit(spark, rows).apply(rows)
