"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the eigenvalues and eigenvectors of the scatter of its own rows, about
their own mean. A row is a rank-one update of it: the new eigenvalues are the roots of a
secular equation, after entries that cannot change are deflated, and the new eigenvectors
follow from the roots. Two partitions' spectra are combined in the same way, by one rank-one
update per eigenpair of the second and one for the distance of the means, in rounds that
combine ``FAN`` partitions each. A last pass over the rows forms their covariance in the
basis found and rotates it to the exact eigenvectors (Rayleigh-Ritz). No row leaves its
task, and a task holds one basis, however many rows it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

FAN = 16  # spectra combined by one task in a round
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 50)  # entries beyond count as non-finite: 1024 times them must fit a long


class Spectrum(NamedTuple):
    """Scatter of ``n`` rows about their ``mean``: ``basis @ diag(values) @ basis.T``."""

    n: int
    mean: np.ndarray
    values: np.ndarray  # ascending
    basis: np.ndarray

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d), np.zeros(d), np.eye(d))


def secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z**2 / (poles - x)) for ascending, distinct poles.

    Each root lies between its pole and the next one (the last: below pole + rho |z|**2).
    Returns, per root, the pole it is measured from (the nearer one) and the distance, so
    that differences of roots and poles keep their relative precision. The interpolation is
    by two poles with the slopes of both sides; a step that leaves the bracket bisects it.
    """
    k = len(poles)
    w = rho * z * z
    gap = np.append(np.diff(poles), w.sum())
    lower = np.tri(k, dtype=bool).T  # [j, i]: pole j belongs to the left side of root i
    apart = poles[:, None] - poles[None, :]
    middle = 1 + (w[:, None] / (apart - gap / 2)).sum(0)
    right = (middle < 0) & (np.arange(k) < k - 1)
    origin = np.arange(k) + right
    apart = poles[:, None] - poles[origin][None, :]
    lo = np.where(right, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    hi = np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    base = poles[origin] - poles  # distance of the origin from the left pole
    x, noise, done = (lo + hi) / 2, 4e-16 * np.sqrt(k), np.zeros(k, bool)
    for _ in range(60):
        delta = apart - x
        with np.errstate(all="ignore"):
            q = w[:, None] / delta
            f = 1 + q.sum(0)
            slope = q / delta
            steep = slope.sum(0)
            done |= np.abs(f) <= noise * (1 + np.abs(q).sum(0) + steep * np.abs(x))
            if done.all():
                break
            psi = np.where(lower, slope, 0).sum(0)
            phi = steep - psi
            lo, hi = np.where(f < 0, x, lo), np.where(f >= 0, x, hi)
            one, two = -(x + base), gap - (x + base)
            a = (one + two) * f - one * two * (psi + phi)
            b = one * two * f
            c = f - one * psi - two * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where((new >= lo) & (new <= hi), new, (lo + hi) / 2)
        done |= new == x
        x = np.where(done, x, new)
    return origin, x


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``basis diag(values) basis.T + rho v v.T``, rho > 0.

    Deflation: entries of equal poles are turned into one of them; poles whose entry is zero
    to working precision keep their value and vector.
    """
    z = basis.T @ v
    size = float(z @ z)
    if rho * size == 0:
        return values, basis
    top = max(float(np.abs(values).max()), rho * size)
    tol = 8 * np.finfo(float).eps * top
    close = np.diff(values) <= tol
    if close.any():
        basis = basis.copy()
        starts = np.flatnonzero(close & ~np.append(False, close[:-1]))
        stops = np.flatnonzero(close & ~np.append(close[1:], False)) + 2
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            part = z[a:b].copy()
            norm = np.sqrt(part @ part)
            if norm == 0:
                continue
            part[-1] += np.copysign(norm, part[-1])  # reflector that leaves only the last entry
            part /= np.sqrt(part @ part)
            basis[:, a:b] -= 2 * np.outer(basis[:, a:b] @ part, part)
            z[a:b] = 0
            z[b - 1] = basis[:, b - 1] @ v
    live = np.abs(z) * rho * np.sqrt(size) > tol
    if not live.any():
        return values, basis
    poles, zl = values[live], z[live]
    origin, x = secular_roots(poles, zl, rho)
    delta = (poles[:, None] - poles[origin][None, :]) - x[None, :]  # pole j - root i
    ratio = poles[:, None] - poles[None, :]
    np.fill_diagonal(ratio, 1.0)
    # The entries for which the computed roots are exact, so that vectors stay orthogonal.
    exact = np.abs(np.prod(np.where(np.eye(len(x), dtype=bool), delta, delta / ratio), axis=1))
    exact = np.copysign(np.sqrt(exact), zl)
    vectors = exact[:, None] / delta
    vectors /= np.sqrt((vectors * vectors).sum(0))
    out = values.copy()
    out[live] = poles[origin] + x
    fresh = basis.copy() if not live.all() else basis
    if live.all():
        fresh = basis @ vectors
    else:
        fresh[:, live] = basis[:, live] @ vectors
    order = np.argsort(out, kind="stable")
    return out[order], fresh[:, order]


def add_row(s: Spectrum, y: np.ndarray) -> Spectrum:
    """The spectrum with one more row."""
    delta = y - s.mean
    values, basis = s.values, s.basis
    if s.n:
        values, basis = rank_one(values, basis, delta, s.n / (s.n + 1))
    return Spectrum(s.n + 1, s.mean + delta / (s.n + 1), values, basis)


def combine(one: Spectrum, two: Spectrum) -> Spectrum:
    """The spectrum of the rows of both."""
    if not one.n or not two.n:
        return one if one.n else two
    n = one.n + two.n
    delta = two.mean - one.mean
    values, basis = rank_one(one.values, one.basis, delta, one.n * two.n / n)
    for value, vector in zip(two.values, two.basis.T, strict=True):
        if value > 0:
            values, basis = rank_one(values, basis, vector, float(value))
    return Spectrum(n, one.mean + delta * (two.n / n), values, basis)


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers floor(1024 c) + 100000, of the rows that remain."""
    entry = F.col("v")
    df = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return df.where(entry.isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))


def matrix(b: pa.RecordBatch, d: int, name: str = "x") -> np.ndarray:
    """The rows of a list column, all of length d."""
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(x: DataFrame) -> tuple[int, list[int]]:
    """The row count and exact sums per dimension of the commonest length (ties: the longest)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            col = b.column(0)
            sizes = col.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                rows = flat[starts[sizes == d][:, None] + np.arange(d)]
                high, low = rows >> 32, rows & 0xFFFFFFFF  # two sums that cannot overflow
                sums = [(int(h) << 32) + int(v) for h, v in zip(high.sum(0), low.sum(0), strict=True)]
                n, old = total.get(d, (0, [0] * d))
                total[d] = (n + len(rows), [a + s for a, s in zip(old, sums, strict=True)])
        for d, (n, sums) in total.items():
            cols = [pa.array([d] * d), pa.array(range(d), pa.int64()), pa.array([n] * d), pa.array(map(Decimal, sums), pa.decimal128(38))]
            yield pa.RecordBatch.from_arrays(cols, ["d", "i", "n", "s"])

    parts = x.select("x").mapInArrow(work, "d long, i long, n long, s decimal(38,0)")
    sums = stage(parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")))
    best = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).take(1)
    if not best:
        return 0, []
    found = sums.where(F.col("d") == best[0]["d"]).orderBy("i").collect()  # one row per dimension
    return best[0]["n"], [int(r["s"]) for r in found]


SPECTRUM = "part long, n long, mean array<double>, vals array<double>, basis array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    cols = [pa.array([part]), pa.array([s.n])]
    cols += [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (s.mean, s.values, s.basis)]
    return pa.RecordBatch.from_arrays(cols, ["part", "n", "mean", "vals", "basis"])


def spectrum(x: DataFrame, center: np.ndarray, fan: int = FAN) -> Spectrum:
    """Spectrum of all rows about ``center``: one per partition, then combined in rounds."""
    d = len(center)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = Spectrum.empty(d)
        for b in batches:
            for y in matrix(b, d) - center:
                s = add_row(s, y)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, Spectrum.empty(d)
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != at:
                    if at is not None:
                        yield _row(at, s)
                    at, s = r["part"], Spectrum.empty(d)
                s = combine(s, Spectrum(r["n"], np.array(r["mean"]), np.array(r["vals"]), np.array(r["basis"]).reshape(d, d)))
        if at is not None:
            yield _row(at, s)

    parts = stage(x.select("x").where(F.size("x") == d).mapInArrow(local, SPECTRUM))
    # Partition ids have gaps; a round divides them by the fan-in until one spectrum is left.
    while parts.select("part").distinct().count() > 1:
        keyed = parts.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
        parts = stage(keyed.repartition("part").sortWithinPartitions("part").mapInArrow(merged, SPECTRUM))
    r = parts.first()
    return Spectrum(r["n"], np.array(r["mean"]), np.array(r["vals"]), np.array(r["basis"]).reshape(d, d))


def summed(x: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Sum over all rows of the (k, k + 1) matrix that ``of`` makes of a batch of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for b in batches:
            total += of(matrix(b, d))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            m = matrix(b, k + 1, "row")
            for i, row in zip(b.column(0).to_pylist(), m, strict=True):
                rows[i] = rows.get(i, 0) + row
        if rows:
            cols = [pa.array(list(rows), pa.int64()), pa.array([r.tolist() for r in rows.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["i", "row"])

    schema = "i long, row array<double>"
    parts = x.select("x").where(F.size("x") == d).mapInArrow(work, schema)
    rows = parts.repartition("i").mapInArrow(merged, schema).collect()  # k rows of k + 1
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def outer(y: np.ndarray) -> np.ndarray:
    """Sums of products and of values of a batch of rows."""
    return np.column_stack([y.T @ y, y.sum(0)])


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 8, fan: int = FAN) -> DataFrame:
    """Per remaining row of ``embeddings`` and component (1 to ``top``): ``vec_id``,
    ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    A row is left out if its vector is null or empty, or holds a null, a NaN or an entry of
    2**50 or more in size (infinite ones included), or has another length than most rows
    (ties: than the longest of the commonest lengths). Repeated rows count each time and give
    a row each; a null id stays null; ties of eigenvalues give some orthonormal basis, the
    same for all rows. A component without variance has null ``whitened`` and is not part of
    ``identity_error``; ``explained`` is null if no component has any. ``deviation`` is null
    where it exceeds a long. An empty table gives an empty result; further columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = vectors(embeddings, id_col, vec_col)
    n, sums = exact_sums(x)
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    d = len(sums)
    center = np.array([s / n for s in sums])
    found = spectrum(x, center, fan)
    basis, _ = np.linalg.qr(found.basis[:, ::-1])
    ritz = summed(x, d, lambda rows: outer((rows - center) @ basis), d)
    mean = ritz[:, d] / n
    w = ritz[:, :d] / n - np.outer(mean, mean)  # the mean is that of rounding
    e, turn = np.linalg.eigh((w + w.T) / 2)
    k = min(top, d)
    e, axes = e[::-1][:k], (basis @ turn)[:, ::-1][:, :k]
    trace = float(np.trace(w))
    real = e > 1e-12 * trace
    scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1)), np.nan)
    m = int(real.sum())
    error = None
    if m:
        white = summed(x, d, lambda rows: outer(((rows - center) @ axes * scale)[:, :m]), m)
        cov = white[:, :m] / n - np.outer(white[:, m], white[:, m]) / n**2
        error = float(np.abs(cov - np.eye(m)).max())
    share = [float(v) / trace if trace > 0 else None for v in np.maximum(e, 0)]
    exact = np.array(sums, dtype=object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = matrix(b, d)
            white = (rows - center) @ axes * scale
            reach = n * max(abs(int(rows.min())), abs(int(rows.max()))) + max(abs(s) for s in sums)
            far = rows.astype(object) * n - exact if reach >= 1 << 62 else n * rows - exact.astype(np.int64)
            most = max(abs(int(far.min())), abs(int(far.max())))
            if most * most * d >= 1 << 63:
                far = far.astype(object)
            away = (far * far).sum(1).tolist()
            size = b.num_rows
            cols = [
                b.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, n)),
                pa.array([v if v < 1 << 63 else None for v in away for _ in range(k)], pa.int64()),
                pa.array(white.ravel(), from_pandas=True),
                pa.array(share * size, pa.float64()),
                pa.array([error] * (size * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return x.where(F.size("x") == d).mapInArrow(work, schema)
