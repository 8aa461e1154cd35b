"""Whitening of embeddings by eigenvectors in mixed precision.

Entries become whole numbers, so counts, sums and deviations are exact. Three passes work on the
distinct vectors, each with partial sums per task: number and sums, then products of centred vectors,
then products of whitened ones. What comes to the driver is a matrix of the vectors' dimension.

There the eigenvectors are found in float32 and corrected by Ogita-Aishima iterations, which are
matrix products only and double the right digits each time; they run in double and end in extended
precision. Eigenvalues that lie closer together than the error of the moment form a cluster. Its
vectors span the right space but are mixed within it; they are separated by solving the small
problem of the cluster alone, and the iterations go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import package_on_workers, stored

SCALE = 256
COMPONENTS = 4
_EXACT = 2 ** 62  # whole numbers below are added and multiplied as longs
_PAIRS = 1 << 17  # rows whose products a task multiplies at once


def refine(a: np.ndarray, x: np.ndarray, rounds: int, separate: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and eigenvectors (columns) of symmetric ``a`` from approximate ``x``.

    With ``separate`` clusters are turned by sub-solves; without, their vectors are only kept orthonormal.
    """
    values = np.zeros(len(a), a.dtype)
    eps, size = np.finfo(a.dtype).eps, np.linalg.norm(a.astype(float))
    for _ in range(rounds):
        r = np.eye(len(a), dtype=a.dtype) - x.T @ x
        s = x.T @ a @ x
        s, r = (s + s.T) / 2, (r + r.T) / 2  # rounding apart from this would be divided by small gaps
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        # Eigenvalues closer than this cannot be told apart by the vectors so far.
        unsure = 2 * (np.linalg.norm(off.astype(float)) + size * np.linalg.norm(r.astype(float)))
        # Nor can any that rounding of the matrix itself may have made different.
        unsure = max(unsure, 64 * np.finfo(float).eps * size)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > unsure
        change = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ change
        for cluster in clusters(values, unsure) if separate else ():
            x[:, cluster] = _separated(a, x[:, cluster])
        if np.abs(change).max() <= 64 * eps:
            break
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def clusters(values: np.ndarray, unsure: float) -> list[np.ndarray]:
    """Places of eigenvalues that neighbours within ``unsure`` connect, of more than one value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > unsure) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def _separated(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` turned within its span so that ``a`` is diagonal there, as far as double precision tells."""
    gram = x.T @ x
    small = x.T @ a @ x
    middle = np.trace(small) / np.trace(gram)
    # The common part of the eigenvalues is taken off first, so that their differences keep their digits.
    lower = np.linalg.inv(np.linalg.cholesky(gram.astype(float))).astype(a.dtype)
    _, turn = np.linalg.eigh((lower @ (small - middle * gram) @ lower.T).astype(float))
    return x @ (lower.T @ turn.astype(a.dtype))


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision."""
    size = float(np.abs(a).max()) or 1.0
    scaled = a.astype(float) / size
    _, start = np.linalg.eigh(scaled.astype(np.float32))
    _, x = refine(scaled, start.astype(float), rounds=12, separate=True)
    # The sub-solves are right to double precision; a few more corrections take their error off too.
    values, x = refine(a.astype(np.longdouble) / np.longdouble(size), x.astype(np.longdouble), rounds=6, separate=False)
    for _ in range(2):  # what the last correction left of first order goes from the scalar products
        x = x + x @ ((np.eye(len(a), dtype=x.dtype) - x.T @ x) / 2)
    return (values * size).astype(float), x.astype(float)


@dataclass
class Whitening:
    """What rows need: number and sums of the fit list, and the leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components of whole-number vectors; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), np.nan)
        return ((x - self.mean) @ self.vectors) * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2, exact at any size."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * most * most < _EXACT:
            away = self.n * x - np.array(self.sums, np.int64)
            return (away * away).sum(1).tolist()
        away = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) for v in (away * away).sum(1)]


def whole_numbers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as floor(256 * c); rows with a null or non-finite entry are left out."""
    entry = F.col(vector)
    sound = entry.isNotNull() & (F.size(entry) > 0) & F.forall(
        entry, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c), F.lit(False)))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    return vectors.filter(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(width: int) -> Callable:
    """Per task the number of vectors and the sum in each dimension, as decimals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            if int(np.abs(x).max(initial=0)) * len(x) >= _EXACT:
                x = x.astype(object)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(0).tolist())]
        # Two limbs, since sums of longs can be longer than a long.
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([t >> 32 for t in total], pa.int64()),
             pa.array([t & 0xFFFFFFFF for t in total], pa.int64()), pa.array([n] * width, pa.int64())],
            ["i", "high", "low", "n"])

    return run


def _products(width: int, project: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Per task the upper half of the sum of outer products of the projected vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, _PAIRS):
                y = project(_matrix(batch.column(0).slice(at, _PAIRS), width))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def _mean_products(fit: DataFrame, width: int, size: int, n: int, project: Callable) -> np.ndarray:
    """The size x size matrix of mean products of the projected fit list."""
    parts = fit.mapInArrow(_products(width, project), "i int, j int, v double")
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, float | None]:
    """The whitening of (vec_id, x) rows, each distinct x once, and its identity error.

    Vectors of another length than the most frequent one (of equals the longest) are left out. None
    if there is no vector.
    """
    package_on_workers(rows.sparkSession)
    distinct = stored(rows.select("x", F.size("x").alias("width")).distinct(), "whitening-fit")
    widths = distinct.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return None, None
    width, chosen = widths.width, distinct.filter(F.col("width") == widths.width).select("x")
    sums = chosen.mapInArrow(_sums(width), "i int, high bigint, low bigint, n bigint").groupBy("i").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("i").collect()
    total, n = [(r.high << 32) + r.low for r in sums], sums[0].n
    mean = np.array([s / n for s in total])
    covariance = _mean_products(chosen, width, width, n, lambda x: x - mean)
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    # What rounding leaves of a direction without variance is no component.
    values = np.where(values > trace * width * np.finfo(float).eps, values, 0.0)[:components]
    model = Whitening(n, total, values, vectors[:, :components],
                      values / trace if trace > 0 else np.full(len(values), np.nan))
    varied = int((values > 0).sum())
    if not varied:
        return model, None
    identity = _mean_products(chosen, width, varied, n, lambda x: model.whitened(x)[:, :varied])
    return model, float(np.abs(identity - np.eye(varied)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Whitened components of every sound row of ``vectors`` (vec_id and an array of numbers).

    Columns: vec_id, component, n, deviation, whitened, explained, identity_error. A row whose vector
    is null, empty or holds a null or non-finite entry is left out, as is one of another length than
    most; there are as many components as dimensions, at most ``components``. A component without
    variance has a null whitened value, and without any variance explained and identity_error are
    null. A deviation beyond a long is null. Repeated rows and ids stay rows of their own and count once
    in the fit. No rows give no rows. Other columns are not read.
    """
    rows = whole_numbers(vectors, vector)
    model, error = fit(rows, components)
    out = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double")
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    width, count = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = _matrix(batch.column(1), width), batch.num_rows
            deviations = [d if d < 2 ** 63 else None for d in model.deviations(x)]
            each = np.repeat(np.arange(size), count)
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                pa.array(np.full(size * count, model.n)), pa.array(deviations, pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(x).reshape(-1), from_pandas=True),
                pa.array(np.tile(model.explained, size), from_pandas=True),
                pa.array([error] * (size * count), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == width).mapInArrow(run, out)
