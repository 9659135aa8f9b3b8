"""Whitening of embeddings by an incremental eigendecomposition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .spectrum import EPS, Spectrum

COMPONENTS, FAN = 32, 16
GRID, SHIFT, MOST = 64, 1_000_000, 2.0**62
PART = "slot long, n long, total array<long>, mean array<double>, spread array<double>, axes array<double>"
MOMENTS = "slot long, first array<double>, second array<double>"


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error for every vector that can be used, and each of its first components.

    Entries c become the integers floor(64 c) + 1,000,000 (held within +-2^62). Every partition keeps the eigendecomposition of its own scatter matrix up by one
    centred rank-one update a vector, equal ones of a batch at once; partitions' spectra are put together, sixteen at a time, by rank-one updates in
    turn. In the basis so found the exact covariance is then summed up over all vectors (Rayleigh-Ritz), and its small eigenproblem gives
    components to double precision; a third pass measures how far the whitened covariance is from the identity.

    What goes through the driver is square matrices of the dimension; nothing is shuffled but a few of these a partition, whatever vectors repeat.
    Vectors that are null, or have null or non-finite entries, give no rows, nor do those whose length isn't that of the most (of equals, the
    longer). Repeated rows and keys, and null keys, are rows of their own; other columns are passed over. Of no usable vectors, or of vectors without
    entries, nothing is left. A component without variance (below the dimension times the rounding of the largest) has a null for whitened, and
    identity_error is over the others, null if there is none. deviation is null where it doesn't fit into a long.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector"))
    kind = dict(rows.dtypes)["key"]
    fit = fit_whitening(rows)
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(lambda batches: fit.rows(batches, key, components), schema)


def fit_whitening(rows: DataFrame) -> Whitening | None:
    """The components of rows (key, vector), None if there are none. Four passes over rows, the first of their lengths."""
    usable = rows.where((F.size("vector") > 0) & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    most = usable.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return None
    dim, scratch = most.dim, Scratch(rows.sparkSession)
    spectrum = _in_steps(scratch.table(rows.mapInArrow(lambda batches: _decompose(batches, dim), PART)), _merge, PART, scratch).first()
    scratch.clear()
    n, total = spectrum["n"], np.array(spectrum["total"], dtype=np.int64)
    rough = np.linalg.qr(np.array(spectrum["axes"]).reshape(dim, dim))[0]
    _, second = _moments(rows, Whitening(n, total, rough, np.ones(dim)), dim)
    values, turn = np.linalg.eigh(second / n)
    values, axes = np.maximum(values[::-1], 0), (rough @ turn)[:, ::-1]
    fit = Whitening(n, total, axes, values)
    first, second = _moments(rows, fit, min(COMPONENTS, dim))
    kept = fit.varying[: len(first)]
    first, second = first[kept] / n, second[np.ix_(kept, kept)] / n
    fit.identity_error = float(np.abs(second - np.outer(first, first) - np.eye(kept.sum())).max()) if kept.any() else None
    return fit


class Whitening:
    """n vectors with sums total; components in columns of axes, and their variances, falling."""

    def __init__(self, n: int, total: np.ndarray, axes: np.ndarray, values: np.ndarray) -> None:
        self.n, self.total, self.axes, self.values = n, total, axes, values
        self.varying = values > len(values) * EPS * values.max()
        self.identity_error: float | None = None
        self._whole, self._rest = np.divmod(total, n)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - total / n; the whole part is taken away in integers."""
        return (x - self._whole) - self._rest / self.n

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """The first components of each row of x; 0 where there is no variance."""
        scale = np.where(self.varying, 1 / np.sqrt(np.where(self.varying, self.values, 1)), 0)
        return self.centred(x) @ (self.axes * scale)[:, :components]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - total)^2) of each row."""
        apart = x - self._whole
        size = ((apart.astype(float) * self.n - self._rest) ** 2).sum(1)
        exact = ((self.n * apart - self._rest) ** 2).sum(1)
        return [int(e) if s < MOST else None for e, s in zip(exact, size, strict=True)]

    def rows(self, batches: Iterable[pa.RecordBatch], key: str, components: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _lattice(batch.column(1), len(self.total))
            if not len(at):
                continue
            w = self.whitened(x, components)
            n_rows, k = w.shape
            which = np.tile(np.arange(k), n_rows)
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, k))),
                pa.array(which + 1, pa.int32()),
                pa.array(np.full(n_rows * k, self.n), pa.int64()),
                pa.array(self.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n_rows), k))),
                pa.array(w.ravel(), pa.float64(), mask=~self.varying[which]),
                pa.array((self.values / self.values.sum() if self.values.sum() > 0 else self.values)[which], pa.float64()),
                pa.array([self.identity_error] * (n_rows * k), pa.float64()),
            ]
            names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)


def lattice(entries: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000 of each entry."""
    return np.clip(np.floor(GRID * entries), -MOST, MOST).astype(np.int64) + SHIFT


def _lattice(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and integer entries of the usable vectors of that length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    of_length = np.flatnonzero(lengths == dim)
    if not len(of_length) or not dim:
        return of_length[:0], np.zeros((0, dim), np.int64)
    entries = vectors.take(pa.array(of_length)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)  # nulls are NaN
    usable = np.isfinite(entries).all(1)
    return of_length[usable], lattice(entries[usable])


def _decompose(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Count, sums and spectrum of a partition."""
    spectrum, total = Spectrum(dim), np.zeros(dim, np.int64)
    for batch in batches:
        _, x = _lattice(batch.column(1), dim)
        total += x.sum(0)
        different, times = np.unique(x, axis=0, return_counts=True)
        for row, weight in zip((different - SHIFT).astype(float), times.tolist(), strict=True):
            spectrum.add(row, weight)
    if spectrum.n:
        yield pa.RecordBatch.from_pandas(_as_row(TaskContext.get().partitionId(), spectrum, total))


def _as_row(slot: int, spectrum: Spectrum, total: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"slot": [slot], "n": [spectrum.n], "total": [total], "mean": [spectrum.mean], "spread": [spectrum.values], "axes": [spectrum.vectors.ravel()]})


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    out, total = None, 0
    for row in frame.sort_values("slot").itertuples():
        spectrum = Spectrum.of(row.n, row.mean, row.spread, row.axes)
        total = total + np.array(row.total)
        if out is None:
            out = spectrum
        else:
            out.merge(spectrum)
    return _as_row(int(frame["slot"].iloc[0]) // FAN, out, total)


def _moments(rows: DataFrame, fit: Whitening, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the whitened vectors and of their products, over all vectors."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            w = fit.whitened(_lattice(batch.column(1), len(fit.total))[1], components)
            first += w.sum(0)
            second += w.T @ w
        yield pa.RecordBatch.from_pylist([{"slot": TaskContext.get().partitionId(), "first": first.tolist(), "second": second.ravel().tolist()}])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot")
        return pd.DataFrame({"slot": [int(frame["slot"].iloc[0]) // FAN], "first": [np.stack(frame["first"]).sum(0)], "second": [np.stack(frame["second"]).sum(0)]})

    scratch = Scratch(rows.sparkSession)
    parts = scratch.table(rows.mapInArrow(summed, MOMENTS))
    found = _in_steps(parts, added, MOMENTS, scratch).first()
    scratch.clear()
    return np.array(found["first"]), np.array(found["second"]).reshape(components, components)


def _in_steps(parts: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, scratch: Scratch) -> DataFrame:
    """One row of all, numbered by slot: sixteen neighbours at a time, until one is left."""
    while parts.count() > 1:
        parts = scratch.table(parts.groupBy(F.floor(F.col("slot") / FAN).alias("to")).applyInPandas(merge, schema))
    return parts
