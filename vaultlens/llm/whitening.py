"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors are taken on a grid: x = floor(scale * c) of each entry. The fit list holds each distinct x once, so that a vector
with a million copies weighs as much as any other. Its size n and sums S are exact integers. The scatter is summed over rows
centred at S / n, in tasks, and only the d x d sums reach the driver; d is the length of a vector and does not grow with the rows.

With pivoting, P'VP = LL'. Rotations from the right make L's columns orthogonal and leave LL' as it is, so the columns end
as the eigenvectors of V, each as long as the root of its eigenvalue. V itself is never squared nor rotated from two sides, which keeps the small
eigenvalues. Columns whose pivot is lost in rounding don't enter: they have no variance to divide by.

Defined results: a row is dropped if its vector is null or holds a null, a NaN, an infinity or an entry whose x is no long, or if its length
is not the commonest one (the longer of equals): it is no point of the space. Repeated rows are each returned, null vec_ids too. There are as many
components as V has rank, ``most`` at most: an empty table, and one whose vectors are all equal, give no rows. Components of equal eigenvalue are
any orthonormal basis of their space, the same for all rows. Other columns are not read. A deviation beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = LL' up to rounding, a column for each pivot; in pivot order its rows are lower triangular."""
    rest, out = np.array(v, np.float64), []
    least = len(v) * np.finfo(np.float64).eps * max(np.diag(rest).max(initial=0.0), 0.0)
    for _ in range(len(v)):
        at = int(np.argmax(np.diag(rest)))
        if rest[at, at] <= least:
            break
        column = rest[:, at] / np.sqrt(rest[at, at])
        out.append(column)
        rest -= np.outer(column, column)
        rest[at, :] = rest[:, at] = 0.0
    return np.array(out).T.reshape(len(v), len(out))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal, the longest first. Each round rotates disjoint pairs, and a sweep has all pairs."""
    a = np.array(factor, np.float64)
    k = a.shape[1]
    if k > 1:
        ring = np.arange(k + k % 2)
        for _ in range(sweeps):
            worst = 0.0
            for _ in range(len(ring) - 1):
                p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
                real = (p < k) & (q < k)
                p, q = p[real], q[real]
                x, y = a[:, p], a[:, q]
                aa, bb, ab = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
                bound = np.sqrt(aa * bb)
                off = np.divide(np.abs(ab), bound, out=np.zeros_like(ab), where=bound > 0)
                worst = max(worst, float(off.max(initial=0.0)))
                turn = off > 1e-16
                zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
                s = np.where(turn, t, 0.0) * c
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if worst < 1e-14:
                break
    return a[:, np.argsort(-(a * a).sum(0), kind="stable")]


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list; eigenvalues falling, unit components as columns, the trace of V."""

    scale: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


def lengths(vectors: DataFrame, column: str) -> int:
    """The commonest length of a vector, the longer of equals; 0 without any."""
    found = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def on_grid(vectors: DataFrame, column: str, scale: int, d: int) -> DataFrame:
    """``vectors`` with x, an array of longs; rows that are no points of the space are dropped."""
    entry = lambda c: c.cast("double")
    real = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) * scale < float(2**62)))
    x = F.transform(column, lambda c: F.floor(entry(c) * scale).cast("long"))
    return vectors.filter(F.col(column).isNotNull()).filter((F.size(column) == d) & F.coalesce(real, F.lit(False))).withColumn("x", x)


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(points: DataFrame, cells: int, kind: str, of) -> np.ndarray:
    """``of`` (rows to ``cells`` numbers) summed over all of ``points``: a row a cell and task, then a sum by cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "v"])

    out = np.zeros(cells, np.int64 if kind == "long" else np.float64)
    for r in small_batches(points.select("x")).mapInArrow(task, f"cell long, v {kind}").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out


def distinct_points(points: DataFrame) -> DataFrame:
    """Each x once, written in the shared folder."""
    return stored(points.select("x").distinct())


def fit(fit_list: DataFrame, d: int, scale: int) -> Whitening:
    """The whitening of a list of points that all have ``d`` entries."""
    if not d:
        return Whitening(scale, 0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        x = _rows(batch, d)
        if np.abs(x.astype(np.float64)).sum(0).max() > 2.0**62:
            raise OverflowError("sums of entries are no longs")
        return np.append(x.sum(0), len(x))

    counted = _summed(fit_list, d + 1, "long", counts)
    n, sums = int(counted[-1]), counted[:-1]
    if not n:
        return Whitening(scale, 0, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    mean = sums / n

    def scatter(batch: pa.RecordBatch) -> np.ndarray:
        y = _rows(batch, d) - mean
        return (y.T @ y).ravel()

    v = _summed(fit_list, d * d, "double", scatter).reshape(d, d) / n
    v = (v + v.T) / 2
    turned = jacobi(pivoted_cholesky(v))
    values = (turned * turned).sum(0)
    kept = values > len(v) * np.finfo(np.float64).eps * values.max(initial=0.0)
    return Whitening(scale, n, sums, values[kept], turned[:, kept] / np.sqrt(values[kept]), float(np.trace(v)))


def identity_error(fit_list: DataFrame, w: Whitening, most: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    d, mean = len(w.sums), w.sums / max(w.n, 1)
    base = w.components[:, :most] / np.sqrt(w.values[:most])
    k = base.shape[1]
    if not k:
        return 0.0

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        z = (_rows(batch, d) - mean) @ base
        return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

    got = _summed(fit_list, k * k + k, "double", moments) / w.n
    middle = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(middle, middle) - np.eye(k)).max())


def transform(points: DataFrame, w: Whitening, most: int, *kept: str | Column) -> DataFrame:
    """Columns ``kept`` of points (with x), deviation (sum of (n * x - S) ** 2) and whitened, an array of ``most`` numbers at most."""
    d, mean = len(w.sums), w.sums / max(w.n, 1)
    base = w.components[:, :most] / np.sqrt(w.values[:most])
    rows = points.select(F.struct(*kept).alias("row"), "x")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, d)
            z = (x - mean) @ base
            apart = np.abs(x).max(1, initial=0).astype(np.float64) * w.n + np.abs(w.sums).max(initial=0)
            if (d * apart * apart < 2.0**62).all():
                away = w.n * x - w.sums
                deviation = pa.array((away * away).sum(1))
            else:  # integers of any size; what is no long raises
                deviation = pa.array([sum((w.n * int(c) - int(s)) ** 2 for c, s in zip(row, w.sums, strict=True)) for row in x], pa.int64())
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(1, z.shape[1]))[: len(x) + 1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), deviation, whitened], ["row", "deviation", "whitened"])

    made = small_batches(rows).mapInArrow(task, f"row {rows.schema['row'].dataType.simpleString()}, deviation long, whitened array<double>")
    return made.select("row.*", "deviation", "whitened")


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = 4, scale: int = 256) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    d = lengths(vectors, column)
    points = on_grid(vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("v")), "v", scale, d)
    fit_list = distinct_points(points)
    w = fit(fit_list, d, scale)
    k = min(most, len(w.values))
    if not k:
        kind = vectors.schema[id_column].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error, shares = identity_error(fit_list, w, k), F.array(*(F.lit(float(e)) for e in w.values[:k] / w.trace))
    out = transform(points, w, k, "id").select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
