"""Jitter of line scanners: a least-squares spline through the residuals along the rows, its period, and its values at any row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import quantiles

#: Knots at most, and observed rows to a knot; rows that a spline needs; places at which it is written out.
KNOTS, ROWS_PER_KNOT, LEAST_ROWS, SAMPLES = 12, 8, 40, 200
DEGREE = 3


def basis(x: np.ndarray, interior: np.ndarray, low: float, high: float) -> np.ndarray:
    """Cubic B-splines at places from low to high, one column each: interior knots, and the ends four times."""
    t = np.concatenate([[low] * (DEGREE + 1), interior, [high] * (DEGREE + 1)])
    x = np.clip(x, low, high)[:, None]
    # At the last place the last span that isn't empty counts.
    span = np.minimum(np.searchsorted(t, x[:, 0], side="right") - 1, len(t) - DEGREE - 2)
    found = (np.arange(len(t) - 1) == span[:, None]).astype(float)
    for k in range(1, DEGREE + 1):
        wide, after = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        left = np.where(wide > 0, (x - t[: -k - 1]) / np.where(wide > 0, wide, 1), 0) * found[:, :-1]
        right = np.where(after > 0, (t[k + 1 :] - x) / np.where(after > 0, after, 1), 0) * found[:, 1:]
        found = left + right
    return found


def knots(rows: DataFrame, most: int = KNOTS, least: int = LEAST_ROWS) -> DataFrame:
    """group, n, low, high, knots (array<double>) of each group's distinct observed rows (group, row): their quantiles, evenly spaced in rank, as many as
    an eighth of the rows, 2 at least and most at most; those on the ends are left out. Groups with fewer rows than least, or no knot, have none.

    Each number of knots needs other quantiles, so all of them are taken at once, exactly, and a group picks its own.
    """
    shares = sorted({0.0, 1.0} | {j / (k + 1) for k in range(2, most + 1) for j in range(1, k + 1)})
    found = quantiles(rows, ["group"], "row", shares).filter(F.col("n") >= least)
    at = {s: i for i, s in enumerate(shares)}
    count = F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.col("n") / ROWS_PER_KNOT))).cast("int")
    chosen = F.array(*[F.array(*[F.get("q", F.lit(at[j / (k + 1)])) for j in range(1, k + 1)]) for k in range(2, most + 1)])
    ends = found.select("group", "n", F.get("q", F.lit(at[0.0])).alias("low"), F.get("q", F.lit(at[1.0])).alias("high"), F.array_distinct(F.get(chosen, count - 2)).alias("knots"))
    inside = F.filter("knots", lambda v: (v > F.col("low")) & (v < F.col("high")))
    return ends.withColumn("knots", inside).filter(F.size("knots") > 0)


def fit(residuals: DataFrame, most: int = KNOTS, samples: int = SAMPLES, least: int = LEAST_ROWS) -> DataFrame:
    """group, rows, dx, dy (arrays: the jitter at evenly spaced rows), amplitude, period, n_knots, n_rows, rms_before, rms_after.

    residuals: group (string), row, dx, dy. Residuals of one row are averaged, as they see one attitude; a cubic spline with knots at quantiles of the
    rows is fitted to the means by least squares. amplitude is half the length of the ranges of dx and dy; period that of the strongest frequency of the
    jitter's length, in rows (null where it doesn't vary). Normal equations are sums over rows, added up by Spark, so no group has to be in one task.
    Groups with fewer than least rows, or whose knots the rows don't fix, have no row; null residuals are left out.
    """
    known = residuals.filter("row IS NOT NULL AND dx IS NOT NULL AND dy IS NOT NULL").select("group", F.col("row").cast("double").alias("row"), "dx", "dy")
    means = known.groupBy("group", "row").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    placed = knots(means.select("group", "row"), most, least)
    met = means.join(placed, "group")

    def sums(batches):
        for batch in batches:
            f, out = batch.to_pandas(), []
            for group, own in f.groupby("group", dropna=False, sort=False):
                first = own.iloc[0]
                b = basis(own["row"].to_numpy(float), np.asarray(first["knots"], float), first["low"], first["high"])
                d = own[["dx", "dy"]].to_numpy(float)
                out.append((group, (b.T @ b).ravel(), (b.T @ d).ravel(), (d * d).sum()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array([list(v) for v in c], pa.list_(pa.float64())) for c in columns[1:3]], pa.array(columns[3], pa.float64())], names=["group", "left", "right", "square"])

    parts = met.mapInArrow(sums, "group string, left array<double>, right array<double>, square double")
    # Element by element: the arrays of a group are all as long as its knots say, at most 16 x 16.
    flat = parts.select("group", F.lit(0).alias("kind"), F.posexplode("left").alias("at", "v")).unionByName(parts.select("group", F.lit(1).alias("kind"), F.posexplode("right").alias("at", "v")))
    flat = flat.unionByName(parts.select("group", F.lit(2).alias("kind"), F.lit(0).alias("at"), F.col("square").alias("v")))
    added = flat.groupBy("group", "kind", "at").agg(F.sum("v").alias("v")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "v"))).alias("s"))

    def solved(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                m = len(r.knots) + DEGREE + 1
                v = np.array([x["v"] for x in r.s])
                left, right, square = v[: m * m].reshape(m, m), v[m * m : m * m + 2 * m].reshape(m, 2), v[-1]
                if np.linalg.matrix_rank(left, tol=1e-9 * np.trace(left)) < m:
                    continue
                c = np.linalg.solve(left, right)
                at = np.linspace(r.low, r.high, samples)
                jitter = basis(at, np.asarray(r.knots, float), r.low, r.high) @ c
                after = max(square - 2 * (c * right).sum() + (c * (left @ c)).sum(), 0.0)
                out.append((r.group, at.tolist(), *jitter.T.tolist(), float(np.hypot(*np.ptp(jitter, axis=0)) / 2), period(at, jitter), len(r.knots), int(r.n), float(np.sqrt(square / r.n)), float(np.sqrt(after / r.n))))
            yield pd.DataFrame(out, columns=["group", "rows", "dx", "dy", "amplitude", "period", "n_knots", "n_rows", "rms_before", "rms_after"])

    return added.join(placed, "group").mapInPandas(solved, "group string, rows array<double>, dx array<double>, dy array<double>, amplitude double, period double, n_knots int, n_rows long, rms_before double, rms_after double")


def period(rows: np.ndarray, jitter: np.ndarray) -> float | None:
    """The period, in rows, of the strongest frequency in the length of the jitter about its mean."""
    length = np.hypot(*(jitter - jitter.mean(axis=0)).T)
    if len(length) < 8 or length.std() < 1e-9:
        return None
    return float((rows[-1] - rows[0]) / (int(np.argmax(np.abs(np.fft.rfft(length - length.mean()))[1:])) + 1))


def at_rows(points: DataFrame, fitted: DataFrame) -> DataFrame:
    """The points (group, row, further columns) with jitter_x and jitter_y: linear between the fitted rows, held beyond the ends; null where a group has no fit.

    The fitted rows are evenly spaced, so a point's two neighbours are array elements, not a search.
    """
    own = fitted.select(F.col("group").alias("_g"), "rows", F.col("dx").alias("_x"), F.col("dy").alias("_y"))
    met = points.join(own, F.col("group") == F.col("_g"), "left")
    last = F.size("rows") - 1
    low, high = F.get("rows", F.lit(0)), F.element_at("rows", -1)
    place = F.greatest(F.lit(0.0), F.least(last.cast("double"), (F.col("row") - low) / F.nullif(high - low, F.lit(0.0)) * last))
    met = met.withColumn("_i", F.least(F.floor(place).cast("int"), last - 1)).withColumn("_t", place - F.col("_i"))
    value = lambda c: F.get(c, F.col("_i")) * (1 - F.col("_t")) + F.get(c, F.col("_i") + 1) * F.col("_t")
    return met.withColumns({"jitter_x": value("_x"), "jitter_y": value("_y")}).drop("_g", "rows", "_x", "_y", "_i", "_t")
