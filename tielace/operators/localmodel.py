"""Residual models: ridge quadratic from moment sums, thin-plate spline with leave-one-out choice, jitter by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import nearest

TERMS = ("1", "u", "v", "u * u", "u * v", "v * v")


def normalised(points: DataFrame, width: float, height: float) -> DataFrame:
    """u, v in -1 to 1."""
    return points.withColumns({"u": 2 * F.col("x") / width - 1, "v": 2 * F.col("y") / height - 1})


def quadratic(points: DataFrame, key: str, ridge: float = 1e-3) -> DataFrame:
    """key, n, cx, cy: six coefficients each of the residual fields dx, dy; the constant isn't penalised.

    The normal equations are sums (21 + 12 of them a group, with map-side combining); a pandas function solves a
    6 x 6 system in each of their rows. Points need u, v, dx, dy.
    """
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = [F.sum(F.expr(f"({TERMS[i]}) * ({TERMS[j]})")).alias(f"a{i}{j}") for i, j in pairs]
    sums += [F.sum(F.expr(f"({t}) * {d}")).alias(f"{d}{i}") for d in ("dx", "dy") for i, t in enumerate(TERMS)]
    moments = points.groupBy(key).agg(F.count("*").alias("n"), *sums)

    def solve(frames):
        for f in frames:
            cx, cy = [], []
            for r in f.to_dict("records"):
                a = np.zeros((6, 6))
                for i, j in pairs:
                    a[i, j] = a[j, i] = r[f"a{i}{j}"]
                a += ridge * r["n"] * np.diag([0, 1, 1, 1, 1, 1])
                cx.append(np.linalg.lstsq(a, np.array([r[f"dx{i}"] for i in range(6)]), rcond=None)[0].tolist())
                cy.append(np.linalg.lstsq(a, np.array([r[f"dy{i}"] for i in range(6)]), rcond=None)[0].tolist())
            yield pd.DataFrame({key: f[key], "n": f["n"], "cx": cx, "cy": cy})

    return moments.mapInPandas(solve, f"{key} string, n long, cx array<double>, cy array<double>")


#: Splines that are solved together.
TOGETHER = 512


def splines(xy: np.ndarray, values: np.ndarray, at: np.ndarray, smoothings: tuple[float, ...]) -> np.ndarray:
    """[spline, smoothing, value]: m thin-plate splines through values (m, n, values) at xy (m, n, 2), smoothing on the diagonal, each at one place (m, 2).

    The kernel between weights that the plane can't express is parted into its eigenvectors once for all smoothings. What is
    singular (equal or collinear places) has the least-squares solution of least norm.
    """
    kernel = lambda d: (lambda r2: np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0))((d**2).sum(-1))
    m, n = xy.shape[:2]
    k, k_at = kernel(xy[:, :, None] - xy[:, None]), kernel(at[:, None] - xy)
    left, size, right = np.linalg.svd(np.concatenate([np.ones((m, n, 1)), xy], 2))
    least = np.finfo(float).eps * (n + 3) * size[:, :1]
    rank = (size > least).sum(axis=1)
    out = np.empty((m, len(smoothings), values.shape[2]))
    for r in np.unique(rank):
        own = rank == r
        plane, free, kern, v = left[own, :, :r], left[own, :, r:], k[own], values[own]
        bend, turn = np.linalg.eigh(free.transpose(0, 2, 1) @ kern @ free)
        free = free @ turn
        on_plane = (np.c_[np.ones(own.sum()), at[own]][:, None] @ right[own, :r].transpose(0, 2, 1)) / size[own, None, :r] @ plane.transpose(0, 2, 1)
        beside = (k_at[own, None] - on_plane @ kern) @ free
        shares = free.transpose(0, 2, 1) @ v
        for s, smoothing in enumerate(smoothings):
            stiff = bend + smoothing
            known = np.abs(stiff) > least[own]
            out[own, s] = ((on_plane @ v) + (beside * np.where(known, 1 / np.where(known, stiff, 1), 0.0)[:, None]) @ shares)[:, 0]
    return out


def spline_choice(points: DataFrame, key: str, smoothings: tuple[float, ...] = (0.0, 0.01, 0.1, 1.0, 10.0), around: int = 24) -> DataFrame:
    """key, smoothing, n, loocv: the smoothing with the least leave-one-out error of each group, the first of equal ones.

    Every point is predicted by splines through its nearest others, around of them, so all points take part, each with a
    small system of its own, and a group of any size is dealt to all tasks. A task solves the systems of the points whose neighbours it has
    found, many at once, and hands on their errors alone. Points need u, v, dx, dy, tid; groups of fewer
    than five points have no row.
    """
    place = points.select(key, "tid", F.col("u").alias("x"), F.col("v").alias("y"), "dx", "dy")

    def predict(own: pa.Table, near: pa.Table, counts: np.ndarray) -> pa.Array:
        columns = lambda t, *names: np.stack([t.column(c).to_numpy().astype(float) for c in names], 1)
        at, known, xy, d = columns(own, "x", "y"), columns(own, "dx", "dy"), columns(near, "x", "y"), columns(near, "dx", "dy")
        starts, errors = np.cumsum(counts) - counts, np.zeros((len(counts), len(smoothings)))
        for n in np.unique(counts[counts >= 4]):
            same = np.flatnonzero(counts == n)
            for rows in (same[k : k + TOGETHER] for k in range(0, len(same), TOGETHER)):
                of = starts[rows][:, None] + np.arange(n)
                errors[rows] = ((splines(xy[of], d[of], at[rows], smoothings) - known[rows, None]) ** 2).sum(2)
        ends = np.r_[0, np.cumsum((counts >= 4) * len(smoothings))]  # fewer neighbours: no errors
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(errors[counts >= 4].ravel()))

    found = nearest(place, place, around, keys=(key,), made=predict).filter(F.size("found") > 0)
    sums = found.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.sqrt(F.avg(F.get("found", F.lit(k)))) for k in range(len(smoothings))]).alias("e"))
    tried = sums.select(key, "n", F.posexplode("e").alias("at", "loocv"))
    values = F.array(*[F.lit(float(s)) for s in smoothings])
    best = tried.groupBy(key).agg(F.min_by(F.struct("at", "n", "loocv"), F.struct(F.round("loocv", 12), "at")).alias("b"))
    return best.select(key, F.get(values, F.col("b.at")).alias("smoothing"), "b.n", "b.loocv")


def row_jitter(points: DataFrame, step: float = 1.0) -> DataFrame:
    """row, n, dx, dy: mean residual by source row."""
    return points.groupBy(F.floor(F.col("y") / step).cast("long").alias("row")).agg(F.count("*").alias("n"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))


def jitter_at(rows: DataFrame, jitter: DataFrame, block: int = 1024) -> DataFrame:
    """rows (row) with the jitter of their row, or between the nearest known rows linearly, held beyond the ends.

    Rows are put in order in blocks; the last known row of the blocks before and the first of those after come from a
    table of one row a block.
    """
    known = jitter.select("row", F.struct("row", "dx", "dy").alias("k"), F.lit(False).alias("asked"))
    asked = rows.select("row", F.lit(None).cast(known.schema["k"].dataType).alias("k"), F.lit(True).alias("asked"))
    both = known.unionByName(asked).withColumn("block", F.floor(F.col("row") / block))
    ends = both.groupBy("block").agg(F.max_by("k", F.when(~F.col("asked"), F.col("row"))).alias("last"), F.min_by("k", F.when(~F.col("asked"), F.col("row"))).alias("first"))
    over = Window.orderBy("block")  # one row a block of source rows
    ends = ends.select("block", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("prior"), F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    order = Window.partitionBy("block").orderBy("row", "asked")
    both = both.join(ends, "block").withColumns({"b": F.coalesce(F.last("k", True).over(order), "prior"), "a": F.coalesce(F.first("k", True).over(order.rowsBetween(0, Window.unboundedFollowing)), "later")})
    both = both.filter("asked").withColumns({"b": F.coalesce("b", "a"), "a": F.coalesce("a", "b")})
    t = F.coalesce(F.try_divide(F.col("row") - F.col("b.row"), F.col("a.row") - F.col("b.row")), F.lit(0.0))
    return both.select("row", *[(F.col(f"b.{c}") + t * (F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in ("dx", "dy")])
