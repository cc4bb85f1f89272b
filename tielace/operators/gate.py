"""The two-track agreement gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tielace.functions.expr import agreed_confidence, single_confidence

from .near import k_nearest


def agreement(track_a: DataFrame, track_b: DataFrame, radius: float, tau: float, keys: tuple[str, ...] = (), k: int = 4) -> DataFrame:
    """B points whose displacement the nearest A points confirm, with the merged reference position.

    Both tracks have tid, x, y (source), xr, yr (reference) and conf. The displacement of A at a B point is the mean
    over its k nearest A points within the radius by inverse distance (at least 1e-3); B is accepted if it
    predicts B's reference position to within tau. B drives the join, so no B point is claimed twice.
    """
    weight = 1 / F.greatest(F.col("d"), F.lit(1e-3))
    near = k_nearest(track_b, track_a, radius, k, keys).withColumn("_w", weight)
    mean = lambda c: F.sum(F.col("_w") * c) / F.sum("_w")
    same = [F.first(c).alias(c) for c in ("x", "y", "xr", "yr", "conf")]
    found = near.groupBy("tid", *keys).agg(*same, F.count("*").alias("n_near"), mean(F.col("n_xr") - F.col("n_x")).alias("_dx"), mean(F.col("n_yr") - F.col("n_y")).alias("_dy"), mean(F.col("n_conf")).alias("wa"))
    px, py = F.col("x") + F.col("_dx"), F.col("y") + F.col("_dy")
    gap = F.sqrt((px - F.col("xr")) * (px - F.col("xr")) + (py - F.col("yr")) * (py - F.col("yr")))
    total = F.greatest(F.col("wa") + F.col("conf"), F.lit(1e-9))
    merged = lambda p, r: (p * F.col("wa") + F.col(r) * F.col("conf")) / total
    kept = found.withColumn("gap", gap).filter(F.col("gap") <= tau)
    return kept.select("tid", *keys, "x", "y", merged(px, "xr").alias("xr"), merged(py, "yr").alias("yr"), "n_near", "gap", agreed_confidence(F.col("wa"), F.col("conf")).alias("confidence"))


def unused(track_a: DataFrame, track_b: DataFrame, accepted: DataFrame, radius: float, keys: tuple[str, ...] = (), k: int = 4) -> DataFrame:
    """A points that voted for no accepted B point."""
    votes = k_nearest(track_b, track_a, radius, k, keys).join(accepted.select("tid"), "tid", "left_semi").select(F.col("n_tid").alias("tid")).distinct()
    return track_a.join(votes, "tid", "left_anti")


def is_sharp(peak: Column, ratio: Column) -> Column:
    return (ratio > 1.5) & (peak > 0.4)


def spacing_radius(tolerance: float) -> tuple[Column, Column]:
    """Aggregates over nearest distances (nn) of track A: its median spacing, and the radius of the gate."""
    spacing = F.coalesce(F.median("nn"), F.lit(1.0))
    return spacing, F.greatest(F.lit(float(tolerance)), 2 * spacing)


def single_track(left: DataFrame, most: int) -> DataFrame:
    """tid, place, confidence of the sharp ones of points (tid, peak, ratio) without agreement, the highest peaks first."""
    sharp = left.filter(is_sharp(F.col("peak"), F.col("ratio"))).orderBy(F.desc("peak"), "tid").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("peak"), "tid"))  # most rows
    return sharp.select("tid", place.alias("place"), single_confidence(F.col("peak"), F.col("ratio")).alias("confidence"))
