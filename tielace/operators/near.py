"""Distances to nearest points, and greedy thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .nearest import nearest


def nearest_distance(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The points with column nn, the distance to their nearest other point of the same keys (null: there is none).

    tid tells points apart.
    """
    place = points.select("tid", "x", "y", *keys)
    found = nearest(place, place, keys=keys)
    return points.join(found.select("tid", F.col("d").alias("nn")), "tid", "left")


def k_nearest(left: DataFrame, right: DataFrame, radius: float, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest right rows within the radius of each left row (ties: smaller n_tid), with their distance d and rank."""
    return nearest(left, right, k, radius, keys)


def greedy_thin(points: DataFrame, radius: float, priority: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points kept by greedy thinning: best priority first, a point stays if no kept one of the same keys is within the radius.

    Equal to the sequential rule, with ties to the smaller tid: a point that is better than all undecided ones within the
    radius is kept, those go, and so on until none is undecided. Points are dealt into cells whose diagonal is the
    radius, so only the best undecided point of a cell can be kept next, and every other point meets at most 24 of these:
    a round's work grows with the points, however dense they are. Rounds are tables in the checkpoint folder.
    """
    side = float(radius) / 2**0.5
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    names = [f"_k{n}" for n in range(len(keys))]
    left = points.select("tid", "x", "y", *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], priority.alias("_p"))
    left = cut(left.withColumns({"_bx": F.floor(F.col("x") / side), "_by": F.floor(F.col("y") / side)}))
    better = F.struct(F.col("_p"), -F.col("tid"))
    dx, dy = F.col("x") - F.col("b.x"), F.col("y") - F.col("b.y")
    within = dx * dx + dy * dy <= F.lit(float(radius) ** 2)
    kept = None
    while True:
        best = left.groupBy(*names, "_bx", "_by").agg(F.max_by(F.struct("tid", "x", "y", "_p"), better).alias("b"))
        sent = best.withColumn("_s", around).select(*names, (F.col("_bx") + F.col("_s.i")).alias("_bx"), (F.col("_by") + F.col("_s.j")).alias("_by"), "b")
        # Each undecided point with the bests of cells around it that are within the radius; which of them it blocks.
        met = left.join(sent, [*names, "_bx", "_by"]).filter(within)
        beats = F.struct(F.col("_p"), -F.col("tid")) > F.struct(F.col("b._p"), -F.col("b.tid"))
        met = cut(met.select("tid", F.col("b.tid").alias("best"), beats.alias("beats")))
        fresh = cut(met.groupBy("best").agg(F.max("beats").alias("blocked")).filter("NOT blocked").select("best"))
        gone = met.join(fresh, "best").select("tid").distinct()
        left = cut(left.join(gone, "tid", "left_anti"))
        kept = fresh if kept is None else kept.unionByName(fresh)
        if left.isEmpty():
            return points.join(kept.select(F.col("best").alias("tid")), "tid", "left_semi")
