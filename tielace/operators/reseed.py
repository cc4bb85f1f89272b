"""Re-seeding: lattice cells without a point get one from a search that the global transform directs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tielace.functions.expr import apply_homography

from . import structure

#: Passes at most, the first threshold of a peak and what each pass makes of it, candidates of a cell, pixels searched to each side.
PASSES, BASE, SCALE, CANDIDATES, WINDOW = 2, 0.4, 0.6, 6, 5


def cell_of(x: Column, y: Column, rows: Column, cols: Column, m: int, n: int) -> Column:
    """The cell of a place in an image parted into m x n cells, numbered by rows; places beyond the image count to its edge."""
    at = lambda v, size, k: F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor(v / size * k)))
    return (at(y, rows, m) * n + at(x, cols, n)).cast("int")


def bounds(cell: Column, rows: Column, cols: Column, m: int, n: int) -> dict[str, Column]:
    """r0, c0, r1, c1 of a cell: where it begins and where the next one does."""
    i, j = F.floor(cell / n), cell % n
    edge = lambda k, size, parts: k * size / parts
    return {"r0": edge(i, rows, m), "c0": edge(j, cols, n), "r1": edge(i + 1, rows, m), "c1": edge(j + 1, cols, n)}


def empty_cells(points: DataFrame, shapes: DataFrame, m: int, n: int, valid: DataFrame | None = None) -> DataFrame:
    """image, cell of the cells of the images (image, rows, cols), or of the valid ones (image, cell), in which no point (image, x, y) lies."""
    every = valid.select("image", "cell").distinct() if valid is not None else shapes.select("image", F.explode(F.sequence(F.lit(0), F.lit(m * n - 1))).alias("cell"))
    taken = points.join(shapes, "image").select("image", cell_of(F.col("x"), F.col("y"), F.col("rows"), F.col("cols"), m, n).alias("cell")).distinct()
    return every.join(taken, ["image", "cell"], "left_anti")


def reseed(
    points: DataFrame, candidates: DataFrame, transforms: DataFrame, source: DataFrame, reference: DataFrame, shapes: DataFrame, m: int = 8, n: int = 8,
    valid: DataFrame | None = None, passes: int = PASSES, patch: int = 32, window: int = WINDOW, most: int = CANDIDATES, tile: int = 256, spread: float = structure.SPREAD,
) -> DataFrame:
    """image, cell, key, xs, ys, x, y, conf, sharpness, pass: the points added to the empty cells of a lattice of m x n cells an image.

    The best candidates (image, key, x, y, strength) inside an empty cell, at most so many, are taken through the image's homography (image, h)
    and searched for within window pixels of where that leads, by template matching. A pass takes the best candidate of every cell that
    is still empty, if its peak is above BASE * SCALE^pass, so later passes ask for less; conf is the peak, 1 at most. Candidates and peaks of a cell are the same in
    every pass: one search serves them all, and a cell's pass is the first whose threshold its best peak is above. Cells without such a candidate
    stay empty; ties go to the smaller key.
    """
    empty = empty_cells(points, shapes, m, n, valid)
    placed = candidates.join(shapes.select("image", "rows", "cols"), "image").filter("x >= 0 AND y >= 0 AND x < cols AND y < rows")
    placed = placed.withColumn("cell", cell_of(F.col("x"), F.col("y"), F.col("rows"), F.col("cols"), m, n)).join(empty, ["image", "cell"])
    order = Window.partitionBy("image", "cell").orderBy(F.desc("strength"), "key")
    best = placed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    to = apply_homography([F.get("h", F.lit(k)) for k in range(9)], F.col("x"), F.col("y"))
    asked = best.join(transforms.select("image", "h"), "image").select("image", "cell", "key", F.col("x").alias("xs"), F.col("y").alias("ys"), to[0].alias("xr"), to[1].alias("yr"))
    found = structure.template_match(asked.drop("cell"), source, reference, patch, 2 * window, tile, spread)
    ranked = found.join(asked.select("image", "cell", "key", "xs", "ys"), ["image", "key"]).withColumn("place", F.row_number().over(Window.partitionBy("image", "cell").orderBy(F.desc(F.round("peak", 9)), "key"))).filter("place = 1")
    took = F.coalesce(*[F.when(F.col("peak") > BASE * SCALE**k, F.lit(k)) for k in range(1, passes + 1)])
    return ranked.select("image", "cell", "key", "xs", "ys", "x", "y", F.least(F.lit(1.0), F.col("peak")).alias("conf"), "sharpness", took.alias("pass")).filter("pass IS NOT NULL")


def report(points: DataFrame, added: DataFrame, shapes: DataFrame, m: int, n: int, passes: int = PASSES, valid: DataFrame | None = None) -> DataFrame:
    """image, passes, cells_targeted, cells_filled, coverage_before, coverage_after of each image.

    A cell is a target of each pass that finds it empty, and passes are those that found one.
    """
    empty = empty_cells(points, shapes, m, n, valid).groupBy("image").agg(F.count("*").alias("empty"))
    cells = valid.groupBy("image").agg(F.count_distinct("cell").alias("cells")) if valid is not None else shapes.select("image", F.lit(m * n).cast("long").alias("cells"))
    filled = added.groupBy("image").agg(F.count("*").alias("filled"), *[F.count_if(F.col("pass") <= k).alias(f"by{k}") for k in range(1, passes + 1)])
    row = cells.join(empty, "image", "left").join(filled, "image", "left").na.fill(0)
    before = [F.col("empty")] + [F.col("empty") - F.col(f"by{k}") for k in range(1, passes)]  # empty cells that a pass meets
    targets = sum((b for b in before[1:]), before[0])
    ran = sum((F.when(b > 0, 1).otherwise(0) for b in before[1:]), F.when(before[0] > 0, 1).otherwise(0))
    return row.select("image", ran.alias("passes"), targets.alias("cells_targeted"), F.col("filled").alias("cells_filled"), (1 - F.col("empty") / F.col("cells")).alias("coverage_before"), (1 - (F.col("empty") - F.col("filled")) / F.col("cells")).alias("coverage_after"))
