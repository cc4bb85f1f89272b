"""Raster operators on pixel tables (image, r, c, v): stencils, column statistics, shading, shadow, pyramids, structure.

Every operator works on all images of the table side by side; lines and statistics are those of one image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """All cells of every image; v is null where there was none."""
    line = pixels.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"))
    grid = line.select("image", "r", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    return grid.join(pixels, ["image", "r", "c"], "left")


def along(axis: str):
    """The window along rows or columns of an image."""
    return Window.partitionBy("image", "r" if axis == "c" else "c").orderBy(axis)


def neighbours(grid: DataFrame) -> DataFrame:
    """A dense raster with up, down, west and east values (null beyond the edge), by two windows, tall and wide."""
    wide = grid.withColumns({"west": F.lag("v").over(along("c")), "east": F.lead("v").over(along("c"))})
    return wide.withColumns({"up": F.lag("v").over(along("r")), "down": F.lead("v").over(along("r"))})


def slopes(at: DataFrame, spacing: float = 1.0) -> tuple[Column, Column]:
    """East and south slope from central differences, one-sided at the edges; rows grow southward."""

    def slope(before: str, after: str) -> Column:
        b, a, v = F.col(before), F.col(after), F.col("v")
        return F.when(b.isNull(), a - v).when(a.isNull(), v - b).otherwise((a - b) / 2) / spacing

    return slope("west", "east"), slope("up", "down")


def normals(grid: DataFrame, spacing: float = 1.0) -> DataFrame:
    """image, r, c, nx, ny, nz."""
    at = neighbours(grid)
    east, south = slopes(at, spacing)
    size = F.sqrt(east * east + south * south + 1)
    return at.select("image", "r", "c", (-east / size).alias("nx"), (south / size).alias("ny"), (1 / size).alias("nz"))


def slope_summary(grid: DataFrame, spacing: float = 1.0) -> DataFrame:
    """image, rms_deg, median_deg of the slope angle."""
    east, south = slopes(at := neighbours(grid), spacing)
    angle = at.select("image", F.degrees(F.atan(F.sqrt(east * east + south * south))).alias("a"))
    return angle.groupBy("image").agg(F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("rms_deg"), F.median("a").alias("median_deg"))


def noise_sigma(grid: DataFrame) -> DataFrame:
    """image, n, sigma: median absolute deviation of the inner 4-neighbour Laplacian, scaled to a normal sigma."""
    lap = neighbours(grid).select("image", (F.col("up") + F.col("down") + F.col("west") + F.col("east") - 4 * F.col("v")).alias("l")).filter("l IS NOT NULL")
    mid = lap.groupBy("image").agg(F.median("l").alias("m"))
    return lap.join(mid, "image").groupBy("image").agg(F.count("*").alias("n"), (F.median(F.abs(F.col("l") - F.col("m"))) / 0.6745 / (6**0.5)).alias("sigma"))


def effective_size(grid: DataFrame, least: float = 16.0) -> DataFrame:
    """image, n, n_eff: pixels divided by the loss from each axis' lag-1 autocorrelation (0 to 0.99), at least a floor."""
    mean = grid.groupBy("image").agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"), F.count("v").alias("n"))
    at = neighbours(grid).join(mean, "image")
    v = F.col("v") - F.col("m")
    lagged = at.groupBy("image").agg(F.first("n").alias("n"), F.first("var").alias("var"), F.avg(v * (F.col("east") - F.col("m"))).alias("cx"), F.avg(v * (F.col("down") - F.col("m"))).alias("cy"))
    rho = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.coalesce(F.try_divide(c, "var"), F.lit(0.0))))
    rx, ry = rho("cx"), rho("cy")
    return lagged.select("image", "n", F.greatest(F.lit(least), F.col("n") * (1 - rx) / (1 + rx) * (1 - ry) / (1 + ry)).alias("n_eff"))


def destripe(pixels: DataFrame) -> DataFrame:
    """image, r, c, v: each column's median moved to its image's."""
    columns, scene = pixels.groupBy("image", "c").agg(F.median("v").alias("m")), pixels.groupBy("image").agg(F.median("v").alias("s"))
    return pixels.join(columns, ["image", "c"]).join(scene, "image").select("image", "r", "c", (F.col("v") - F.col("m") + F.col("s")).alias("v"))


def bad_pixels(pixels: DataFrame, limit: float = 6.0) -> DataFrame:
    """The pixels with bad: further than limit robust sigmas from their image's median, or missing."""
    mid = pixels.groupBy("image").agg(F.median("v").alias("m"))
    mad = pixels.join(mid, "image").groupBy("image").agg(F.first("m").alias("m"), F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    far = F.abs(F.col("v") - F.col("m")) > limit * F.greatest(F.col("mad") / 0.6745, F.lit(1e-6))
    return pixels.join(mad, "image").select("image", "r", "c", "v", F.coalesce(far, F.lit(True)).alias("bad"))


def solar_bands(bands: DataFrame, low: float = 900.0, high: float = 1600.0) -> DataFrame:
    """image, band of the bands (image, band, nm) between low and high nanometres; the shortest quarter of an image's bands, at least one, where none is."""
    own = Window.partitionBy("image")
    solar = F.coalesce(F.col("nm").between(low, high), F.lit(False))
    judged = bands.select("image", "band", solar.alias("solar"), F.max(solar).over(own).alias("has"), F.row_number().over(own.orderBy("nm", "band")).alias("place"), F.count("*").over(own).alias("n"))
    return judged.filter(F.col("solar") | (~F.col("has") & (F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))))).select("image", "band")


def filled(grid: DataFrame) -> DataFrame:
    """A dense raster with its holes at the image's median."""
    mid = grid.groupBy("image").agg(F.median("v").alias("m"))
    return grid.join(mid, "image").select("image", "r", "c", F.coalesce("v", "m").alias("v"))


def decimate(pixels: DataFrame, factor: int) -> DataFrame:
    """Block means."""
    block = lambda v: F.floor(F.col(v) / factor).cast("int").alias(v)
    return pixels.groupBy("image", block("r"), block("c")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def local_maxima(grid: DataFrame, half: int, tile: int, most: int) -> DataFrame:
    """image, r, c, v, place: pixels that are the largest of the box around them, the best few of each tile (ties: r, c)."""
    tall = grid.withColumn("t", F.max("v").over(along("c").rowsBetween(-half, half)))
    top = tall.withColumn("t", F.max("t").over(along("r").rowsBetween(-half, half))).filter("v = t")
    cell = [F.floor(F.col(x) / tile) for x in ("r", "c")]
    order = Window.partitionBy("image", *cell).orderBy(F.desc("v"), "r", "c")
    return top.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("image", "r", "c", "v", "place")


def orientation_energy(grid: DataFrame, directions: int = 4, half: int = 1) -> DataFrame:
    """image, r, c, energy (array of unit length), strongest: how much the brightness changes along each direction nearby.

    The slopes' structure sums xx, xy, yy over a box say the mean squared slope along any direction:
    xx cos^2 + 2 xy cos sin + yy sin^2. Unlike brightness, the shares of the directions survive a change of light.
    """
    at = neighbours(grid)
    east, south = slopes(at)
    parts = at.select("image", "r", "c", (east * east).alias("xx"), (east * south).alias("xy"), (south * south).alias("yy"))
    for axis in ("c", "r"):
        box = along(axis).rowsBetween(-half, half)
        parts = parts.withColumns({p: F.sum(p).over(box) for p in ("xx", "xy", "yy")})
    turns = [(math.cos(math.pi * k / directions), math.sin(math.pi * k / directions)) for k in range(directions)]
    energy = F.array(*[F.greatest(F.lit(0.0), F.col("xx") * (x * x) + F.col("xy") * (2 * x * y) + F.col("yy") * (y * y)) for x, y in turns])
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    known = parts.withColumn("e", energy).filter("xx IS NOT NULL AND xy IS NOT NULL AND yy IS NOT NULL").withColumn("n", size)
    share = F.transform("e", lambda v: v / F.greatest(F.col("n"), F.lit(1e-9)))
    return known.select("image", "r", "c", share.alias("energy"), (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("strongest"))


def best_shift(source: DataFrame, reference: DataFrame, tile: int, reach: int, least: int = 16) -> DataFrame:
    """image, tile_row, tile_col, dr, dc, ncc, n, ratio: the shift of each source tile at which the reference correlates best.

    Each source pixel meets the reference at all shifts up to reach, by one equi-join on the shifted place, and five sums
    a tile and shift are all that is shuffled further. Shifts with fewer than least pixels don't count; ties go to the
    shorter shift, then by dr and dc. ratio is the best over the best more than one step away.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    moved = source.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    placed = moved.select("image", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "dr", "dc", F.floor(F.col("r") / tile).cast("int").alias("tile_row"), F.floor(F.col("c") / tile).cast("int").alias("tile_col"), F.col("v").alias("a"))
    met = placed.join(reference.withColumnRenamed("v", "b"), ["image", "r", "c"])
    surface = met.groupBy("image", "tile_row", "tile_col", "dr", "dc").agg(F.count("*").alias("n"), F.corr("a", "b").alias("ncc")).filter((F.col("n") >= least) & F.col("ncc").isNotNull() & ~F.isnan("ncc"))
    by = Window.partitionBy("image", "tile_row", "tile_col")
    best = F.row_number().over(by.orderBy(F.desc(F.round("ncc", 9)), F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"), "dr", "dc"))
    ranked = surface.withColumn("place", best).withColumns({"r0": F.max(F.when(F.col("place") == 1, F.col("dr"))).over(by), "c0": F.max(F.when(F.col("place") == 1, F.col("dc"))).over(by)})
    apart = (F.abs(F.col("dr") - F.col("r0")) > 1) | (F.abs(F.col("dc") - F.col("c0")) > 1)
    second = F.max(F.when(apart, F.col("ncc"))).over(by)
    found = ranked.withColumn("second", second).filter("place = 1")
    return found.select("image", "tile_row", "tile_col", "dr", "dc", "ncc", "n", F.try_divide("ncc", F.greatest("second", F.lit(1e-9))).alias("ratio"))
