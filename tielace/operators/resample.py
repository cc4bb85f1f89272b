"""Resampling by output tiles: warps, orthorectification, anti-aliased reduction.

A map tile says for every pixel of an output tile where it lies in the source (xs, ys). It asks for the source tiles that
its pixels' neighbourhoods touch, by an equi-join on tile keys, and a task weighs what it got. Nothing needs a whole image; after reduction
an output tile touches a bounded number of source tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles

#: Pixels along each axis that a kernel weighs.
TAPS = {"nearest": 1, "linear": 2, "cubic": 4, "lanczos": 8}
#: The cubic kernel's parameter (a fixed value).
CUBIC = -0.75
#: A source is halved until an output step covers at most so many of its pixels.
MOST_STEP = 4.0

KEYS = ("image", "tile_row", "tile_col")


def weights(kernel: str, t: np.ndarray) -> np.ndarray:
    """Weights of the taps around fractions t in [0, 1): an array with one more axis; they add up to 1."""
    n = TAPS[kernel]
    if kernel == "nearest":
        return np.ones((*t.shape, 1))
    x = np.abs(t[..., None] - (np.arange(n) - (n // 2 - 1)))
    if kernel == "linear":
        return 1 - x
    if kernel == "cubic":
        near = ((CUBIC + 2) * x - (CUBIC + 3)) * x * x + 1
        far = CUBIC * (((x - 5) * x + 8) * x - 4)
        return np.where(x <= 1, near, np.where(x < 2, far, 0.0))
    w = np.sinc(x) * np.sinc(x / (n // 2))
    return w / w.sum(-1, keepdims=True)


def first_taps(kernel: str, x: np.ndarray) -> np.ndarray:
    """The first pixel that is weighed along an axis."""
    return np.floor(x + 0.5) if kernel == "nearest" else np.floor(x) - (TAPS[kernel] // 2 - 1)


def sampled(block: np.ndarray, xs: np.ndarray, ys: np.ndarray, kernel: str, border: float | None) -> np.ndarray:
    """Values of a block at places in it; NaN in the block, and what lies outside, counts as border or makes the result NaN."""
    n = TAPS[kernel]
    known = np.isfinite(xs) & np.isfinite(ys)
    x, y = np.where(known, xs, 0.0), np.where(known, ys, 0.0)
    x0, y0 = first_taps(kernel, x), first_taps(kernel, y)
    wx, wy = weights(kernel, x - np.floor(x)), weights(kernel, y - np.floor(y))
    steps = np.arange(n)
    cols, rows = x0[..., None] + steps, y0[..., None] + steps
    high, wide = block.shape
    inside = ((rows >= 0) & (rows < high))[..., :, None] & ((cols >= 0) & (cols < wide))[..., None, :]
    r, c = np.clip(rows, 0, high - 1).astype(np.int64), np.clip(cols, 0, wide - 1).astype(np.int64)
    taken = np.where(inside, block[r[..., :, None], c[..., None, :]], np.nan)
    if border is not None:
        taken = np.where(np.isnan(taken), border, taken)
    out = np.einsum("...i,...ij,...j->...", wy, taken, wx)
    return np.where(known, out, np.nan if border is None else border)


def remap(maps: DataFrame, source: DataFrame, tile: int, kernel: str = "cubic", border: float | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The maps' rows without xs and ys, with v (array<double>; NaN where a neighbourhood isn't whole and no border value is given).

    maps: the keys (image among them), xs and ys (array<double>), further columns that stay. source: tiles from tiles.cut without border.
    """
    n = TAPS[kernel]

    def touched(row: dict) -> list:
        x, y = row["xs"], row["ys"]
        known = np.isfinite(x) & np.isfinite(y)
        x0, y0 = first_taps(kernel, x[known]), first_taps(kernel, y[known])
        codes = []
        for a in (np.floor((y0 + d) / tile) for d in (0, n - 1)):
            for b in (np.floor((x0 + d) / tile) for d in (0, n - 1)):
                within = (a >= 0) & (b >= 0) & (a < 1 << 30) & (b < 1 << 30)
                codes.append((a[within].astype(np.int64) << 30) + b[within].astype(np.int64))
        return [[{"s_row": int(k) >> 30, "s_col": int(k) & (1 << 30) - 1} for k in np.unique(np.concatenate(codes))]]

    asked = tiles.each(maps.select(*keys, "xs", "ys"), touched, "asked array<struct<s_row:int,s_col:int>>", drop=["xs", "ys"])
    asked = asked.select(*keys, F.explode("asked").alias("a")).select(*keys, F.col("a.s_row").alias("s_row"), F.col("a.s_col").alias("s_col"))
    parts = source.select("image", F.col("tile_row").alias("s_row"), F.col("tile_col").alias("s_col"), F.col("v").alias("part"))
    got = asked.join(parts, ["image", "s_row", "s_col"]).groupBy(*keys).agg(F.collect_list(F.struct("s_row", "s_col", "part")).alias("parts"))

    def weighed(row: dict) -> list:
        if not row["parts"]:
            return [np.full(len(row["xs"]), np.nan if border is None else border)]
        top, left = min(p["s_row"] for p in row["parts"]), min(p["s_col"] for p in row["parts"])
        high, wide = (max(p[c] for p in row["parts"]) - first + 1 for c, first in (("s_row", top), ("s_col", left)))
        block = np.full((high * tile, wide * tile), np.nan)
        for p in row["parts"]:
            r, c = (p["s_row"] - top) * tile, (p["s_col"] - left) * tile
            block[r : r + tile, c : c + tile] = p["part"].reshape(tile, tile)
        return [sampled(block, row["xs"] - left * tile, row["ys"] - top * tile, kernel, border)]

    return tiles.each(maps.join(got, list(keys), "left"), weighed, "v array<double>", drop=["xs", "ys", "parts"])


def output_tiles(targets: DataFrame, tile: int) -> DataFrame:
    """A row for each tile of each target (image, rows, cols of the output, further columns), dealt out by tile.

    The number of parts is given, as adaptive execution would put such short rows together into one task, which then makes all maps.
    """
    across = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / tile).cast("int"))
    rows = targets.withColumn("tile_row", F.explode(across("rows"))).withColumn("tile_col", F.explode(across("cols")))
    return rows.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)


def grid_of(row: dict, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the pixels of an output tile."""
    ys, xs = np.mgrid[0:tile, 0:tile]
    return xs + row["tile_col"] * tile, ys + row["tile_row"] * tile


def applied(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A homography; where the third coordinate vanishes it counts as 1e-12."""
    h = np.asarray(h, float).reshape(3, 3)
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    w = np.where(np.abs(w) < 1e-12, 1e-12, w)
    return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w


def map_tiles(rows: DataFrame, place: Callable[[dict], tuple[np.ndarray, np.ndarray]], drop: list[str]) -> DataFrame:
    """Rows of output tiles with xs and ys of place; and where they have src_rows and src_cols, inside (array<double>: 1 where a place, to nine decimals,
    lies in a source of so many pixels, else 0) in place of those, made in the same step: each step has a Python worker of its own in every task."""
    known = "src_rows" in rows.columns

    def made(row: dict) -> list:
        x, y = (a.ravel() for a in place(row))
        if not known:
            return [x, y]
        # A place on the source's edge comes out a rounding error beside it: nine decimals put it back.
        px, py = np.round(x, 9), np.round(y, 9)
        with np.errstate(invalid="ignore"):
            return [x, y, ((px >= 0) & (py >= 0) & (px < row["src_cols"]) & (py < row["src_rows"])).astype(float)]

    return tiles.each(rows, made, "xs array<double>, ys array<double>" + ", inside array<double>" * known, drop=[*drop, "src_rows", "src_cols"])


def homography_maps(targets: DataFrame, tile: int) -> DataFrame:
    """Map tiles of targets (image, rows, cols, h: the homography from source to output, 9 numbers by rows; src_rows, src_cols: see map_tiles)."""

    def place(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return applied(np.linalg.inv(row["h"].reshape(3, 3)), *grid_of(row, tile))

    return map_tiles(output_tiles(targets, tile), place, ["h"])


def node_maps(targets: DataFrame, nodes: DataFrame, tile: int, step: int) -> DataFrame:
    """Map tiles of targets (image, rows, cols; src_rows, src_cols: see map_tiles) from places at every step-th output pixel, linear between them.

    nodes: image, i, j (the node at output row i * step, column j * step), x, y. They have to reach beyond the last row and column;
    a pixel without its four nodes has no place. A tile is a multiple of step, and a node goes to the up to four tiles it borders.
    """
    if tile % step:
        raise ValueError("a tile has to be a multiple of the step")
    per = tile // step
    around = lambda n: F.sequence(F.greatest(F.lit(0), (F.ceil(F.col(n) / per) - 1).cast("int")), F.floor(F.col(n) / per).cast("int"))
    dealt = nodes.withColumn("tile_row", F.explode(around("i"))).withColumn("tile_col", F.explode(around("j")))
    held = dealt.groupBy(*KEYS).agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in "ij"], *[F.col(c).cast("double").alias(c) for c in "xy"])).alias("nodes"))

    def place(row: dict) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((2, per + 1, per + 1), np.nan)
        for n in row["nodes"] or []:
            at[:, n["i"] - row["tile_row"] * per, n["j"] - row["tile_col"] * per] = n["x"], n["y"]
        k = np.arange(tile) / step
        low = np.floor(k).astype(int)
        t = k - low
        rows = at[:, low] * (1 - t)[:, None] + at[:, low + 1] * t[:, None]
        full = rows[:, :, low] * (1 - t) + rows[:, :, low + 1] * t
        return full[0], full[1]

    return map_tiles(output_tiles(targets, tile).join(held, list(KEYS), "left"), place, ["nodes"])


def to_pixels(tiled: DataFrame, tile: int, *columns: str) -> DataFrame:
    """Pixels of output tiles within rows and cols of their target."""
    return tiles.pixels(tiled, tile, *columns, keep=("rows", "cols")).filter("r < rows AND c < cols").drop("rows", "cols")


def sized(targets: DataFrame, pixels: DataFrame) -> DataFrame:
    """The targets whose image has pixels, with src_rows and src_cols: rows are joined that are still short."""
    return targets.join(tiles.sizes(pixels).select("image", F.col("rows").alias("src_rows"), F.col("cols").alias("src_cols")), "image")


def warp(pixels: DataFrame, targets: DataFrame, kernel: str = "lanczos", border: float | None = 0.0, tile: int = 64) -> DataFrame:
    """image, r, c, v, covered: every image of the targets (image, rows, cols, h) in its output grid, by the global homography.

    v takes border for pixels beyond the source (null without one); covered says whether the place itself is in the source. Images of
    the targets without pixels give no rows.
    """
    maps = homography_maps(sized(targets, pixels), tile)
    return _finished(remap(maps, tiles.cut(pixels, tile), tile, kernel, border), tile)


def warp_by_nodes(pixels: DataFrame, targets: DataFrame, nodes: DataFrame, kernel: str = "lanczos", border: float | None = 0.0, tile: int = 64, step: int = 16) -> DataFrame:
    """The same where the places come from nodes: a homography with local corrections and jitter, worked out every step pixels."""
    maps = node_maps(sized(targets, pixels), nodes, tile, step)
    return _finished(remap(maps, tiles.cut(pixels, tile), tile, kernel, border), tile)


def _finished(found: DataFrame, tile: int) -> DataFrame:
    flat = to_pixels(found, tile, "v", "inside")
    return flat.select("image", "r", "c", F.when(~F.isnan("v"), F.col("v")).alias("v"), (F.col("inside") == 1).alias("covered"))


def nodes_of(targets: DataFrame, step: int, x: Column, y: Column) -> DataFrame:
    """Nodes of targets (image, rows, cols, further columns): x and y are expressions over those and over gx, gy, the node's output place."""
    across = lambda n: F.sequence(F.lit(0), F.ceil((F.col(n) - 1) / step).cast("int") + 1)
    at = targets.withColumn("i", F.explode(across("rows"))).withColumn("j", F.explode(across("cols")))
    return at.withColumns({"gx": F.col("j") * F.lit(float(step)), "gy": F.col("i") * F.lit(float(step))}).select("image", "i", "j", x.alias("x"), y.alias("y"))


def halvings(step: Column) -> Column:
    """How often a source is halved before a step of so many of its pixels is at most MOST_STEP."""
    return F.when(step > MOST_STEP, F.ceil(F.log2(step / MOST_STEP))).otherwise(F.lit(0)).cast("int")


def halved(pixels: DataFrame, levels: DataFrame, most: int) -> DataFrame:
    """Each image reduced by means of 2 x 2 pixels as often as its level (image, level) says, at most most times."""
    own = pixels.join(levels, "image")
    for k in range(most):
        again = F.when(F.col("level") > k, 2).otherwise(1)
        place = [F.floor(F.col(x) / again).cast("int").alias(x) for x in ("r", "c")]
        own = own.groupBy("image", "level", *place).agg(F.avg("v").alias("v"))
    return own.select("image", "r", "c", "v")


def orthorectify(pixels: DataFrame, grids: DataFrame, heights: DataFrame | None = None, kernel: str = "cubic", tile: int = 64) -> DataFrame:
    """image, r, c, v, covered: each image on a north-up grid of map coordinates.

    grids: image, rows, cols, x0 and y1 (the map's west and north edge), gsd, h (homography from map to source pixels), emission and azimuth in
    degrees. heights: a raster (image, r, c, v) that spans the same ground as the grid, with its own number of pixels; its heights above their mean shift
    the map place by height * tan(emission) towards the azimuth, where the emission isn't 0. A source that has over four pixels to a step is halved first
    (see halved). v is null where the kernel's neighbourhood isn't whole; covered says where it is and the place lies in the source.
    """
    x = lambda c: F.col("x0") + (c + 0.5) * F.col("gsd")
    y = lambda r: F.col("y1") - (r + 0.5) * F.col("gsd")
    g = lambda k: F.get("h", F.lit(k))

    def place(mx: Column, my: Column) -> tuple[Column, Column]:
        w = g(6) * mx + g(7) * my + g(8)
        w = F.when(F.abs(w) < 1e-12, 1e-12).otherwise(w)
        return (g(0) * mx + g(1) * my + g(2)) / w, (g(3) * mx + g(4) * my + g(5)) / w

    mid = place(x(F.col("cols") / 2), y(F.col("rows") / 2))
    east, south = place(x(F.col("cols") / 2 + 1), y(F.col("rows") / 2)), place(x(F.col("cols") / 2), y(F.col("rows") / 2 + 1))
    step = F.greatest(F.hypot(east[0] - mid[0], east[1] - mid[1]), F.hypot(south[0] - mid[0], south[1] - mid[1]))
    grids = grids.withColumn("level", halvings(step))
    most = grids.agg(F.max("level")).first()[0] or 0
    source = halved(pixels, grids.select("image", "level"), most) if most else pixels
    shapes = tiles.sizes(pixels).select("image", F.col("rows").alias("src_rows"), F.col("cols").alias("src_cols"))
    own = output_tiles(grids.join(shapes, "image"), tile)
    if heights is not None:
        mean = heights.groupBy("image").agg(F.avg("v").alias("mean"))
        size = tiles.sizes(heights).select("image", F.col("rows").alias("h_rows"), F.col("cols").alias("h_cols"))

        def ground(row: dict) -> list:
            c, r = grid_of(row, tile)
            # The places of a raster over the same ground, held within its outermost pixel centres.
            xs = np.clip((c + 0.5) * row["h_cols"] / row["cols"] - 0.5, 0, row["h_cols"] - 1)
            ys = np.clip((r + 0.5) * row["h_rows"] / row["rows"] - 0.5, 0, row["h_rows"] - 1)
            return [xs.ravel(), ys.ravel()]

        asked = tiles.each(own.select(*KEYS, "rows", "cols").join(size, "image"), ground, "xs array<double>, ys array<double>", keep=list(KEYS))
        tiled = tiles.cut(heights, tile)
        found = remap(asked, tiled, tile, "linear", 0.0).withColumnRenamed("v", "height").join(mean, "image")
        own = own.join(found, list(KEYS), "left")

    def mapped(row: dict) -> list:
        c, r = grid_of(row, tile)
        mx, my = row["x0"] + (c + 0.5) * row["gsd"], row["y1"] - (r + 0.5) * row["gsd"]
        if row.get("height") is not None and abs(row["emission"]) > 1e-3:
            lean = (row["height"].reshape(tile, tile) - row["mean"]) * np.tan(np.radians(row["emission"]))
            mx, my = mx + lean * np.sin(np.radians(row["azimuth"])), my + lean * np.cos(np.radians(row["azimuth"]))
        xs, ys = applied(row["h"], mx, my)
        inside = (xs >= 0) & (ys >= 0) & (xs < row["src_cols"]) & (ys < row["src_rows"])
        by = 2.0 ** row["level"]
        return [((xs + 0.5) / by - 0.5).ravel(), ((ys + 0.5) / by - 0.5).ravel(), inside.astype(float).ravel()]

    maps = tiles.each(own, mapped, "xs array<double>, ys array<double>, inside array<double>", keep=[*KEYS, "rows", "cols"])
    flat = to_pixels(remap(maps, tiles.cut(source, tile), tile, kernel, None), tile, "v", "inside")
    known = ~F.isnan("v")
    return flat.select("image", "r", "c", F.when(known, F.col("v")).alias("v"), (known & (F.col("inside") == 1)).alias("covered"))
