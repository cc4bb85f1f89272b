"""Cast shadows: the terrain towards the sun against the line of sight, by tiles along the ray."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles

#: Every step so far out, then so many in geometric progression, up to the longest shadow; the least elevation in degrees, and that above which nothing is shadowed.
NEAR, FAR, LONGEST, LEAST_ELEVATION, OVERHEAD = 24, 32, 4096, 0.5, 89.9

KEYS = ("image", "tile_row", "tile_col")


def reach(relief: Column, elevation: Column, gsd: float, side: Column) -> Column:
    """Pixels that the longest possible shadow takes: relief over the tangent of the sun's elevation, within the image."""
    slope = F.tan(F.radians(F.greatest(elevation, F.lit(LEAST_ELEVATION))))
    long = F.ceil(relief / F.greatest(slope, F.lit(1e-6)) / max(gsd, 1e-6))
    return F.least(F.greatest(F.least(long, F.lit(LONGEST)), F.lit(1)), side).cast("int")


def steps(far: int) -> np.ndarray:
    """Distances at which a ray is looked at: all near ones, fewer and fewer beyond, where the terrain's angle changes slowly."""
    near = np.arange(1, min(far, NEAR) + 1)
    if far <= NEAR:
        return near
    start = NEAR + 1
    beyond = np.unique(np.rint(start * (far / start) ** (np.arange(FAR) / (FAR - 1))).astype(int))
    return np.concatenate([near, beyond[beyond > NEAR]])


def offsets(far: int, azimuth: float) -> list[tuple[int, int, int]]:
    """(distance, rows, columns) of a ray towards the sun; rows grow southward."""
    east, south = np.sin(np.radians(azimuth)), -np.cos(np.radians(azimuth))
    return [(int(k), int(np.rint(south * k)), int(np.rint(east * k))) for k in steps(far)]


def cast_shadows(heights: DataFrame, suns: DataFrame, gsd: float = 1.0, tile: int = 256) -> DataFrame:
    """image, r, c, shadowed of every pixel that is there, for the sun (azimuth, elevation in degrees) of its image.

    A pixel is shadowed if at any step of the ray the terrain rises above the sun's elevation; steps reach as far as the image's relief can throw a
    shadow. A tile asks for the tiles along its ray, about 4 + 2 * reach / tile of them, each sent once; images without a sun have no rows.
    """
    extent = heights.groupBy("image").agg((F.max("v") - F.min("v")).alias("relief"), (F.greatest(F.max("r"), F.max("c")) + 1).alias("side"))
    ray = extent.join(suns.select("image", "azimuth", "elevation"), "image").select("image", "azimuth", "elevation", reach(F.col("relief"), F.col("elevation"), gsd, F.col("side")).alias("far"))
    tiled = tiles.cut(heights, tile)
    own = tiled.join(ray, "image")

    def along(row: dict) -> list:
        corners = {(row["tile_row"] + (r + a) // tile, row["tile_col"] + (c + b) // tile) for _, r, c in [(0, 0, 0), *offsets(row["far"], row["azimuth"])] for a in (0, tile - 1) for b in (0, tile - 1)}
        return [[{"s_row": a, "s_col": b} for a, b in sorted(corners) if a >= 0 and b >= 0]]

    asked = tiles.each(own.drop("v"), along, "asked array<struct<s_row:int,s_col:int>>", keep=list(KEYS)).select(*KEYS, F.explode("asked").alias("a")).select(*KEYS, F.col("a.s_row").alias("s_row"), F.col("a.s_col").alias("s_col"))
    parts = tiled.select("image", F.col("tile_row").alias("s_row"), F.col("tile_col").alias("s_col"), F.col("v").alias("part"))
    got = asked.join(parts, ["image", "s_row", "s_col"]).groupBy(*KEYS).agg(F.collect_list(F.struct("s_row", "s_col", "part")).alias("parts"))

    def shaded(row: dict) -> list:
        held = {(p["s_row"], p["s_col"]): p["part"].reshape(tile, tile) for p in row["parts"]}
        z = held[row["tile_row"], row["tile_col"]]
        dark = np.zeros((tile, tile), bool)
        rise = np.tan(np.radians(row["elevation"]))
        for k, r, c in offsets(row["far"], row["azimuth"]) if row["elevation"] < OVERHEAD else []:
            if r == 0 and c == 0:
                continue
            seen = np.full((tile, tile), np.nan)
            for i in (0, 1):  # up to four tiles under the moved one
                for j in (0, 1):
                    part = held.get((row["tile_row"] + r // tile + i, row["tile_col"] + c // tile + j))
                    if part is not None:
                        dr, dc = r % tile - i * tile, c % tile - j * tile  # the part's pixel (a + dr, b + dc) lies under (a, b)
                        to = slice(max(0, -dr), tile - max(0, dr)), slice(max(0, -dc), tile - max(0, dc))
                        seen[to] = part[max(0, dr) : tile + min(0, dr), max(0, dc) : tile + min(0, dc)]
            with np.errstate(invalid="ignore"):
                dark |= (seen - z) / (k * gsd) > rise
        return [dark.astype(float).ravel(), z.ravel()]

    found = tiles.each(got.join(ray, "image"), shaded, "dark array<double>, z array<double>", keep=list(KEYS))
    return tiles.pixels(found, tile, "dark", "z").filter(~F.isnan("z")).select("image", "r", "c", (F.col("dark") == 1).alias("shadowed"))
