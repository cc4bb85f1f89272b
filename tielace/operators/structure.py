"""Structural matching by tiles: channel features of oriented gradients, template matching, descriptors of index maps.

Features are worked out by tile with a border as wide as the filters reach, so they are those of the whole image, mirrored at its
edges. Points go to the tile they lie in; a tile serves all its points at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles

#: Channels, and the spread of their smoothing in pixels.
CHANNELS, SPREAD = 8, 2.0
#: Keeps lengths of flat places from vanishing (a fixed value).
TINY = 1e-10
#: A window whose variance is below this share of its mean square is flat: what is left is rounding.
FLAT = 1e-12
#: Pixels beside a peak, along each axis, in which no second one counts.
APART = 3
#: Points that meet a tile in one row.
POINTS = 128

KEYS = ("image", "tile_row", "tile_col")


def radius(spread: float) -> int:
    """How far a Gaussian of that spread is carried: four spreads to each side, rounded."""
    return int(round(spread * 4))


def gaussian(spread: float) -> np.ndarray:
    k = np.arange(-radius(spread), radius(spread) + 1)
    w = np.exp(-(k * k) / (2 * spread * spread))
    return w / w.sum()


def along_axis(a: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums over neighbours along an axis, where all of them are there."""
    return np.lib.stride_tricks.sliding_window_view(a, len(w), axis) @ w


def reach(spread: float) -> int:
    """The border that channels need beside what they are wanted for."""
    return radius(spread) + 1


def bordered(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """Tiles with borders, and the rows and cols of their image."""
    return tiles.cut(pixels, tile, halo).join(tiles.sizes(pixels), "image")


def channels(block: np.ndarray, top: int, left: int, rows: int, cols: int, spread: float = SPREAD, n: int = CHANNELS) -> np.ndarray:
    """Channel features (rows, columns, n) of a block whose first pixel is (top, left) in an image of rows x cols pixels.

    Gradients (3 x 3, weighted 1 2 1 across) are laid on n directions without their sign, smoothed by a Gaussian, and over neighbouring directions by
    1 2 1 as directions wrap; each pixel's channels have length 1. The result is smaller than the block by reach(spread) on
    each side where the image goes on; beyond the image it is NaN.
    """
    high, wide = block.shape
    r0, r1, c0, c1 = max(0, -top), min(high, rows - top), max(0, -left), min(wide, cols - left)
    edge = [(top + r0 == 0, top + r1 == rows), (left + c0 == 0, left + c1 == cols)]
    own = np.pad(block[r0:r1, c0:c1], [tuple(map(int, e)) for e in edge], mode="reflect")
    across, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    gx, gy = along_axis(along_axis(own, slope, 1), across, 0), along_axis(along_axis(own, slope, 0), across, 1)
    wide_by, w = radius(spread), gaussian(spread)
    smooth = []
    for k in range(n):
        turn = np.pi * k / n
        laid = np.pad(np.abs(gx * np.cos(turn) + gy * np.sin(turn)), [(wide_by * a, wide_by * b) for a, b in edge], mode="reflect")
        smooth.append(along_axis(along_axis(laid, w, 0), w, 1))
    found = np.stack(smooth, axis=2)
    found = 0.25 * np.roll(found, 1, axis=2) + 0.5 * found + 0.25 * np.roll(found, -1, axis=2)
    found /= np.sqrt((found * found).sum(axis=2, keepdims=True)) + TINY
    lost = reach(spread)
    out = np.full((high - 2 * lost, wide - 2 * lost, n), np.nan)
    r, c = r0 if edge[0][0] else r0 + lost, c0 if edge[1][0] else c0 + lost
    r, c = r - lost, c - lost  # places in the result
    src_r, src_c = max(0, -r), max(0, -c)
    part = found[src_r : src_r + out.shape[0] - max(0, r), src_c : src_c + out.shape[1] - max(0, c)]
    out[max(0, r) : max(0, r) + part.shape[0], max(0, c) : max(0, c) + part.shape[1]] = part
    return out


def channel_tiles(pixels: DataFrame, tile: int = 256, spread: float = SPREAD, n: int = CHANNELS) -> DataFrame:
    """image, tile_row, tile_col, c0, c1, ...: one array of tile^2 values a channel, NaN beyond the image.

    Images have to be filled; a hole makes the channels around it NaN.
    """
    halo = reach(spread)

    def made(row: dict) -> list:
        block = row["v"].reshape(tile + 2 * halo, -1)
        found = channels(block, row["tile_row"] * tile - halo, row["tile_col"] * tile - halo, row["rows"], row["cols"], spread, n)
        return [found[:, :, k].ravel() for k in range(n)]

    return tiles.each(bordered(pixels, tile, halo), made, ", ".join(f"c{k} array<double>" for k in range(n)), keep=list(KEYS))


def local_normalise(pixels: DataFrame, window: int = 31, tile: int = 256) -> DataFrame:
    """image, r, c, z: each pixel of filled images less the mean of the window around it, over that window's standard deviation.

    Windows are mirrored at the image's edges, edge pixels included. A flat window gives 0.
    """
    half = window // 2
    w = np.full(window, 1 / window)

    def made(row: dict) -> list:
        side, top, left = tile + 2 * half, row["tile_row"] * tile - half, row["tile_col"] * tile - half
        r0, r1, c0, c1 = max(0, -top), min(side, row["rows"] - top), max(0, -left), min(side, row["cols"] - left)
        edge = [(top + r0 == 0, top + r1 == row["rows"]), (left + c0 == 0, left + c1 == row["cols"])]
        own = np.pad(row["v"].reshape(side, side)[r0:r1, c0:c1], [(half * a, half * b) for a, b in edge], mode="symmetric")
        mean, square = (along_axis(along_axis(x, w, 0), w, 1) for x in (own, own * own))
        inner = own[half : half + mean.shape[0], half : half + mean.shape[1]]
        spread = np.maximum(square - mean * mean, 0)
        z = np.where(spread > FLAT * square, (inner - mean) / (np.sqrt(spread) + TINY), 0.0)
        # Where the tile's own pixels lie in that.
        r, c = half - (r0 if edge[0][0] else r0 + half), half - (c0 if edge[1][0] else c0 + half)
        high, wide = min(tile, row["rows"] - top - half), min(tile, row["cols"] - left - half)
        out = np.full((tile, tile), np.nan)
        out[:high, :wide] = z[r : r + high, c : c + wide]
        return [out.ravel()]

    found = tiles.each(bordered(pixels, tile, half), made, "z array<double>", keep=list(KEYS))
    return tiles.pixels(found, tile, "z").filter(~F.isnan("z"))


def met(points: DataFrame, tiled: DataFrame, x: str, y: str, tile: int, key: str, counted: DataFrame | None = None) -> DataFrame:
    """The tile of each point with points (array of structs of all their columns), at most about POINTS to a row.

    Points of a tile are counted first and dealt by a hash of their key, so that a crowded tile becomes several rows. A point
    whose tile isn't there comes with v null. counted: the same points at the same places before what was made of them in Python, which would
    be made twice if it were counted.
    """
    at = lambda c: F.floor(F.rint(c) / tile).cast("int")
    placed = lambda p: p.withColumns({"tile_row": at(y), "tile_col": at(x)})
    many = placed(points if counted is None else counted).groupBy(*KEYS).agg(F.ceil(F.count("*") / POINTS).alias("chunks"))
    dealt = placed(points).join(many, list(KEYS)).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")))
    held = dealt.groupBy(*KEYS, "chunk").agg(F.collect_list(F.struct(*[c for c in points.columns if c != "image"])).alias("points"))
    return held.join(tiled, list(KEYS), "left")


def each_point(rows: DataFrame, f, added: str, key_type: str) -> DataFrame:
    """Rows image, the key and the added columns, of f (row -> list of lists of values, the key's first)."""
    names = [c.split()[0] for c in added.split(", ")]
    found = tiles.each(rows, f, f"found array<struct<key:{key_type}, {', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in added.split(', '))}>>", keep=["image"])
    one = found.select("image", F.explode("found").alias("p"))
    return one.select("image", *[F.col(f"p.{c}").alias(c) for c in ["key", *names]])


def correlation(search: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Mean over channels of the normalised correlation (Pearson) of a template with every place of a search area.

    A channel that is flat in the template or under it adds nothing.
    """
    p, q, n = template.shape
    h, w = search.shape[0] - p + 1, search.shape[1] - q + 1
    t = template - template.mean(axis=(0, 1))
    shape = (search.shape[0], search.shape[1])
    cross = np.fft.irfft2(np.fft.rfft2(search, shape, axes=(0, 1)) * np.conj(np.fft.rfft2(t, shape, axes=(0, 1))), shape, axes=(0, 1))[:h, :w]
    sums = []
    for power in (search, search * search):
        total = np.pad(power.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
        sums.append(total[p:, q:] - total[:-p, q:] - total[p:, :-q] + total[:-p, :-q])
    spread = np.sqrt(np.maximum(sums[1] - sums[0] ** 2 / (p * q), 0.0)) * np.sqrt((t * t).sum(axis=(0, 1)))
    good = (spread > 1e-9) & (np.sqrt((t * t).mean(axis=(0, 1))) >= 1e-8)
    return np.where(good, cross / np.where(good, spread, 1.0), 0.0).sum(axis=2) / n


def parabola(a: float, b: float, c: float) -> float:
    """The peak of a parabola through three neighbours, from the middle one, within a pixel."""
    bend = a - 2 * b + c
    return float(np.clip(0.5 * (a - c) / bend, -1.0, 1.0)) if abs(bend) > 1e-12 else 0.0


def peak_of(surface: np.ndarray, apart: int = APART) -> tuple[float, float, float, float | None]:
    """Row and column of the largest value to a part of a pixel, the value, and it over the largest one more than apart pixels away along an
    axis (None where there is none above 1e-6). Ties go to the first by rows."""
    r, c = np.unravel_index(int(np.argmax(surface)), surface.shape)
    top = float(surface[r, c])
    dr = parabola(*surface[r - 1 : r + 2, c]) if 0 < r < surface.shape[0] - 1 else 0.0
    dc = parabola(*surface[r, c - 1 : c + 2]) if 0 < c < surface.shape[1] - 1 else 0.0
    rest = surface.copy()
    rest[max(0, r - apart) : r + apart + 1, max(0, c - apart) : c + apart + 1] = -np.inf
    second = float(rest.max())
    return r + dr, c + dc, top, top / second if second > 1e-6 else None


def template_match(points: DataFrame, source: DataFrame, reference: DataFrame, patch: int = 32, window: int = 48, tile: int = 256, spread: float = SPREAD) -> DataFrame:
    """image, key, x, y, peak, sharpness: each point (image, key, xs, ys in the source, xr, yr expected in the reference) found in the reference.

    A patch of channel features around the point is correlated with every place of the window around the expected one, channel by channel; the largest mean
    has its sub-pixel place by parabolas. sharpness is the peak over the largest value outside 7 x 7 around it (null where there is none). A
    point whose patch or search area leaves its image keeps (xr, yr) with peak and sharpness 0.
    """
    half, far, lost = patch // 2, window // 2, reach(spread)
    key_type = points.schema["key"].dataType.simpleString()
    own = points.select("image", "key", *[F.col(c).cast("double").alias(c) for c in ("xs", "ys", "xr", "yr")])

    def around(row: dict, halo: int, before: int, size: int, x: float, y: float) -> np.ndarray | None:
        """The channels of a square that begins so far before a place; None where it leaves the image."""
        r, c = int(np.rint(y)) - before, int(np.rint(x)) - before
        if r < 0 or c < 0 or r + size > row["rows"] or c + size > row["cols"]:
            return None
        r, c = r - row["tile_row"] * tile + halo - lost, c - row["tile_col"] * tile + halo - lost
        return row["made"][r : r + size, c : c + size]

    def with_channels(row: dict, halo: int) -> dict:
        block = row["v"].reshape(tile + 2 * halo, -1)
        return row | {"made": channels(block, row["tile_row"] * tile - halo, row["tile_col"] * tile - halo, row["rows"], row["cols"], spread)}

    near = half + lost

    def templates(row: dict) -> list:
        row = with_channels(row, near) if row["v"] is not None else row
        cut = [around(row, near, half, patch, p["xs"], p["ys"]) if row["v"] is not None else None for p in row["points"]]
        return [[{"key": p["key"], "xr": p["xr"], "yr": p["yr"], "template": np.zeros(0) if t is None else t.ravel()} for p, t in zip(row["points"], cut, strict=True)]]

    cut = each_point(met(own, bordered(source, tile, near), "xs", "ys", tile, "key"), templates, "xr double, yr double, template array<double>", key_type)
    wide = half + far + lost

    def searched(row: dict) -> list:
        row = with_channels(row, wide) if row["v"] is not None else row
        out = []
        for p in row["points"]:
            area = around(row, wide, half + far, patch + window, p["xr"], p["yr"]) if row["v"] is not None and len(p["template"]) else None
            if area is None or not np.isfinite(area).all() or not np.isfinite(p["template"]).all():
                out.append({"key": p["key"], "x": p["xr"], "y": p["yr"], "peak": 0.0, "sharpness": 0.0})
                continue
            r, c, top, sharp = peak_of(correlation(area, p["template"].reshape(patch, patch, -1)))
            out.append({"key": p["key"], "x": np.rint(p["xr"]) - far + c, "y": np.rint(p["yr"]) - far + r, "peak": top, "sharpness": sharp})
        return [out]

    return each_point(met(cut, bordered(reference, tile, wide), "xr", "yr", tile, "key", own), searched, "x double, y double, peak double, sharpness double", key_type)


def index_descriptors(indices: DataFrame, keypoints: DataFrame, patch: int = 96, grid: int = 6, n: int = 6, tile: int = 256) -> DataFrame:
    """image, key, vector (array<double>, grid * grid * n values of length 1) of keypoints (image, key, x, y) on a map of indices (image, r, c, v: 0 to n - 1).

    The patch around a keypoint is parted into grid x grid cells, and each has a histogram of its indices. Keypoints whose patch leaves the
    image, or has a hole, get zeros.
    """
    half, sub = patch // 2, patch // grid
    key_type = keypoints.schema["key"].dataType.simpleString()
    own = keypoints.select("image", "key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    where = (np.arange(patch) // sub)[:, None] * grid + np.arange(patch) // sub

    def described(row: dict) -> list:
        out, side = [], tile + 2 * half
        block = row["v"].reshape(side, side) if row["v"] is not None else None
        for p in row["points"]:
            r, c = int(np.rint(p["y"])) - half, int(np.rint(p["x"])) - half
            vector = np.zeros(grid * grid * n)
            if block is not None and r >= 0 and c >= 0 and r + patch <= row["rows"] and c + patch <= row["cols"]:
                r, c = r - row["tile_row"] * tile + half, c - row["tile_col"] * tile + half
                own = block[r : r + patch, c : c + patch]
                if np.isfinite(own).all():
                    vector = np.bincount((where * n + own.astype(np.int64)).ravel(), minlength=len(vector)).astype(float)
                    vector /= np.linalg.norm(vector) + TINY
            out.append({"key": p["key"], "vector": vector})
        return [out]

    return each_point(met(own, bordered(indices, tile, half), "x", "y", tile, "key"), described, "vector array<double>", key_type)
