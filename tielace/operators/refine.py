"""Refinement of matches to a part of a pixel, with covariances: phase shifts, least-squares matching, paraboloids.

A match's patch is cut from the source where its tile is, and travels to the tile of the reference where the match is expected; there all of
the refinement happens, for many matches of a tile at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import structure

#: The interpolation's parameter (Catmull-Rom: exact for parabolas).
CUBIC = -0.5
#: A source patch is at most so many times as large as it is sampled, so borders of tiles are bounded.
STRETCH = 2.0
PARAMETERS = 8
#: Matches that are solved together.
BATCH = 16

#: Least squares over 3 x 3 values (by rows) for 1, x, y, x^2/2, y^2/2, xy.
_Y, _X = (v.ravel().astype(float) for v in np.mgrid[-1:2, -1:2])
QUADRATIC = np.stack([np.ones(9), _X, _Y, _X * _X / 2, _Y * _Y / 2, _X * _Y], 1)
SOLVED = np.linalg.pinv(QUADRATIC)


def cubic_weights(t: np.ndarray) -> np.ndarray:
    x = np.abs(t[..., None] - np.arange(-1, 3))
    near, far = ((CUBIC + 2) * x - (CUBIC + 3)) * x * x + 1, CUBIC * (((x - 5) * x + 8) * x - 4)
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond an axis of n, mirrored at the middles of its ends."""
    i = np.abs(i) % (2 * n - 2) if n > 1 else np.zeros_like(i)
    return np.where(i < n, i, 2 * n - 2 - i)


def interpolated(blocks: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Values of each of n blocks at its own places (n, ...), mirrored beyond its edges."""
    n, high, wide = blocks.shape
    x0, y0 = np.floor(xs), np.floor(ys)
    wx, wy = cubic_weights(xs - x0), cubic_weights(ys - y0)
    cols, rows = mirrored(x0.astype(np.int64)[..., None] + np.arange(-1, 3), wide), mirrored(y0.astype(np.int64)[..., None] + np.arange(-1, 3), high)
    own = np.arange(n).reshape(n, *[1] * (xs.ndim - 1))
    out = np.zeros(xs.shape)
    for i in range(4):
        line = sum(wx[..., j] * blocks[own, rows[..., i], cols[..., j]] for j in range(4))
        out += wy[..., i] * line
    return out


def patch_at(row: dict, tile: int, halo: int, x: float, y: float, size: int, turn: np.ndarray | None = None) -> np.ndarray | None:
    """The patch of size^2 places around (x, y), as a 2 x 2 matrix lays them out; None where it comes within a pixel of the image's edge,
    leaves its tile's border or has a hole."""
    half = size / 2
    v, u = np.mgrid[0:size, 0:size] - half
    xs, ys = (x + u, y + v) if turn is None else (x + turn[0, 0] * u + turn[0, 1] * v, y + turn[1, 0] * u + turn[1, 1] * v)
    corners = np.array([xs[0, 0], xs[0, -1], xs[-1, 0], xs[-1, -1], ys[0, 0], ys[0, -1], ys[-1, 0], ys[-1, -1]])
    if not np.isfinite(corners).all():
        return None
    if corners[:4].min() < 1 or corners[4:].min() < 1 or corners[:4].max() + 1 >= row["cols"] - 1 or corners[4:].max() + 1 >= row["rows"] - 1:
        return None
    side = tile + 2 * halo
    xs, ys = xs - row["tile_col"] * tile + halo, ys - row["tile_row"] * tile + halo
    if min(xs.min(), ys.min()) < 1 or max(xs.max(), ys.max()) > side - 3:
        return None
    found = interpolated(row["v"].reshape(1, side, side), xs[None], ys[None])[0]
    return found if np.isfinite(found).all() else None


def phase_shift(a: np.ndarray, b: np.ndarray, parts: int = 50) -> tuple[float, float, float] | None:
    """(dx, dy, height): how far b's content lies from a's, to 1/parts of a pixel, by the peak of the normalised cross-power spectrum.

    Both patches are windowed; the whole-pixel peak is refined by a discrete Fourier transform of its neighbourhood alone, as two matrix products.
    None for patches without content.
    """
    n, m = a.shape
    window = np.outer(np.hanning(n), np.hanning(m))
    fa, fb = (np.fft.fft2((p - p.mean()) * window) for p in (a, b))
    cross = fb * np.conj(fa)
    size = np.abs(cross)
    if size.max() < 1e-12:
        return None
    cross = cross / np.maximum(size, 100 * np.finfo(float).eps * size.max())
    whole = np.fft.ifft2(cross).real
    r, c = np.unravel_index(int(np.argmax(whole)), whole.shape)
    start = np.array([r - n if r > n // 2 else r, c - m if c > m // 2 else c], float)
    steps = (np.arange(int(np.ceil(1.5 * parts))) - np.ceil(1.5 * parts) // 2) / parts
    fine = np.exp(2j * np.pi * np.outer(start[0] + steps, np.fft.fftfreq(n))) @ cross @ np.exp(2j * np.pi * np.outer(np.fft.fftfreq(m), start[1] + steps))
    i, j = np.unravel_index(int(np.argmax(fine.real)), fine.shape)
    return float(start[1] + steps[j]), float(start[0] + steps[i]), float(fine.real[i, j] / (n * m))


def effective_size(residual: np.ndarray, least: float = 16.0) -> np.ndarray:
    """Independent values among those of each residual image (n, rows, columns), from its neighbours' correlation along both axes."""
    r = residual - residual.mean(axis=(1, 2), keepdims=True)
    spread = (r * r).mean(axis=(1, 2))
    size = residual.shape[1] * residual.shape[2]
    safe = np.where(spread > 1e-20, spread, 1.0)
    down = np.clip((r[:, :-1] * r[:, 1:]).mean(axis=(1, 2)) / safe, 0, 0.99)
    across = np.clip((r[:, :, :-1] * r[:, :, 1:]).mean(axis=(1, 2)) / safe, 0, 0.99)
    found = np.maximum(size * (1 - down) / (1 + down) * (1 - across) / (1 + across), least)
    return np.where(spread > 1e-20, found, size)


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 12, enough: float = 1e-3, damping: float = 1e-6) -> dict[str, np.ndarray]:
    """Least-squares matching of n patches a with n patches b (n, rows, columns), all systems of a round at once.

    An affine map of the places and a gain and an offset of the brightness are adjusted by damped Gauss-Newton steps, with b's gradients, until both
    shifts move by less than enough. Gives dx, dy (where a's middle lies in b, from b's middle), converged, rms, rounds, and cov (n, 3: xx, yy, xy),
    the unit variance of the residuals (for as many as are independent) times the shifts' part of the inverse normal matrix. A system
    fails (converged false) where a patch is flat, the map leaves half to one and a half, or a shift a third of the patch.
    """
    n, h, w = b.shape
    v, u = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    xc, yc = u - cx, v - cy
    spread = [p.reshape(n, -1).std(axis=1) for p in (a, b)]
    mean = [p.reshape(n, -1).mean(axis=1) for p in (a, b)]
    gain = spread[1] / np.maximum(spread[0], 1e-8)
    p = np.zeros((n, PARAMETERS))
    p[:, 0] = p[:, 4] = 1
    p[:, 6], p[:, 7] = gain, mean[1] - gain * mean[0]
    gy, gx = np.gradient(b, axis=(1, 2))
    geometry = np.stack([gx * xc, gx * yc, gx, gy * xc, gy * yc, gy], -1).reshape(n, h * w, 6)
    left = (spread[0] >= 1e-8) & (spread[1] >= 1e-8) & (min(h, w) >= 9)
    out = {"converged": np.zeros(n, bool), "rounds": np.zeros(n, np.int64), "rms": np.full(n, np.nan)}
    normal, last = np.zeros((n, PARAMETERS, PARAMETERS)), np.zeros((n, h, w))
    for k in range(1, rounds + 1):
        at = np.flatnonzero(left)
        if not len(at):
            break
        q = p[at, :, None, None]
        sx, sy = q[:, 0] * xc + q[:, 1] * yc + q[:, 2] + cx, q[:, 3] * xc + q[:, 4] * yc + q[:, 5] + cy
        warped = interpolated(a[at], sx, sy)
        # Places beyond the source patch say less and less within a pixel, then nothing.
        seen = np.clip(np.minimum(np.minimum(sx + 1, w - sx), np.minimum(sy + 1, h - sy)), 0, 1)
        residual = seen * (b[at] - (q[:, 6] * warped + q[:, 7]))
        rows = np.concatenate([geometry[at], warped.reshape(len(at), -1, 1), np.ones((len(at), h * w, 1))], -1) * seen.reshape(len(at), -1, 1)
        own = np.einsum("nki,nkj->nij", rows, rows)
        held = own + damping * np.trace(own, axis1=1, axis2=2)[:, None, None] / PARAMETERS * np.eye(PARAMETERS)
        step = np.linalg.solve(held, np.einsum("nki,nk->ni", rows, residual.reshape(len(at), -1))[..., None])[..., 0]
        sound = np.isfinite(step).all(axis=1)
        p[at] += np.where(sound[:, None], step, 0)
        normal[at], last[at], out["rounds"][at], out["rms"][at] = own, residual, k, np.sqrt((residual**2).mean(axis=(1, 2)))
        still = np.maximum(np.abs(step[:, 2]), np.abs(step[:, 5])) < enough
        lost = (np.abs(p[at, 0] - 1) > 0.5) | (np.abs(p[at, 4] - 1) > 0.5) | (np.maximum(np.abs(p[at, 2]), np.abs(p[at, 5])) > w / 3)
        out["converged"][at] = still & sound
        left[at] = ~still & ~lost & sound
    turned = np.stack([p[:, [0, 1]], p[:, [3, 4]]], 1)
    back = -np.linalg.solve(np.where(out["converged"][:, None, None], turned, np.eye(2)), p[:, [2, 5], None])[..., 0]
    size = effective_size(last)
    unit = (last**2).mean(axis=(1, 2)) * size / np.maximum(size - PARAMETERS, 1)
    cov = np.full((n, 3), np.nan)
    for i in np.flatnonzero(out["converged"]):
        if np.linalg.matrix_rank(normal[i]) == PARAMETERS:
            full = unit[i] * np.linalg.inv(normal[i])
            cov[i] = full[2, 2], full[5, 5], full[2, 5]
    return out | {"dx": back[:, 0], "dy": back[:, 1], "cov": cov}


def paraboloid(values: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Offset (x, y, each within a pixel) of the peak of 3 x 3 values and its covariance (xx, yy, xy); NaN where they have no maximum."""
    fit = SOLVED @ values.ravel()
    bend = np.array([[fit[3], fit[5]], [fit[5], fit[4]]])
    if (np.linalg.eigvalsh(bend) >= -1e-12).any():
        return 0.0, 0.0, np.full(3, np.nan)
    inverse = np.linalg.inv(bend)
    x, y = np.clip(-inverse @ fit[1:3], -1, 1)
    noise = values.ravel() - QUADRATIC @ fit
    cov = -inverse * (noise @ noise) / (9 - 6)
    return float(x), float(y), np.array([cov[0, 0], cov[1, 1], cov[0, 1]])


def surface_covariance(a: np.ndarray, b: np.ndarray, around: int) -> np.ndarray:
    """Covariance of the peak of the correlation of a's inner part with b, up to around pixels away."""
    surface = structure.correlation(b[..., None], a[around:-around, around:-around, None])
    r, c = np.unravel_index(int(np.argmax(surface)), surface.shape)
    if not (0 < r < surface.shape[0] - 1 and 0 < c < surface.shape[1] - 1):
        return np.full(3, np.nan)
    return paraboloid(surface[r - 1 : r + 2, c - 1 : c + 2])[2]


def refine(matches: DataFrame, source: DataFrame, reference: DataFrame, patch: int = 64, most_shift: float = 4.0, parts: int = 50, tile: int = 256, squares: bool = True) -> DataFrame:
    """image, key, x, y, var_x, var_y, cov_xy, method, reason, shift: matches (image, key, xs, ys, xr, yr, and turn: 4 numbers) refined.

    The source's patch is laid out by turn (the inverse of the local map from source to reference, by rows; null: as it is), the reference's around (xr, yr). A
    phase shift moves the match; least-squares matching at the new place moves it further and gives its covariance (method lsm), or where that
    fails the curvature of the correlation's peak does (paraboloid), or nothing (none). reason says why a match is not refined:
    patch (one leaves its image, or has a hole), drift (no shift, or one above most_shift); its x and y stay those expected.
    """
    half = patch // 2 + 3
    key_type = matches.schema["key"].dataType.simpleString()
    own = matches.select("image", "key", *[F.col(c).cast("double").alias(c) for c in ("xs", "ys", "xr", "yr")], F.col("turn").cast("array<double>").alias("turn") if "turn" in matches.columns else F.lit(None).cast("array<double>").alias("turn"))
    wide = int(half * STRETCH)

    def taken(row: dict) -> list:
        out = []
        for p in row["points"]:
            turn = None if p["turn"] is None else p["turn"].reshape(2, 2)
            cut = patch_at(row, tile, wide, p["xs"], p["ys"], patch, turn) if row["v"] is not None else None
            out.append({"key": p["key"], "xr": p["xr"], "yr": p["yr"], "own": np.zeros(0) if cut is None else cut.ravel()})
        return [out]

    cut = structure.each_point(structure.met(own, structure.bordered(source, tile, wide), "xs", "ys", tile, "key"), taken, "xr double, yr double, own array<double>", key_type)
    far = half + 2 * int(np.ceil(most_shift)) + 1

    def refined(row: dict) -> list:
        out, ready = [], []
        for p in row["points"]:
            found = {"key": p["key"], "x": p["xr"], "y": p["yr"], "var_x": None, "var_y": None, "cov_xy": None, "method": "none", "reason": "patch", "shift": None}
            out.append(found)
            if row["v"] is None or not len(p["own"]):
                continue
            a, b = p["own"].reshape(patch, patch), patch_at(row, tile, far, p["xr"], p["yr"], patch)
            if b is None:
                continue
            moved = phase_shift(a, b, parts)
            if moved is None or np.hypot(moved[0], moved[1]) > most_shift:
                found["reason"] = "drift"
                continue
            found |= {"x": p["xr"] + moved[0], "y": p["yr"] + moved[1], "reason": None}
            again = patch_at(row, tile, far, found["x"], found["y"], patch)
            if again is not None:
                ready.append((found, a, again))
            out[-1] = found
        for k in range(0, len(ready), BATCH):
            part = ready[k : k + BATCH]
            solved = least_squares(np.stack([a for _, a, _ in part]), np.stack([b for _, _, b in part])) if squares else None
            for i, (found, a, b) in enumerate(part):
                cov = np.full(3, np.nan)
                if solved is not None and solved["converged"][i] and max(abs(solved["dx"][i]), abs(solved["dy"][i])) < most_shift:
                    found["x"], found["y"] = found["x"] + float(solved["dx"][i]), found["y"] + float(solved["dy"][i])
                    cov, found["method"] = solved["cov"][i], "lsm"
                if not np.isfinite(cov).all():
                    cov = surface_covariance(a, b, max(2, int(np.ceil(most_shift))))
                    found["method"] = "paraboloid" if np.isfinite(cov).all() else "none"
                if np.isfinite(cov).all():
                    found |= dict(zip(("var_x", "var_y", "cov_xy"), map(float, cov), strict=True))
        for found, p in zip(out, row["points"], strict=True):
            if found["reason"] is None:
                found["shift"] = float(np.hypot(found["x"] - p["xr"], found["y"] - p["yr"]))
        return [out]

    added = "x double, y double, var_x double, var_y double, cov_xy double, method string, reason string, shift double"
    return structure.each_point(structure.met(cut, structure.bordered(reference, tile, far), "xr", "yr", tile, "key", own), refined, added, key_type)


def paraboloids(pixels: DataFrame, peaks: DataFrame) -> DataFrame:
    """image, r, c, dx, dy, var_x, var_y, cov_xy of each peak (image, r, c) of a raster by the paraboloid through its 3 x 3 values.

    The six coefficients are sums over the neighbours, which meet their peaks by one equi-join. Peaks with a neighbour missing aren't given; where the
    paraboloid has no maximum the offsets are 0 and the covariance null.
    """
    near = peaks.select("image", "r", "c").withColumn("y", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("x", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    at = pixels.select("image", F.col("r").alias("nr"), F.col("c").alias("nc"), "v")
    near = near.withColumns({"nr": F.col("r") + F.col("y"), "nc": F.col("c") + F.col("x")}).join(at, ["image", "nr", "nc"]).filter("v IS NOT NULL")
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    s = near.groupBy("image", "r", "c").agg(
        F.count("*").alias("n"), (F.sum(x * v) / 6).alias("bx"), (F.sum(y * v) / 6).alias("by"), (F.sum((3 * x * x - 2) * v) / 3).alias("xx"), (F.sum((3 * y * y - 2) * v) / 3).alias("yy"),
        (F.sum(x * y * v) / 4).alias("xy"), (F.sum((5 - 3 * x * x - 3 * y * y) * v) / 9).alias("c0"), F.sum(v * v).alias("vv"), F.sum(v).alias("s0"), F.sum(x * x * v).alias("sx"), F.sum(y * y * v).alias("sy"),
    ).filter("n = 9")
    xx, yy, xy = F.col("xx"), F.col("yy"), F.col("xy")
    det = xx * yy - xy * xy
    top = (xx + yy) / 2 + F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) < -1e-12
    rest = F.col("vv") - F.col("c0") * F.col("s0") - 6 * F.col("bx") * F.col("bx") - 6 * F.col("by") * F.col("by") - xx * F.col("sx") / 2 - yy * F.col("sy") / 2 - 4 * xy * xy
    noise = F.greatest(rest, F.lit(0.0)) / 3
    within = lambda c: F.when(top, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))).otherwise(F.lit(0.0))
    return s.select(
        "image", "r", "c", within((xy * F.col("by") - yy * F.col("bx")) / det).alias("dx"), within((xy * F.col("bx") - xx * F.col("by")) / det).alias("dy"),
        F.when(top, -noise * yy / det).alias("var_x"), F.when(top, -noise * xx / det).alias("var_y"), F.when(top, noise * xy / det).alias("cov_xy"),
    )
