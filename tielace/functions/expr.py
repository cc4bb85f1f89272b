"""Row-wise expressions: photometry, geometry, confidences. All are columns; nothing leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import LIMB_CUBIC, MOON_RADIUS_M

TINY_DENOMINATOR = 1e-12


def number(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(number(low), F.least(number(high), x))


def angle_between(a: Column, b: Column) -> Column:
    """The difference of two directions in degrees, 0 to 180."""
    d = F.pmod(F.abs(a - b), number(360))
    return F.least(d, number(360) - d)


def apply_homography(h: Sequence[float | Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Mapped (x, y); a denominator within 1e-12 of 0 counts as 1e-12."""
    h = [v if isinstance(v, Column) else number(v) for v in h]
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) < TINY_DENOMINATOR, number(TINY_DENOMINATOR)).otherwise(w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def jacobian(h: Sequence[float], x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """dx'/dx, dx'/dy, dy'/dx, dy'/dy by unit forward differences."""
    x0, y0 = apply_homography(h, x, y)
    x1, y1 = apply_homography(h, x + 1, y)
    x2, y2 = apply_homography(h, x, y + 1)
    return x1 - x0, x2 - x0, y1 - y0, y2 - y0


def trace_sigma(sx: Column, sy: Column) -> Column:
    """Sum of variances; infinite where either is unknown."""
    return F.coalesce(sx * sx + sy * sy, number(math.inf))


def quality(conf: Column, trace: Column) -> Column:
    return conf / (1 + trace)


def normalised_azimuth(az: Column) -> Column:
    return F.pmod(az, number(360))


def incidence_of(incidence: Column, elevation: Column) -> Column:
    return F.coalesce(incidence, number(90) - elevation)


def coplanar_phase(phase: Column, incidence: Column, emission: Column, azimuth: Column) -> Column:
    """The given phase, else the angle between sun and view for this azimuth between them."""
    i, e, a = F.radians(incidence), F.radians(emission), F.radians(azimuth)
    cosine = F.cos(i) * F.cos(e) + F.sin(i) * F.sin(e) * F.cos(a)
    return F.coalesce(phase, F.degrees(F.acos(clip(cosine, -1, 1))))


def sun_vector(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """East, north, up."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return F.cos(e) * F.sin(a), F.cos(e) * F.cos(a), F.sin(e)


def limb_weight(phase: Column) -> Column:
    c0, c1, c2, c3 = LIMB_CUBIC
    return clip(number(c0) + number(c1) * phase + number(c2) * phase * phase + number(c3) * phase * phase * phase, 0, 1)


def lunar_lambert(mu0: Column, mu: Column, phase: Column, albedo: float = 0.12) -> Column:
    mu0, mu, weight = clip(mu0, 0, 1), clip(mu, 1e-6, 1), limb_weight(phase)
    return number(albedo) * (2 * weight * mu0 / (mu0 + mu) + (1 - weight) * mu0)


def lommel_seeliger(mu0: Column, mu: Column, albedo: float = 0.12) -> Column:
    mu0, mu = clip(mu0, 0, 1), clip(mu, 1e-6, 1)
    return number(albedo) * mu0 / (mu0 + mu)


def lambert(mu0: Column, albedo: float = 0.12) -> Column:
    return number(albedo) * clip(mu0, 0, 1)


def parallax(height: Column, emission: Column, azimuth: Column) -> tuple[Column, Column]:
    t = height * F.tan(F.radians(emission))
    return t * F.sin(F.radians(azimuth)), t * F.cos(F.radians(azimuth))


def metres_per_degree(latitude: Column) -> tuple[Column, Column]:
    """Along a parallel, along a meridian."""
    per = math.pi * MOON_RADIUS_M / 180
    return number(per) * F.cos(F.radians(latitude)), number(per)


def equirectangular(lon: Column, lat: Column, lon0: float, lat_ts: float) -> tuple[Column, Column]:
    east = F.pmod(lon - number(lon0) + 180, number(360)) - 180
    return number(MOON_RADIUS_M * math.cos(math.radians(lat_ts))) * F.radians(east), number(MOON_RADIUS_M) * F.radians(lat)


def polar_stereographic(lon: Column, lat: Column, north: bool = True) -> tuple[Column, Column]:
    """On the sphere, true at the pole."""
    sign = 1 if north else -1
    r = number(2 * MOON_RADIUS_M) * F.tan(F.radians((number(90) - sign * lat) / 2))
    return r * F.sin(F.radians(lon)), -sign * r * F.cos(F.radians(lon))


def from_equirectangular(x: Column, y: Column, lon0: float, lat_ts: float) -> tuple[Column, Column]:
    """Longitude and latitude of a map place."""
    return F.degrees(x / number(MOON_RADIUS_M * math.cos(math.radians(lat_ts)))) + number(lon0), F.degrees(y / number(MOON_RADIUS_M))


def from_polar_stereographic(x: Column, y: Column, north: bool = True) -> tuple[Column, Column]:
    sign = 1 if north else -1
    lat = number(90) - 2 * F.degrees(F.atan(F.sqrt(x * x + y * y) / number(2 * MOON_RADIUS_M)))
    return F.degrees(F.atan2(x, -sign * y)), sign * lat


def oblique_stereographic(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """On the sphere, true at its centre."""
    east, lat = F.radians(lon - number(lon0)), F.radians(lat)
    s0, c0 = number(math.sin(math.radians(lat0))), number(math.cos(math.radians(lat0)))
    k = number(2 * MOON_RADIUS_M) / (1 + s0 * F.sin(lat) + c0 * F.cos(lat) * F.cos(east))
    return k * F.cos(lat) * F.sin(east), k * (c0 * F.sin(lat) - s0 * F.cos(lat) * F.cos(east))


def unit_vector(azimuth: float, elevation: float) -> tuple[float, float, float]:
    """East, north, up of a direction."""
    a, e = math.radians(azimuth), math.radians(elevation)
    return math.cos(e) * math.sin(a), math.cos(e) * math.cos(a), math.sin(e)


def sigmas(xx: Column, yy: Column, xy: Column) -> tuple[Column, Column, Column]:
    """Standard deviations and covariance; unknown where a part isn't finite or a variance is negative."""
    ok = (xx >= 0) & (yy >= 0) & (F.abs(xx) + F.abs(yy) + F.abs(xy) < number(math.inf))
    return F.when(ok, F.sqrt(xx)), F.when(ok, F.sqrt(yy)), F.when(ok, xy)


def patch_inside(x: Column, y: Column, half: float, width: float, height: float) -> Column:
    return (x >= half) & (y >= half) & (x <= width - half) & (y <= height - half)


def is_maximum(hxx: Column, hyy: Column, hxy: Column) -> Column:
    """Whether both eigenvalues of a 2 x 2 Hessian are below zero."""
    return (hxx + hyy < 0) & (hxx * hyy - hxy * hxy > TINY_DENOMINATOR)


def wrapped_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, number(360)) - 180


def label_corners(corners: Sequence[Column]) -> list[Column]:
    """Latitude and longitude of four corners in turn, longitudes wrapped; unknown all together where one is."""
    known = corners[0].isNotNull()
    for c in corners[1:]:
        known &= c.isNotNull()
    return [F.when(known, wrapped_longitude(c) if k % 2 else c) for k, c in enumerate(corners)]


def projection_kind(lat: Column, extent_km: Column) -> Column:
    return F.when(F.abs(lat) > 60, "polar_stereographic").when(extent_km > 50, "oblique_stereographic").otherwise("equirectangular")


def model_kind(points: Column, emission_difference: Column) -> Column:
    return F.when(points < 30, "similarity").when(emission_difference > 10, "homography").otherwise("affine")


def ellipse(sx: Column, sy: Column, sxy: Column) -> tuple[Column, Column, Column]:
    """Semi-axes and direction (degrees) of a 2 x 2 covariance, from its eigenvalues in closed form."""
    a, b = sx * sx, sy * sy
    mid, half = (a + b) / 2, F.sqrt((a - b) * (a - b) / 4 + sxy * sxy)
    return F.sqrt(F.greatest(number(0), mid + half)), F.sqrt(F.greatest(number(0), mid - half)), F.degrees(F.atan2(2 * sxy, a - b)) / 2


def cell_index(v: Column, extent: float, cells: int) -> Column:
    """Row or column of a lattice cell, clipped to the lattice."""
    return F.least(F.greatest(F.floor(v * cells / number(extent)), F.lit(0)), F.lit(cells - 1)).cast("int")


def cell_id(x: Column, y: Column, width: float, height: float, rows: int, cols: int) -> Column:
    return cell_index(y, height, rows) * cols + cell_index(x, width, cols)


def agreed_confidence(wa: Column, wb: Column) -> Column:
    return clip(0.5 * (wa + wb) + 0.25, 0, 1)


def single_confidence(conf: Column, ratio: Column) -> Column:
    return clip(0.6 * conf + 0.2 * F.least(ratio / 3, number(1)), 0, 1)
