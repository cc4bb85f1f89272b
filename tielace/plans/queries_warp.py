"""Queries that resample rasters: global and local warps, orthorectification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tielace.operators import raster as ops
from tielace.operators import resample
from tielace.operators.lineage import cut

from .queries_raster import _DENSE
from .registry import query
from .views import images, raster, raster_sql

#: The output of the warps, in pixels.
ROWS, COLS = 72, 80
_FILLED = f"""{_DENSE}, mid AS (SELECT image, median(v) AS m FROM d GROUP BY image), f AS (SELECT image, r, c, coalesce(v, m) AS v FROM d JOIN mid USING (image)), images AS (SELECT DISTINCT image FROM raster)"""


def filled(spark, sf):
    """The raster with its holes at the image's median, worked out once: operators by tile read it several times."""
    return cut(ops.filled(ops.dense(cut(raster(spark, sf)), 64, 64)))


def _taps(places: str, n: int, weight: str, border: str) -> str:
    """SQL: q (image, r, c, v, k taps found) of places (image, r, c, x, y) by n x n taps; weight is an expression over t, the distance."""
    low = n // 2 - 1
    return f"""k AS (SELECT unnest(range({-low}, {n - low})) AS k), w AS (SELECT *, x - floor(x) AS fx, y - floor(y) AS fy FROM {places}),
wx AS (SELECT image, r, c, CAST(floor(x) AS BIGINT) + k AS sc, {weight.replace("t", "abs(fx - k)")} AS wx FROM w, k), wy AS (SELECT image, r, c, CAST(floor(y) AS BIGINT) + k AS sr, {weight.replace("t", "abs(fy - k)")} AS wy FROM w, k),
q AS (SELECT wx.image, wx.r, wx.c, sum(wx * wy * coalesce(v, {border})) AS v, count(v) AS n FROM wx JOIN wy USING (image, r, c) LEFT JOIN f ON f.image = wx.image AND f.r = sr AND f.c = sc GROUP BY ALL)"""


_CUBIC = "CASE WHEN t <= 1 THEN (1.25 * t - 2.25) * t * t + 1 WHEN t < 2 THEN -0.75 * (((t - 5) * t + 8) * t - 4) ELSE 0 END"
_LINEAR = "1 - t"

_H = "SELECT image, 1 + 0.002 * (image % 7) AS a, -0.03 * (image % 3) AS b, 1.25 + image % 4 AS c0, 0.02 AS d, 0.98 AS e, -0.75 AS f0, 0.0001 AS g, 0.00005 AS h FROM images"
_INVERSE = """((e - f0 * h) * {x} + (c0 * h - b) * {y} + b * f0 - c0 * e) / ((d * h - e * g) * {x} + (b * g - a * h) * {y} + a * e - b * d) AS x,
  ((f0 * g - d) * {x} + (a - c0 * g) * {y} + c0 * d - a * f0) / ((d * h - e * g) * {x} + (b * g - a * h) * {y} + a * e - b * d) AS y"""


def transforms(spark, sf):
    """A homography from source to output for each image."""
    k = F.col("image")
    own = images(spark, sf)
    h = F.array(1 + 0.002 * (k % 7), -0.03 * (k % 3), 1.25 + k % 4, F.lit(0.02), F.lit(0.98), F.lit(-0.75), F.lit(0.0001), F.lit(0.00005), F.lit(1.0))
    return own.select("image", F.lit(ROWS).alias("rows"), F.lit(COLS).alias("cols"), h.alias("h"))


def shown(found):
    return found.select("image", "r", "c", (F.round("v", 5) + 0.0).alias("v"), "covered")


_COVERED = "x >= 0 AND y >= 0 AND x < 64 AND y < 64 AS covered"


@query(f"""WITH {_FILLED}, t AS ({_H}),
p AS (SELECT image, CAST(r.r AS INTEGER) AS r, CAST(c.c AS INTEGER) AS c, {_INVERSE.format(x="c.c", y="r.r")} FROM t, range({ROWS}) r(r), range({COLS}) c(c)), {_taps("p", 4, _CUBIC, "0")}
SELECT image, r, c, round(q.v, 5) + 0.0 AS v, {_COVERED} FROM q JOIN p USING (image, r, c)""")
def warp_cubic(spark, sf):
    """Each image by its own homography, with cubic weights; nothing lies beyond the source."""
    return shown(resample.warp(filled(spark, sf), transforms(spark, sf), "cubic", 0.0))


_STEP = 16


@query(f"""WITH {_FILLED}, t AS ({_H}), g AS (SELECT image, i.i, j.j, {_INVERSE.format(x=f"{_STEP} * j.j", y=f"{_STEP} * i.i")} FROM t, range(7) i(i), range(7) j(j)),
nodes AS (SELECT image, i, j, x - 0.4 - 0.0003 * ({_STEP} * j - 32) * ({_STEP} * j - 32) AS x, y - 0.3 * sin({_STEP} * i / 9.0::DOUBLE) AS y FROM g),
o AS (SELECT image, CAST(r.r AS INTEGER) AS r, CAST(c.c AS INTEGER) AS c, r.r // {_STEP} AS i, c.c // {_STEP} AS j, (r.r % {_STEP}) / {_STEP}.0::DOUBLE AS s, (c.c % {_STEP}) / {_STEP}.0::DOUBLE AS t FROM images, range({ROWS}) r(r), range({COLS}) c(c)),
p AS (SELECT o.image, o.r, o.c, sum(CASE WHEN n.i = o.i THEN 1 - s ELSE s END * CASE WHEN n.j = o.j THEN 1 - t ELSE t END * x) AS x, sum(CASE WHEN n.i = o.i THEN 1 - s ELSE s END * CASE WHEN n.j = o.j THEN 1 - t ELSE t END * y) AS y
  FROM o JOIN nodes n ON n.image = o.image AND n.i BETWEEN o.i AND o.i + 1 AND n.j BETWEEN o.j AND o.j + 1 GROUP BY ALL), {_taps("p", 2, _LINEAR, "0")}
SELECT image, r, c, round(q.v, 5) + 0.0 AS v, {_COVERED} FROM q JOIN p USING (image, r, c)""")
def warp_local(spark, sf):
    """The same with a quadratic correction along the rows and a jitter down the columns, worked out at every 16th pixel."""
    targets = transforms(spark, sf)
    a, b, c, d, e, f, g, h = (F.get("h", F.lit(i)) for i in range(8))
    x, y = F.col("gx"), F.col("gy")
    w = (d * h - e * g) * x + (b * g - a * h) * y + a * e - b * d
    sx = ((e - f * h) * x + (c * h - b) * y + b * f - c * e) / w
    sy = ((f * g - d) * x + (a - c * g) * y + c * d - a * f) / w
    nodes = resample.nodes_of(targets, _STEP, sx - 0.4 - 0.0003 * (x - 32) * (x - 32), sy - 0.3 * F.sin(y / 9))
    return shown(resample.warp_by_nodes(filled(spark, sf), targets.drop("h"), nodes, "linear", 0.0, step=_STEP))


_HEIGHTS = f"""{raster_sql("high", "l_extendedprice / 1024")}, hmid AS (SELECT image, median(v) AS m FROM high GROUP BY image),
heights AS (SELECT g.image, g.r // 2 AS r, g.c // 2 AS c, avg(coalesce(v, m)) AS v FROM grid g JOIN hmid USING (image) LEFT JOIN high USING (image, r, c) GROUP BY 1, 2, 3), hmean AS (SELECT image, avg(v) AS mean FROM heights GROUP BY image)"""
_OROWS, _OCOLS = 70, 60


@query(f"""WITH {_FILLED}, {_HEIGHTS},
o AS (SELECT image, CAST(r.r AS INTEGER) AS r, CAST(c.c AS INTEGER) AS c, greatest(0, least(31, (c.c + 0.5::DOUBLE) * 32 / {_OCOLS} - 0.5)) AS hx, greatest(0, least(31, (r.r + 0.5::DOUBLE) * 32 / {_OROWS} - 0.5)) AS hy FROM images, range({_OROWS}) r(r), range({_OCOLS}) c(c)),
z AS (SELECT o.image, o.r, o.c, sum((1 - abs(hx - h.c)) * (1 - abs(hy - h.r)) * v) - any_value(mean) AS z FROM o JOIN heights h ON h.image = o.image AND abs(hx - h.c) < 1 AND abs(hy - h.r) < 1 JOIN hmean m ON m.image = o.image GROUP BY ALL),
m AS (SELECT image, r, c, 100 + (c + 0.5) * 0.5 + z * tan(radians(10)) * sin(radians(30 * (image % 4))) AS mx, 200 - (r + 0.5) * 0.5 + z * tan(radians(10)) * cos(radians(30 * (image % 4))) AS my FROM z),
p AS (SELECT image, r, c, (2.1 * mx + 0.02 * my - 214 + 0.3 * (image % 3)) / (0.0002 * mx + 0.98) AS x, (-0.01 * mx - 1.9 * my + 381) / (0.0002 * mx + 0.98) AS y FROM m), {_taps("p", 4, _CUBIC, "0")}
SELECT image, r, c, CASE WHEN n = 16 THEN round(q.v, 4) + 0.0 END AS v, n = 16 AND x >= 0 AND y >= 0 AND x < 64 AND y < 64 AS covered FROM q JOIN p USING (image, r, c)""")
def orthorectified(spark, sf):
    """Each image on a north-up grid, with the parallax of heights seen ten degrees off the vertical."""
    k = F.col("image")
    high = ops.filled(ops.dense(cut(raster(spark, sf, F.col("l_extendedprice") / 1024)), 64, 64))
    h = F.array(F.lit(2.1), F.lit(0.02), -214 + 0.3 * (k % 3), F.lit(-0.01), F.lit(-1.9), F.lit(381.0), F.lit(0.0002), F.lit(0.0), F.lit(0.98))
    own = images(spark, sf)
    grids = own.select("image", F.lit(_OROWS).alias("rows"), F.lit(_OCOLS).alias("cols"), F.lit(100.0).alias("x0"), F.lit(200.0).alias("y1"), F.lit(0.5).alias("gsd"), h.alias("h"), F.lit(10.0).alias("emission"), (30.0 * (k % 4)).alias("azimuth"))
    found = resample.orthorectify(filled(spark, sf), grids, cut(ops.decimate(high, 2).select("image", "r", "c", "v")))
    return found.select("image", "r", "c", (F.round("v", 4) + 0.0).alias("v"), "covered")
