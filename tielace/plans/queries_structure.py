"""Queries that match by structure: channel features, template matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tielace.operators import raster as ops
from tielace.operators import refine, reseed, structure
from tielace.operators.lineage import cut

from .queries_warp import _FILLED, filled
from .registry import query
from .views import images

_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 63 THEN 126 - ({0}) ELSE {0} END"


def channels_sql(source: str, name: str) -> str:
    """SQL: name (image, r, c, ch, v), the channel features of a raster of 64 x 64 pixels an image."""
    r, c = _MIRROR.format("o.r + dr"), _MIRROR.format("o.c + dc")
    return f"""{name}_g AS (SELECT o.image, o.r, o.c, sum(gx * s.v) AS gx, sum(gy * s.v) AS gy FROM {source} o, sobel JOIN {source} s ON s.image = o.image AND s.r = {r} AND s.c = {c} GROUP BY ALL),
{name}_p AS (SELECT image, r, c, ch, abs(gx * cos(pi() * ch / 8) + gy * sin(pi() * ch / 8)) AS v FROM {name}_g, range(8) h(ch)),
{name}_a AS (SELECT o.image, o.r, o.c, o.ch, sum(w * s.v) AS v FROM (SELECT image, r, c, ch FROM {name}_p) o, gauss JOIN {name}_p s ON s.image = o.image AND s.ch = o.ch AND s.r = o.r AND s.c = {_MIRROR.format("o.c + k")} GROUP BY ALL),
{name}_b AS (SELECT o.image, o.r, o.c, o.ch, sum(w * s.v) AS v FROM (SELECT image, r, c, ch FROM {name}_p) o, gauss JOIN {name}_a s ON s.image = o.image AND s.ch = o.ch AND s.c = o.c AND s.r = {_MIRROR.format("o.r + k")} GROUP BY ALL),
{name}_s AS (SELECT o.image, o.r, o.c, o.ch, sum(CASE WHEN t.k = 0 THEN 0.5 ELSE 0.25 END * s.v) AS v FROM {name}_b o, (SELECT unnest([-1, 0, 1]) AS k) t JOIN {name}_b s ON s.image = o.image AND s.r = o.r AND s.c = o.c AND s.ch = (o.ch + t.k + 8) % 8 GROUP BY ALL),
{name} AS (SELECT image, r, c, ch, v / (sqrt(sum(v * v) OVER (PARTITION BY image, r, c)) + 1e-10::DOUBLE) AS v FROM {name}_s)"""


_FILTERS = """sobel(dr, dc, gx, gy) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)),
gauss AS (SELECT k, exp(-k * k / 8.0::DOUBLE) / (SELECT sum(exp(-j * j / 8.0::DOUBLE)) FROM range(-8, 9) t(j)) AS w FROM range(-8, 9) t(k))"""


@query(f"""WITH {_FILLED}, {_FILTERS}, {channels_sql("f", "x")}
SELECT image, r, c, {", ".join(f"round(sum(CASE WHEN ch = {k} THEN v END), 5) AS c{k}" for k in range(8))} FROM x GROUP BY ALL""")
def oriented_channels(spark, sf):
    """Eight channel features of each pixel."""
    from tielace.operators import tiles

    names = [f"c{k}" for k in range(8)]
    found = tiles.pixels(structure.channel_tiles(filled(spark, sf), 32), 32, *names)
    return found.select("image", "r", "c", *[F.round(c, 5).alias(c) for c in names])


def moved(pixels):
    """A raster with its contrast reversed, a row down and two columns to the left, as its edges wrap."""
    return pixels.select("image", ((F.col("r") + 1) % 64).cast("int").alias("r"), ((F.col("c") + 62) % 64).cast("int").alias("c"), (100 - F.col("v")).alias("v"))


def lattice(spark, sf):
    """Nine points of each image, and the same place as where they are expected."""
    at = images(spark, sf)
    at = at.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    x, y = F.col("j") * 12 + 20.25, F.col("i") * 12 + 19.75
    return at.select("image", (F.col("i") * 3 + F.col("j")).alias("key"), x.alias("xs"), y.alias("ys"), x.alias("xr"), y.alias("yr"))


_PATCH, _WINDOW = 12, 8
_POINTS = "SELECT image, i * 3 + j AS key, j * 12 + 20 AS c0, i * 12 + 20 AS r0, j * 12 + 20 AS e0, i * 12 + 20 AS f0 FROM images, range(3) a(i), range(3) b(j)"


def matched_sql(points: str) -> str:
    """SQL: surface (image, key, sr, sc, v) and top, its largest value, of points: (c0, r0) in the source, (e0, f0) expected in the moved image."""
    half, far = _PATCH // 2, (_PATCH + _WINDOW) // 2
    return f"""e AS (SELECT image, CAST((r + 1) % 64 AS INTEGER) AS r, CAST((c + 62) % 64 AS INTEGER) AS c, 100 - v AS v FROM f), {channels_sql("f", "x")}, {channels_sql("e", "y")},
points AS ({points}),
t AS (SELECT p.image, key, ch, r - r0 + {half} AS dr, c - c0 + {half} AS dc, v FROM points p JOIN x ON x.image = p.image AND r BETWEEN r0 - {half} AND r0 + {half - 1} AND c BETWEEN c0 - {half} AND c0 + {half - 1}),
s AS (SELECT p.image, key, ch, r - f0 + {far} AS dr, c - e0 + {far} AS dc, v FROM points p JOIN y ON y.image = p.image AND r BETWEEN f0 - {far} AND f0 + {far - 1} AND c BETWEEN e0 - {far} AND e0 + {far - 1}),
k AS (SELECT t.image, t.key, t.ch, a.k AS sr, b.k AS sc, corr(t.v, s.v) AS ncc FROM t, range({_WINDOW + 1}) a(k), range({_WINDOW + 1}) b(k) JOIN s ON s.image = t.image AND s.key = t.key AND s.ch = t.ch AND s.dr = t.dr + a.k AND s.dc = t.dc + b.k GROUP BY ALL),
surface AS (SELECT image, key, sr, sc, sum(CASE WHEN isnan(ncc) OR ncc IS NULL THEN 0 ELSE ncc END) / 8 AS v FROM k GROUP BY ALL),
top AS (SELECT * FROM surface QUALIFY row_number() OVER (PARTITION BY image, key ORDER BY round(v, 9) DESC, sr, sc) = 1)"""


@query(f"""WITH {_FILLED}, {_FILTERS}, {matched_sql(_POINTS)},
beside AS (SELECT p.image, p.key, p.sr, p.sc, p.v, max(CASE WHEN s.sr = p.sr - 1 AND s.sc = p.sc THEN s.v END) AS up, max(CASE WHEN s.sr = p.sr + 1 AND s.sc = p.sc THEN s.v END) AS down,
  max(CASE WHEN s.sr = p.sr AND s.sc = p.sc - 1 THEN s.v END) AS west, max(CASE WHEN s.sr = p.sr AND s.sc = p.sc + 1 THEN s.v END) AS east, max(CASE WHEN abs(s.sr - p.sr) > 3 OR abs(s.sc - p.sc) > 3 THEN s.v END) AS second
  FROM top p JOIN surface s USING (image, key) GROUP BY ALL)
SELECT image, key, round(e0 - {_WINDOW // 2} + sc + coalesce(CASE WHEN abs(west - 2 * v + east) > 1e-12 THEN greatest(-1, least(1, 0.5 * (west - east) / (west - 2 * v + east))) END, 0), 4) AS x,
  round(f0 - {_WINDOW // 2} + sr + coalesce(CASE WHEN abs(up - 2 * v + down) > 1e-12 THEN greatest(-1, least(1, 0.5 * (up - down) / (up - 2 * v + down))) END, 0), 4) AS y,
  round(v, 5) AS peak, CASE WHEN second > 1e-6 THEN round(v / second, 4) END AS sharpness FROM beside JOIN points USING (image, key)""")
def structural_match(spark, sf):
    """Nine points of each image found again in the image moved by a row and two columns, with its contrast reversed."""
    source = filled(spark, sf)
    found = structure.template_match(lattice(spark, sf), source, moved(source), _PATCH, _WINDOW, tile=32)
    return found.select("image", "key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("peak", 5).alias("peak"), F.round("sharpness", 4).alias("sharpness"))


@query(f"""WITH {_FILLED}, a AS (SELECT *, max(v) OVER (PARTITION BY image, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM f),
b AS (SELECT *, max(t) OVER (PARTITION BY image, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS u FROM a),
p AS (SELECT image, r, c FROM b WHERE v = u QUALIFY row_number() OVER (PARTITION BY image, r // 16, c // 16 ORDER BY v DESC, r, c) <= 4),
m AS (SELECT p.image, p.r, p.c, sum((f.c - p.c) * v) / 6 AS kx, sum((f.r - p.r) * v) / 6 AS ky, sum((3 * (f.c - p.c) * (f.c - p.c) - 2) * v) / 3 AS xx, sum((3 * (f.r - p.r) * (f.r - p.r) - 2) * v) / 3 AS yy, sum((f.c - p.c) * (f.r - p.r) * v) / 4 AS xy,
  sum((5 - 3 * (f.c - p.c) * (f.c - p.c) - 3 * (f.r - p.r) * (f.r - p.r)) * v) / 9 AS c0 FROM p JOIN f ON f.image = p.image AND abs(f.r - p.r) <= 1 AND abs(f.c - p.c) <= 1 GROUP BY ALL HAVING count(*) = 9),
e AS (SELECT m.*, sum(pow(v - c0 - kx * (f.c - m.c) - ky * (f.r - m.r) - xx * (f.c - m.c) * (f.c - m.c) / 2 - yy * (f.r - m.r) * (f.r - m.r) / 2 - xy * (f.c - m.c) * (f.r - m.r), 2)) / 3 AS s
  FROM m JOIN f ON f.image = m.image AND abs(f.r - m.r) <= 1 AND abs(f.c - m.c) <= 1 GROUP BY ALL),
g AS (SELECT *, xx * yy - xy * xy AS det, (xx + yy) / 2 + sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) < -1e-12 AS top FROM e)
SELECT image, r, c, round(CASE WHEN top THEN greatest(-1, least(1, (xy * ky - yy * kx) / det)) ELSE 0 END, 5) + 0.0 AS dx, round(CASE WHEN top THEN greatest(-1, least(1, (xy * kx - xx * ky) / det)) ELSE 0 END, 5) + 0.0 AS dy,
  CASE WHEN top THEN round(-s * yy / det, 4) END AS var_x, CASE WHEN top THEN round(-s * xx / det, 4) END AS var_y, CASE WHEN top THEN round(s * xy / det, 4) + 0.0 END AS cov_xy FROM g""")
def peak_covariance(spark, sf):
    """Sub-pixel offsets and covariances of up to four local maxima of each 16 x 16 block."""
    source = filled(spark, sf)
    peaks = ops.local_maxima(source, 1, 16, 4)
    found = refine.paraboloids(source, peaks)
    return found.select("image", "r", "c", *[(F.round(c, 5) + 0.0).alias(c) for c in ("dx", "dy")], *[(F.round(c, 4) + 0.0).alias(c) for c in ("var_x", "var_y", "cov_xy")])


@query()
def refined_matches(spark, sf):
    """Nine points of each image refined in the image moved by a row and two columns, from places up to a pixel off."""
    source = filled(spark, sf)
    at = lattice(spark, sf).withColumns({"xr": F.col("xs") - 2 + F.col("key") % 3 - 1, "yr": F.col("ys") + 1})
    same = moved(source).select("image", "r", "c", (100 - F.col("v")).alias("v"))
    found = refine.refine(at, source, same, 24, 4.0, tile=32)
    return found.select("image", "key", *[F.round(c, 4).alias(c) for c in ("x", "y", "var_x", "var_y", "cov_xy", "shift")], "method", "reason")


_TURNS = ", ".join(f"greatest(0, xx * pow(cos(pi() * {k} / 6), 2) + xy * 2 * cos(pi() * {k} / 6) * sin(pi() * {k} / 6) + yy * pow(sin(pi() * {k} / 6), 2))" for k in range(6))
_INDEX = f"""{_FILLED}, ne AS (SELECT image, r, c, v, lag(v) OVER wide AS west, lead(v) OVER wide AS east, lag(v) OVER tall AS up, lead(v) OVER tall AS down FROM f WINDOW wide AS (PARTITION BY image, r ORDER BY c), tall AS (PARTITION BY image, c ORDER BY r)),
sl AS (SELECT image, r, c, CASE WHEN west IS NULL THEN east - v WHEN east IS NULL THEN v - west ELSE (east - west) / 2 END AS e, CASE WHEN up IS NULL THEN down - v WHEN down IS NULL THEN v - up ELSE (down - up) / 2 END AS s FROM ne),
sp AS (SELECT image, r, c, e * e AS xx, e * s AS xy, s * s AS yy FROM sl),
sa AS (SELECT image, r, c, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy, sum(yy) OVER w AS yy FROM sp WINDOW w AS (PARTITION BY image, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
sb AS (SELECT image, r, c, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy, sum(yy) OVER w AS yy FROM sa WINDOW w AS (PARTITION BY image, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
en AS (SELECT image, r, c, [{_TURNS}] AS e FROM sb), idx AS (SELECT image, r, c, list_position(e, list_max(e)) - 1 AS v FROM en),
points AS (SELECT image, i * 3 + j AS key, j * 12 + 20 AS c0, i * 12 + 20 AS r0 FROM images, range(3) a(i), range(3) b(j))"""


def _described(name: str, moved: int, turned: int) -> str:
    """SQL: name (pair, key, cell, idx, v), descriptors of the points moved by columns, on the map with its indices turned."""
    return f"""{name}_h AS (SELECT p.image AS pair, p.key, (i.r - r0 + 18) // 6 * 6 + (i.c - c0 - {moved} + 18) // 6 AS cell, (i.v + {turned}) % 6 AS idx, count(*) AS n FROM points p JOIN idx i ON i.image = p.image
  AND i.r BETWEEN r0 - 18 AND r0 + 17 AND i.c BETWEEN c0 + {moved} - 18 AND c0 + {moved} + 17 GROUP BY ALL), {name} AS (SELECT *, n / (sqrt(sum(n * n) OVER (PARTITION BY pair, key)) + 1e-10) AS v FROM {name}_h)"""


def index_map(spark, sf):
    """Which of six directions the brightness changes along most, by pixel."""
    return cut(ops.orientation_energy(filled(spark, sf), 6).select("image", "r", "c", F.col("strongest").alias("v")))


def keypoints(spark, sf, moved: int = 0):
    return lattice(spark, sf).select("image", "key", (F.col("xs") + moved).alias("x"), F.col("ys").alias("y"))


@query(f"WITH {_INDEX}, {_described('own', 0, 0)} SELECT pair AS image, key, CAST(cell * 6 + idx AS INTEGER) AS bin, round(v, 6) AS v FROM own")
def index_descriptors(spark, sf):
    """Histograms of directions around nine points of each image, bins that aren't empty."""
    d = structure.index_descriptors(index_map(spark, sf), keypoints(spark, sf), 36, tile=32)
    return d.select("image", "key", F.posexplode("vector").alias("bin", "v")).filter("v > 0").select("image", "key", "bin", F.round("v", 6).alias("v"))


@query(f"""WITH {_INDEX}, {_described('own', 0, 0)}, {_described('oth', 1, 2)},
s AS (SELECT own.pair, own.key AS src, oth.key AS ref, s.s, sum(own.v * oth.v) AS c FROM own, range(6) s(s) JOIN oth ON oth.pair = own.pair AND oth.cell = own.cell AND oth.idx = (own.idx + s.s) % 6 GROUP BY ALL),
b AS (SELECT pair, src, ref, max(c) AS c FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY pair, src ORDER BY round(c, 12) DESC, ref) AS place FROM b),
t AS (SELECT pair, src, max(CASE WHEN place = 1 THEN ref END) AS ref, max(CASE WHEN place = 1 THEN c END) AS c1, max(CASE WHEN place = 2 THEN c END) AS c2 FROM k WHERE place <= 2 GROUP BY ALL)
SELECT pair, src, ref, round(c1, 6) AS cosine FROM t WHERE c2 IS NULL OR 1 - c1 < 0.85 * greatest(1 - c2, 1e-10)""")
def turned_match(spark, sf):
    """The same points found among those a column further on a map whose directions are turned by two steps."""
    from tielace.operators.descriptors import pair_matches

    index = index_map(spark, sf)
    turned = index.select("image", "r", "c", ((F.col("v") + 2) % 6).alias("v"))
    # Both are counted and then joined.
    own = cut(structure.index_descriptors(index, keypoints(spark, sf), 36, tile=32).withColumnRenamed("image", "pair"))
    other = cut(structure.index_descriptors(turned, keypoints(spark, sf, 1), 36, tile=32).withColumnRenamed("image", "pair"))
    return pair_matches(own, other, 0.85, 6).select("pair", "src", "ref", F.round("cosine", 6).alias("cosine"))


#: The lattice of the re-seeding queries, and candidates a cell.
_CELLS, _MOST = 4, 2
_SEEDS = f"""SELECT image, key, c AS c0, r AS r0, c - 2 AS e0, r + 1 AS f0, cell FROM (
  SELECT *, row_number() OVER (PARTITION BY image, cell ORDER BY v DESC, key) AS nth FROM (SELECT image, r * 64 + c AS key, r, c, v, r // 16 * 4 + c // 16 AS cell FROM peaks) WHERE (image, cell) NOT IN (SELECT image, cell FROM have)) WHERE nth <= {_MOST}"""
_RESEEDED = f"""{_FILLED}, {_FILTERS}, pa AS (SELECT *, max(v) OVER (PARTITION BY image, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM f),
pb AS (SELECT *, max(t) OVER (PARTITION BY image, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS u FROM pa),
peaks AS (SELECT image, r, c, v FROM pb WHERE v = u QUALIFY row_number() OVER (PARTITION BY image, r // 16, c // 16 ORDER BY v DESC, r, c) <= 4),
have AS (SELECT DISTINCT image, CAST(r AS INTEGER) // 16 * 4 + CAST(c AS INTEGER) // 16 AS cell FROM peaks WHERE (r + c + image) % 3 = 0 AND c < 40), {matched_sql(_SEEDS)},
best AS (SELECT image, key, cell, c0, r0, e0 - {_WINDOW // 2} + sc AS x, f0 - {_WINDOW // 2} + sr AS y, v AS peak FROM top JOIN points USING (image, key)
  WHERE c0 >= {_PATCH // 2} AND r0 >= {_PATCH // 2} AND c0 + {_PATCH // 2} <= 64 AND r0 + {_PATCH // 2} <= 64 AND e0 >= {(_PATCH + _WINDOW) // 2} AND f0 >= {(_PATCH + _WINDOW) // 2} AND e0 + {(_PATCH + _WINDOW) // 2} <= 64 AND f0 + {(_PATCH + _WINDOW) // 2} <= 64
  QUALIFY row_number() OVER (PARTITION BY image, cell ORDER BY round(v, 9) DESC, key) = 1),
added AS (SELECT *, CASE WHEN peak > 0.4 * 0.6 THEN 1 WHEN peak > 0.4 * 0.36 THEN 2 END AS pass FROM best WHERE peak > 0.4 * 0.36)"""


def reseeded(spark, sf):
    """Points that some local maxima of each image are, and those added to the lattice's empty cells from the others."""
    source = filled(spark, sf)
    peaks = ops.local_maxima(source, 2, 16, 4).select("image", (F.col("r") * 64 + F.col("c")).alias("key"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), F.col("v").alias("strength"))
    own = peaks.filter(((F.col("x") + F.col("y") + F.col("image")) % 3 == 0) & (F.col("x") < 40))
    at = images(spark, sf)
    shapes = at.select("image", F.lit(64).alias("rows"), F.lit(64).alias("cols"))
    h = at.select("image", F.array(*[F.lit(float(v)) for v in (1, 0, -2, 0, 1, 1, 0, 0, 1)]).alias("h"))
    return own, reseed.reseed(own, peaks, h, source, moved(source), shapes, _CELLS, _CELLS, patch=_PATCH, window=_WINDOW // 2, most=_MOST, tile=32), shapes


@query(f"WITH {_RESEEDED} SELECT image, CAST(cell AS INTEGER) AS cell, key, round(peak, 5) AS conf, pass FROM added")
def reseeded_cells(spark, sf):
    """The point that each empty cell gets, with the pass that takes it."""
    return reseeded(spark, sf)[1].select("image", "cell", "key", F.round("conf", 5).alias("conf"), "pass")


@query(f"""WITH {_RESEEDED}, cells_n AS (SELECT images.image, 16 - (SELECT count(*) FROM have h WHERE h.image = images.image) AS empty, (SELECT count(*) FROM added a WHERE a.image = images.image) AS filled, (SELECT count(*) FROM added a WHERE a.image = images.image AND pass = 1) AS first FROM images)
SELECT image, CAST((empty > 0)::INTEGER + (empty - first > 0)::INTEGER AS INTEGER) AS passes, CAST(2 * empty - first AS BIGINT) AS cells_targeted, filled AS cells_filled, round(1 - empty / 16.0::DOUBLE, 6) AS coverage_before, round(1 - (empty - filled) / 16.0::DOUBLE, 6) AS coverage_after FROM cells_n""")
def reseed_report(spark, sf):
    """What re-seeding did to the coverage of each image."""
    own, added, shapes = reseeded(spark, sf)
    found = reseed.report(own, added, shapes, _CELLS, _CELLS)
    return found.select("image", "passes", "cells_targeted", "cells_filled", *[F.round(c, 6).alias(c) for c in ("coverage_before", "coverage_after")])
