"""Queries over geometry and scores: projections, transforms, filters by reason, truth scores, valid cells, footprints."""

from __future__ import annotations

from functools import reduce

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tielace.functions import expr
from tielace.functions.fixed import MOON_RADIUS_M
from tielace.operators import gate, near, stats, uniform
from tielace.operators import raster as ops

from .queries_points import _GATE, _RADIUS, _TAU, CELLS, H, tracks
from .queries_raster import _SLOPES, grid, raster_sql
from .registry import query
from .views import PAIRS, POINTS, RASTER, SIDE, pair_results, points, raster, table


def r6(c):
    return F.round(c, 6)


_SUN, _VIEW = expr.unit_vector(135.0, 30.0), expr.unit_vector(200.0, 78.0)
_DOT = "round(greatest({floor}, (-e * {0!r} + s * {1!r} + {2!r}) / sqrt(e * e + s * s + 1)), 6)"


@query(f"""WITH {_SLOPES} SELECT image, r, c, {_DOT.format(*_SUN, floor=0)} AS mu0, {_DOT.format(*_VIEW, floor=1e-6)} AS mu FROM s WHERE e IS NOT NULL AND s IS NOT NULL""")
def view_cosines(spark, sf):
    """Cosines of incidence and emission on the surface's normals."""
    n = ops.normals(grid(spark, sf)).filter("nx IS NOT NULL AND ny IS NOT NULL")
    dot = lambda v: F.col("nx") * v[0] + F.col("ny") * v[1] + F.col("nz") * v[2]
    return n.select("image", "r", "c", r6(F.greatest(F.lit(0.0), dot(_SUN))).alias("mu0"), r6(F.greatest(F.lit(1e-6), dot(_VIEW))).alias("mu"))


_R = repr(MOON_RADIUS_M)
_LL = "l AS (SELECT tid, x / 512 * 300 - 150 AS lon, y / 512 * 170 - 85 AS lat FROM points)"


def lonlat(spark, sf):
    return points(spark, sf).select("tid", (F.col("x") / 512 * 300 - 150).alias("lon"), (F.col("y") / 512 * 170 - 85).alias("lat"))


@query(f"""WITH {POINTS}, {_LL}, m AS (SELECT tid, lon, lat, {_R} * cos(radians(10)) * radians(lon - 20) AS x, {_R} * radians(lat) AS y FROM l)
SELECT tid, round(degrees(x / ({_R} * cos(radians(10)))) + 20, 6) AS lon, round(degrees(y / {_R}), 6) AS lat, round(lat, 6) AS polar_lat FROM m""")
def inverse_projection(spark, sf):
    """Map places back to longitude and latitude: equirectangular, and the polar latitude from its own map."""
    p = lonlat(spark, sf)
    lon, lat = F.col("lon"), F.col("lat")
    x, y = F.lit(MOON_RADIUS_M * math.cos(math.radians(10))) * F.radians(lon - 20), F.lit(MOON_RADIUS_M) * F.radians(lat)
    back_lon, back_lat = expr.from_equirectangular(x, y, 20.0, 10.0)
    _, polar = expr.from_polar_stereographic(*expr.polar_stereographic(lon, lat))
    return p.select("tid", r6(back_lon).alias("lon"), r6(back_lat).alias("lat"), r6(polar).alias("polar_lat"))


@query(f"""WITH {POINTS}, {_LL}, k AS (SELECT *, 2 * {_R} / (1 + sin(radians(-10)) * sin(radians(lat)) + cos(radians(-10)) * cos(radians(lat)) * cos(radians(lon - 20))) AS k FROM l)
SELECT tid, round(k * cos(radians(lat)) * sin(radians(lon - 20)), 3) AS x, round(k * (cos(radians(-10)) * sin(radians(lat)) - sin(radians(-10)) * cos(radians(lat)) * cos(radians(lon - 20))), 3) AS y FROM k""")
def oblique_stereographic(spark, sf):
    x, y = expr.oblique_stereographic(F.col("lon"), F.col("lat"), 20.0, -10.0)
    return lonlat(spark, sf).select("tid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH {RASTER} SELECT image, r, c, round(degrees((image * 5000.0 + (c + 0.5) * 60) / ({_R} * cos(radians(5)))) + 10, 6) AS lon, round(degrees((20000 - (r + 0.5) * 60) / {_R}), 6) AS lat FROM raster""")
def grid_lonlat(spark, sf):
    """Pixel centres of each image's map grid as longitude and latitude."""
    x, y = F.col("image") * 5000.0 + (F.col("c") + 0.5) * 60, 20000 - (F.col("r") + 0.5) * 60
    lon, lat = expr.from_equirectangular(x, y, 10.0, 5.0)
    return raster(spark, sf).select("image", "r", "c", r6(lon).alias("lon"), r6(lat).alias("lat"))


_INVERSE = tuple(float(v) for v in np.linalg.inv(np.array(H).reshape(3, 3)).ravel())


def _applied(h, x, y) -> tuple[str, str]:
    w = f"({h[6]!r} * {x} + {h[7]!r} * {y} + {h[8]!r})"
    return f"(({h[0]!r} * {x} + {h[1]!r} * {y} + {h[2]!r}) / {w})", f"(({h[3]!r} * {x} + {h[4]!r} * {y} + {h[5]!r}) / {w})"


_HX, _HY = _applied(H, "x", "y")
_IX, _IY = _applied(_INVERSE, "mx", "my")


@query(f"""WITH {POINTS}, m AS (SELECT tid, {_HX} AS mx, {_HY} AS my FROM points) SELECT tid, round({_IX}, 5) AS x, round({_IY}, 5) AS y FROM m""")
def inverse_homography(spark, sf):
    """Points through a transform and back through its inverse."""
    x, y = expr.apply_homography(_INVERSE, *expr.apply_homography(H, F.col("x"), F.col("y")))
    return points(spark, sf).select("tid", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query(f"""WITH {POINTS}, v AS (SELECT tid, sigma * sigma - 0.04 AS xx, conf * conf AS yy, sigma * conf * 0.3 AS xy FROM points), g AS (SELECT *, xx >= 0 AND yy >= 0 AS ok FROM v)
SELECT tid, round(CASE WHEN ok THEN sqrt(xx) END * 4, 6) AS sx, round(CASE WHEN ok THEN sqrt(yy) END * 4, 6) AS sy, round(CASE WHEN ok THEN xy END * 16, 6) AS sxy FROM g""")
def lifted_covariance(spark, sf):
    """Sigmas from a covariance (unknown where a variance is negative), lifted to a grid four times finer."""
    s = F.col("sigma")
    sx, sy, sxy = expr.sigmas(s * s - 0.04, F.col("conf") * F.col("conf"), s * F.col("conf") * 0.3)
    return points(spark, sf).select("tid", r6(sx * 4).alias("sx"), r6(sy * 4).alias("sy"), r6(sxy * 16).alias("sxy"))


@query(f"""WITH {POINTS} SELECT track, count(*) AS n, greatest(4, least(16, CAST(round_even(sqrt(count(*) / 4), 0) AS INTEGER))) AS side FROM points GROUP BY track""")
def auto_lattice(spark, sf):
    return points(spark, sf).groupBy("track").agg(F.count("*").alias("n")).select("track", "n", uniform.auto_side(F.col("n")).alias("side"))


@query(f"""WITH {PAIRS} SELECT method, sweep, round(count(*) FILTER (ok) / count(*), 6) AS inlier_ratio, round(count(*) / (count(DISTINCT pair_id % 97) * 1.5), 6) AS density_km2, round(sum(rmse) / (count(*) * 0.262144), 4) AS seconds_per_mp FROM pairs GROUP BY ALL""")
def run_rates(spark, sf):
    """Rates of each method and sweep: share of good pairs, density over an area, seconds a megapixel."""
    n = F.count("*")
    area = F.count_distinct(F.col("pair_id") % 97) * 1.5
    return pair_results(spark, sf).groupBy("method", "sweep").agg(r6(F.count_if("ok") / n).alias("inlier_ratio"), r6(F.try_divide(n, area)).alias("density_km2"), F.round(F.try_divide(F.sum("rmse"), n * 0.262144), 4).alias("seconds_per_mp"))


_REASON = """CASE WHEN x < 16 OR y < 16 OR x > 496 OR y > 496 THEN 'outside' WHEN conf <= 0.3 THEN 'weak' WHEN sqrt(dx * dx + dy * dy) > 0.9 THEN 'drift'
  WHEN hxx + hyy >= 0 OR hxx * hyy - hxy * hxy <= 1e-12 THEN 'no peak' WHEN sigma > 0.8 THEN 'uncertain' ELSE 'kept' END"""


@query(f"""WITH {POINTS}, d AS (SELECT *, conf - 0.5 AS dx, sigma - 0.5 AS dy, -1 - conf AS hxx, 0.4 - sigma * 2 AS hyy, conf * sigma AS hxy FROM points), k AS (SELECT track, {_REASON} AS reason, sqrt(dx * dx + dy * dy) AS shift FROM d)
SELECT track, reason, count(*) AS n, round(median(shift), 6) AS median_shift FROM k GROUP BY ALL""")
def refinement_reasons(spark, sf):
    """Why refined points go: patch not inside, weak peak, drift, no maximum, uncertain (an unknown sigma passes)."""
    d = points(spark, sf).withColumns({"dx": F.col("conf") - 0.5, "dy": F.col("sigma") - 0.5, "hxx": -1 - F.col("conf"), "hyy": 0.4 - F.col("sigma") * 2, "hxy": F.col("conf") * F.col("sigma")})
    shift = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    inside = expr.patch_inside(F.col("x"), F.col("y"), 16.0, SIDE, SIDE)
    peak = expr.is_maximum(F.col("hxx"), F.col("hyy"), F.col("hxy"))
    reason = F.when(~inside, "outside").when(F.col("conf") <= 0.3, "weak").when(shift > 0.9, "drift").when(~peak, "no peak").when(F.col("sigma") > 0.8, "uncertain").otherwise("kept")
    return d.select("track", reason.alias("reason"), shift.alias("shift")).groupBy("track", "reason").agg(F.count("*").alias("n"), r6(F.median("shift")).alias("median_shift"))


_GRID = "g AS (SELECT (0.05 + 0.9 * i / 23) * 512 AS x, (0.05 + 0.9 * j / 23) * 512 AS y FROM range(24) a(i) CROSS JOIN range(24) b(j))"
_EX, _EY = _applied(H, "x", "y")


@query(f"""WITH {POINTS}, t AS (SELECT track, avg(conf) AS off, avg(sigma) AS skew FROM points GROUP BY track), {_GRID}, e AS (SELECT track, {_EX} AS tx, {_EY} AS ty,
  ((1.02 * x + 0.03 * y - 5.0 + off) / (1e-5 * x + -2e-5 * y + 1.0)) AS ex, ((-0.02 * x + (0.98 + skew / 1000) * y + 7.5) / (1e-5 * x + -2e-5 * y + 1.0)) AS ey FROM t CROSS JOIN g)
SELECT track, round(sqrt(avg((ex - tx) * (ex - tx) + (ey - ty) * (ey - ty))), 6) AS rmse FROM e GROUP BY track""")
def truth_rmse(spark, sf):
    """Each track's transform against the true one over a grid of the image, whatever points were found."""
    t = points(spark, sf).groupBy("track").agg(F.avg("conf").alias("off"), F.avg("sigma").alias("skew"))
    h = [F.lit(v) for v in H]
    estimated = [*h[:2], F.lit(H[2]) + F.col("off"), h[3], F.lit(H[4]) + F.col("skew") / 1000, *h[5:]]
    return t.select("track", r6(stats.truth_rmse(estimated, H, SIDE, SIDE)).alias("rmse"))


def _product(a: list[str], b: list[str]) -> list[str]:
    return ["(" + " + ".join(f"({a[3 * i + k]}) * ({b[3 * k + j]})" for k in range(3)) + ")" for i in range(3) for j in range(3)]


_AB = ["1 + s", "0.01", "5.0", "-0.01", "1.0", "-3.0", "1e-5", "0.0", "1.0"]
_BA = ["1 - s", "-0.01", "-5.1", "0.01", "1.0", "3.05", "-1e-5", "0.0", "1.0"]
_C = _product(_AB, _BA)


@query(f"""WITH {POINTS}, t AS (SELECT track, avg(sigma) / 100 AS s FROM points GROUP BY track)
SELECT track, round(sqrt({" + ".join(f"pow({c} / {_C[8]} - {1 if k % 4 == 0 else 0}, 2)" for k, c in enumerate(_C))}), 6) AS departure FROM t""")
def cross_consistency(spark, sf):
    """How far the way there and the way back are from the identity."""
    t = points(spark, sf).groupBy("track").agg((F.avg("sigma") / 100).alias("s"))
    there, back = ([F.expr(v) for v in m] for m in (_AB, _BA))
    return t.select("track", r6(stats.cross_consistency(there, back)).alias("departure"))


_REF = "f AS (SELECT *, x * 1.01 + conf * 4 AS xr, y * 0.99 - sigma * 4 AS yr FROM points)"


def with_reference(spark, sf):
    return points(spark, sf).withColumns({"xr": F.col("x") * 1.01 + F.col("conf") * 4, "yr": F.col("y") * 0.99 - F.col("sigma") * 4})


@query(f"""WITH {POINTS}, {_REF}, r AS (SELECT track, sqrt((x + 2 - xr) * (x + 2 - xr) + (y - 2 - yr) * (y - 2 - yr)) AS r, conf > 0.5 AS used FROM f)
SELECT track, count(*) AS n, round(sqrt(avg(r * r)), 6) AS rmse, round(median(r), 6) AS median_error, round(avg(CAST(r <= 3 AS INTEGER)), 6) AS precision_3px, round(1 - avg(CAST(r <= 3 AS INTEGER)), 6) AS false_rate,
  round(quantile_cont(r, 0.9), 6) AS ce90, round(sqrt(avg(r * r) FILTER (used)), 6) AS rmse_fit, round(quantile_cont(r, 0.9) * 5, 5) AS ce90_m FROM r GROUP BY track""")
def scored_matches(spark, sf):
    """One row a match set against a known mapping: errors in pixels and metres, precision, false matches, fit on its own inliers."""
    p = with_reference(spark, sf)
    dx, dy = F.col("x") + 2 - F.col("xr"), F.col("y") - 2 - F.col("yr")
    p = p.select("track", F.sqrt(dx * dx + dy * dy).alias("r"), (F.col("conf") > 0.5).alias("used"))
    ok = stats.success_rate(F.col("r"), 3.0)
    inliers = F.sqrt(F.avg(F.when(F.col("used"), F.col("r") * F.col("r"))))
    return p.groupBy("track").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("r") * F.col("r")))).alias("rmse"), r6(F.median("r")).alias("median_error"), r6(ok).alias("precision_3px"), r6(1 - ok).alias("false_rate"), r6(stats.ce90(F.col("r"))).alias("ce90"), r6(inliers).alias("rmse_fit"), F.round(stats.ce90(F.col("r")) * 5, 5).alias("ce90_m"))


@query(f"""WITH {POINTS}, {_REF}, t AS (SELECT track, least(8, greatest(0.75, 3 * median(CASE WHEN sigma > 0 THEN sigma END))) AS threshold FROM points GROUP BY track),
d AS (SELECT tid, track, x + 2 - xr AS dx, y - 2 - yr AS dy, threshold FROM f JOIN t USING (track))
SELECT tid, round(dx, 4) AS residual_x, round(dy, 4) AS residual_y, sqrt(dx * dx + dy * dy) <= threshold AS inlier FROM d""")
def inlier_write_back(spark, sf):
    """Residuals and inliers of a fit, written back to the points by their id, at each track's own threshold."""
    p = with_reference(spark, sf)
    limit = p.groupBy("track").agg(stats.adaptive_threshold(F.col("sigma")).alias("threshold"))
    dx, dy = F.col("x") + 2 - F.col("xr"), F.col("y") - 2 - F.col("yr")
    found = p.join(limit, "track").select("tid", dx.alias("dx"), dy.alias("dy"), (F.sqrt(dx * dx + dy * dy) <= F.col("threshold")).alias("inlier"))
    return points(spark, sf).select("tid").join(found, "tid").select("tid", F.round("dx", 4).alias("residual_x"), F.round("dy", 4).alias("residual_y"), "inlier")


@query(f"""WITH {RASTER}, {raster_sql("other", "l_tax")}, m AS (SELECT image, r // 8 * 8 + c // 8 AS cell, avg(CAST(round(raster.v, 9) > 22 AND round(other.v, 9) > 0.03 AS INTEGER)) AS share FROM raster JOIN other USING (image, r, c) GROUP BY 1, 2)
SELECT image, cell, round(share, 6) AS share, share >= 0.25 AS valid FROM m""")
def valid_cells(spark, sf):
    """Lattice cells of each image of which enough is valid in both of two rasters. Means are taken to nine places: the order of their terms decides no more than that."""
    other = raster(spark, sf, "l_tax").withColumnRenamed("v", "w")
    both = raster(spark, sf).join(other, ["image", "r", "c"])
    cell = (F.floor(F.col("r") / 8) * 8 + F.floor(F.col("c") / 8)).cast("int").alias("cell")
    share = F.avg(((F.round("v", 9) > 22) & (F.round("w", 9) > 0.03)).cast("int"))
    return both.groupBy("image", cell).agg(r6(share).alias("share"), (share >= 0.25).alias("valid"))


@query(f"""WITH {POINTS}, {CELLS}, valid AS (SELECT cell FROM cells GROUP BY cell HAVING avg(CAST(conf > 0.25 AS INTEGER)) >= 0.75), counted AS (SELECT track, cell, count(*) AS n FROM cells GROUP BY 1, 2),
o AS (SELECT track, cell, coalesce(n, 0) AS n FROM (SELECT DISTINCT track FROM points) CROSS JOIN valid LEFT JOIN counted USING (track, cell)),
u AS (SELECT track, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_cells, avg(CAST(n > 0 AS INTEGER)) AS coverage, sum(n * n) / (sum(n) / count(*)) - sum(n) AS chi2, count(*) FILTER (n = 0) AS empty_cells FROM o GROUP BY track),
nn AS (SELECT p.tid, p.track, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS nn FROM points p JOIN points q ON p.track = q.track AND p.tid <> q.tid GROUP BY 1, 2),
e AS (SELECT track, avg(nn) / (0.5 * sqrt(262144.0 / count(*))) AS ratio FROM nn GROUP BY track)
SELECT track, n_points, n_cells, round(coverage, 6) AS coverage, round(chi2, 5) AS chi2, empty_cells, round(ratio, 6) AS ratio, coverage >= 0.9 AS coverage_pass, ratio BETWEEN 1.0 AND 1.4 AS clark_evans_pass FROM u JOIN e USING (track)""")
def valid_cell_report(spark, sf):
    """Uniformity of each track over the valid cells alone, and whether it meets its targets."""
    p = points(spark, sf)
    valid = uniform.lattice(p.select("x", "y", (F.col("conf") > 0.25).alias("inside")), SIDE, 8, 0.75).filter("valid")
    found = uniform.report(p, valid, SIDE, 8, "track", SIDE * SIDE)
    return found.select("track", "n_points", "n_cells", r6(F.col("coverage")).alias("coverage"), F.round("chi2", 5).alias("chi2"), "empty_cells", r6(F.col("ratio")).alias("ratio"), "coverage_pass", "clark_evans_pass")


_TX, _TY = _applied(H, "(tx * 64 + 32)", "(ty * 64 + 32)")


@query(f"""WITH {POINTS}, s AS (SELECT CAST(floor(x / 64) AS INTEGER) AS tx, CAST(floor(y / 64) AS INTEGER) AS ty, count(*) AS n FROM points WHERE track = 'view' GROUP BY 1, 2),
t AS (SELECT CAST(floor(x / 64) AS INTEGER) AS ux, CAST(floor(y / 64) AS INTEGER) AS uy, count(*) AS m FROM points WHERE track = 'click' GROUP BY 1, 2),
k AS (SELECT tx, ty, n, CAST(floor({_TX} / 64) AS INTEGER) AS ux, CAST(floor({_TY} / 64) AS INTEGER) AS uy FROM s)
SELECT tx, ty, ux, uy, n, m FROM k JOIN t USING (ux, uy)""")
def tile_pairs(spark, sf):
    """Each source tile with the one reference tile that its centre is mapped to: an equi-join on the computed tile."""
    at = lambda c: F.floor(F.col(c) / 64).cast("int")
    p = points(spark, sf)
    s = p.filter("track = 'view'").groupBy(at("x").alias("tx"), at("y").alias("ty")).agg(F.count("*").alias("n"))
    t = p.filter("track = 'click'").groupBy(at("x").alias("ux"), at("y").alias("uy")).agg(F.count("*").alias("m"))
    mx, my = expr.apply_homography(H, F.col("tx") * 64 + 32, F.col("ty") * 64 + 32)
    return s.withColumns({"ux": F.floor(mx / 64).cast("int"), "uy": F.floor(my / 64).cast("int")}).join(t, ["ux", "uy"]).select("tx", "ty", "ux", "uy", "n", "m")


@query(f"""WITH {POINTS}, k AS (SELECT tid, CAST(floor(y / 64) * 8 + floor(x / 64) AS INTEGER) AS tile, row_number() OVER (PARTITION BY track, floor(y / 64), floor(x / 64) ORDER BY conf DESC, tid) AS place FROM points)
SELECT tid, tile, CAST(place AS INTEGER) AS place FROM k WHERE place <= 20""")
def tile_cap(spark, sf):
    """The best points of each tile and track. Points beyond the eighth column share numbers with tiles of the next row, but not their places."""
    row, col = F.floor(F.col("y") / 64), F.floor(F.col("x") / 64)
    tile = (row * 8 + col).cast("int")
    place = F.row_number().over(Window.partitionBy("track", row, col).orderBy(F.desc("conf"), "tid"))
    return points(spark, sf).select("tid", tile.alias("tile"), place.alias("place")).filter("place <= 20")


@query(f"""WITH {POINTS}, k AS (SELECT track, tid, row_number() OVER (PARTITION BY track ORDER BY md5('26166|' || CAST(tid AS VARCHAR)), tid) AS place FROM points)
SELECT track, tid FROM k WHERE place <= 150""")
def random_subsample(spark, sf):
    """As many points of each track, in an order that a seed fixes."""
    order = Window.partitionBy("track").orderBy(F.md5(F.concat(F.lit("26166|"), F.col("tid").cast("string")).cast("binary")), "tid")
    return points(spark, sf).select("track", "tid", F.row_number().over(order).alias("place")).filter("place <= 150").drop("place")


#: The 64 bits of a code as a signed number: the last one is the sign.
_PLACES = [1 << k for k in range(63)] + [-(1 << 63)]
_BITS = " + ".join(f"(CASE WHEN embedding[{k + 1}] >= 0 THEN ({p})::BIGINT ELSE 0 END)" for k, p in enumerate(_PLACES))


@query(f"""WITH d AS (SELECT vec_id, {_BITS} AS code FROM embeddings), m AS (SELECT a.vec_id AS src, b.vec_id AS ref, bit_count(xor(a.code, b.code)) AS d FROM d a JOIN d b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, ref) AS place FROM m), t AS (SELECT src, max(ref) FILTER (place = 1) AS ref, max(d) FILTER (place = 1) AS d1, max(d) FILTER (place = 2) AS d2 FROM k WHERE place <= 2 GROUP BY src)
SELECT src, ref, CAST(d1 AS INTEGER) AS distance FROM t WHERE d1 < 0.9 * d2""")
def hamming_match(spark, sf):
    """Binary descriptors, the signs of all 64 components, by Hamming distance, with the ratio test on distances."""
    from tielace.operators.descriptors import hamming_matches

    bits = [F.when(F.get("embedding", F.lit(k)) >= 0, F.lit(p)).otherwise(F.lit(0)).cast("long") for k, p in enumerate(_PLACES)]
    code = reduce(lambda a, b: a.bitwiseOR(b), bits)
    d = table(spark, sf, "embeddings").select("vec_id", code.alias("code"))
    return hamming_matches(d.filter("vec_id % 2 = 0"), d.filter("vec_id % 2 = 1"), 0.9)


@query("""WITH b AS (SELECT c_nationkey, c_mktsegment, c_acctbal / 100 AS lon, CAST(c_custkey % 120 - 60 AS DOUBLE) AS lat FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_nationkey AS scene, round(min(lon) - 0.05, 6) AS west, round(max(lon) + 0.05, 6) AS east, round(min(lat) - 0.05::DOUBLE, 6) AS south, round(max(lat) + 0.05::DOUBLE, 6) AS north, round((max(lat) - min(lat) + 0.1::DOUBLE) * 30.323350425149::DOUBLE, 4) AS height_km FROM b GROUP BY 1""")
def footprint_union(spark, sf):
    """Bounds of all footprints of a scene, each a box around its centre, and their height."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("scene"), (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_custkey") % 120 - 60).cast("double").alias("lat"))
    km = (F.max("lat") - F.min("lat") + F.lit(0.1)) * F.lit(30.323350425149)
    return c.groupBy("scene").agg(r6(F.min("lon") - 0.05).alias("west"), r6(F.max("lon") + 0.05).alias("east"), r6(F.min("lat") - 0.05).alias("south"), r6(F.max("lat") + 0.05).alias("north"), F.round(km, 4).alias("height_km"))


@query("""SELECT event_id AS entry, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 <> 0""")
def manifest_entries(spark, sf):
    """Entries of a JSON manifest, without those that name no file (here: whose k is a multiple of three)."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    file = F.when(F.col("p.k") % 3 != 0, F.col("p.k"))
    return e.withColumn("k", file).filter("k IS NOT NULL").select(F.col("event_id").alias("entry"), F.col("event_type").alias("kind"), "k")


@query(f"""WITH {PAIRS}, s AS (SELECT method, count(*)::DOUBLE AS n, avg(rmse) AS rmse, avg(CAST(ok AS INTEGER)) AS ok FROM pairs GROUP BY method)
SELECT method, metric, round(value, 6) AS value FROM s UNPIVOT (value FOR metric IN (n, rmse, ok))""")
def metric_rows(spark, sf):
    """A row for each metric of a method."""
    s = pair_results(spark, sf).groupBy("method").agg(F.count("*").cast("double").alias("n"), F.avg("rmse").alias("rmse"), F.avg(F.col("ok").cast("int")).alias("ok"))
    return s.unpivot(["method"], ["n", "rmse", "ok"], "metric", "value").select("method", "metric", r6(F.col("value")).alias("value"))


@query(f"""WITH {POINTS}, s AS (SELECT tid, CASE WHEN conf > 0.7 THEN x END AS plane, CASE WHEN sigma > 0.5 THEN y END AS kernel, CASE WHEN conf < 0.3 THEN x + y END AS label, CASE WHEN sigma < 0.4 THEN 90 - sigma * 100 END AS elev, conf * 90 AS inc FROM points)
SELECT tid, CASE WHEN plane IS NOT NULL THEN 'backplane' WHEN kernel IS NOT NULL THEN 'spice' WHEN label IS NOT NULL THEN 'label' ELSE 'unknown' END AS source, round((coalesce(plane, kernel, label) % 360 + 360) % 360, 6) AS azimuth, round(coalesce(elev, 90 - inc), 6) AS elevation FROM s""")
def illumination_source(spark, sf):
    """The sun's place from the first source that has it; incidence stands in for elevation; none: unknown."""
    p = points(spark, sf)
    plane, kernel, label = F.when(F.col("conf") > 0.7, F.col("x")), F.when(F.col("sigma") > 0.5, F.col("y")), F.when(F.col("conf") < 0.3, F.col("x") + F.col("y"))
    source = F.when(plane.isNotNull(), "backplane").when(kernel.isNotNull(), "spice").when(label.isNotNull(), "label").otherwise("unknown")
    elevation = F.coalesce(F.when(F.col("sigma") < 0.4, 90 - F.col("sigma") * 100), 90 - F.col("conf") * 90)
    return p.select("tid", source.alias("source"), r6(expr.normalised_azimuth(F.coalesce(plane, kernel, label))).alias("azimuth"), r6(elevation).alias("elevation"))


@query("""SELECT l_orderkey // 64 AS product, round(median(l_quantity), 6) AS incidence, round(median(CASE WHEN l_tax > 0.02 THEN l_discount * 100 END), 6) AS emission, round(median(l_extendedprice / 1000) % 360, 6) AS azimuth FROM lineitem GROUP BY 1""")
def backplane_medians(spark, sf):
    """One state a product from its backplanes: medians of what is known."""
    state = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 64).alias("product"))
    emission = F.when(F.col("l_tax") > 0.02, F.col("l_discount") * 100)
    return state.agg(r6(F.median("l_quantity")).alias("incidence"), r6(F.median(emission)).alias("emission"), r6(F.median(F.col("l_extendedprice") / 1000) % 360).alias("azimuth"))


@query(f"""WITH {POINTS}, d AS (SELECT DISTINCT track, floor(y / 4) AS row FROM points), o AS (SELECT track, row, row_number() OVER (PARTITION BY track ORDER BY row) - 1 AS place, count(*) OVER (PARTITION BY track) AS n FROM d),
c AS (SELECT track, n, min(row) AS low, max(row) AS high, least(12, greatest(2, n // 8)) AS k FROM o GROUP BY ALL HAVING n >= 40), w AS (SELECT *, j / CAST(k + 1 AS DOUBLE) * (n - 1) AS pos FROM c, range(1, 13) t(j) WHERE j <= k),
q AS (SELECT w.track, w.n, low, high, j, sum(o.row * CASE WHEN o.place = floor(pos) THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END) AS v FROM w JOIN o ON o.track = w.track AND o.place IN (floor(pos), floor(pos) + 1) GROUP BY ALL),
u AS (SELECT track, n, low, high, round(v, 6) AS v, min(j) AS j FROM q WHERE v > low AND v < high GROUP BY ALL)
SELECT track, n, CAST(row_number() OVER (PARTITION BY track ORDER BY j) - 1 AS INTEGER) AS knot, v AS row FROM u""")
def jitter_knots(spark, sf):
    """A spline's knots: quantiles of the rows seen, an eighth as many, 12 at most."""
    from tielace.operators import jitter

    rows = points(spark, sf).select(F.col("track").alias("group"), F.floor(F.col("y") / 4).alias("row")).distinct()
    return jitter.knots(rows).select(F.col("group").alias("track"), "n", F.posexplode("knots").alias("knot", "row")).withColumn("row", r6(F.col("row")))


@query(f"""WITH {POINTS}, a AS (SELECT * FROM points WHERE track = 'view'), nn AS (SELECT p.tid, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS d FROM a p JOIN a q ON p.tid <> q.tid GROUP BY p.tid)
SELECT round(median(d), 6) AS spacing, round(greatest(1.0, 2 * median(d)), 6) AS radius FROM nn""")
def gate_radius(spark, sf):
    """The gate's radius: a tolerance, or twice the median spacing of track A if that is more."""
    spacing, radius = gate.spacing_radius(1.0)
    near_ = near.nearest_distance(points(spark, sf).filter("track = 'view'").select("tid", "x", "y"))
    return near_.agg(r6(spacing).alias("spacing"), r6(radius).alias("radius"))


@query(f"""WITH {_GATE}, left_b AS (SELECT tid, conf AS peak, 1 + conf * 1.2 AS ratio FROM b WHERE tid NOT IN (SELECT tid FROM accepted)), sharp AS (SELECT *, row_number() OVER (ORDER BY peak DESC, tid) AS place FROM left_b WHERE ratio > 1.5 AND peak > 0.4)
SELECT tid, CAST(place AS INTEGER) AS place, round(greatest(0, least(1, 0.6 * peak + 0.2 * least(ratio / 3, 1))), 6) AS confidence FROM sharp WHERE place <= 1200""")
def gate_single_track(spark, sf):
    """Points of track B that no agreement took up: the sharp ones, as many as the cap allows, with lower confidence."""
    a, b = tracks(spark, sf)
    left = b.join(gate.agreement(a, b, _RADIUS, _TAU / 4).select("tid"), "tid", "left_anti").select("tid", F.col("conf").alias("peak"), (1 + F.col("conf") * 1.2).alias("ratio"))
    return gate.single_track(left, 1200).select("tid", "place", r6(F.col("confidence")).alias("confidence"))


@query()
def convex_hull(spark, sf):
    """Corners of the convex hull of each track's points; tests hold it against all half-planes."""
    return uniform.convex_hull(points(spark, sf), "track").select("track", "place", "tid")


@query("""WITH p AS (SELECT p_partkey AS product, 'LROC ' || CASE p_size % 4 WHEN 0 THEN 'nacr' WHEN 1 THEN 'NACL' WHEN 2 THEN 'Wac' ELSE '' END AS i, p_name || CASE WHEN p_size % 3 = 0 THEN 'RE' ELSE '' END AS n FROM part)
SELECT product, CASE WHEN contains(upper(i), 'NACR') OR ends_with(upper(n), 'RE') THEN 'NAC_R' WHEN contains(upper(i), 'NACL') OR ends_with(upper(n), 'LE') THEN 'NAC_L' WHEN contains(upper(i), 'WAC') THEN 'WAC' ELSE 'NAC_L' END AS camera FROM p""")
def camera_names(spark, sf):
    """The camera of each product from its instrument's name or its own suffix."""
    from tielace.sources.rasters import camera_of

    size = F.col("p_size")
    instrument = F.concat(F.lit("LROC "), F.when(size % 4 == 0, "nacr").when(size % 4 == 1, "NACL").when(size % 4 == 2, "Wac").otherwise(""))
    name = F.concat("p_name", F.when(size % 3 == 0, "RE").otherwise(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product"), camera_of(instrument, name).alias("camera"))


@query("""WITH b AS (SELECT p_partkey AS product, p_size AS bands FROM part), w AS (SELECT product, bands, CASE WHEN bands % 5 = 0 THEN list_transform(range(bands), lambda k: k * 10.0 + 500) WHEN bands > 32 THEN list_transform(range(bands), lambda k: 800 + k * 4200.0 / (bands - 1)) END AS w FROM b)
SELECT product, CAST(i AS INTEGER) AS band, round(w[i + 1]::DOUBLE, 6) AS nanometres FROM w, range(50) r(i) WHERE i < len(w)""")
def band_wavelengths(spark, sf):
    """Band centres of each product: its own where it names one a band, else evenly spread over many bands."""
    from tielace.sources.rasters import wavelengths

    bands = F.col("p_size")
    given = F.when(bands % 5 == 0, F.transform(F.sequence(F.lit(0), bands - 1), lambda k: k * F.lit(10.0) + 500))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product"), F.posexplode(wavelengths(given, bands)).alias("band", "nm")).select("product", "band", r6(F.col("nm")).alias("nanometres"))


@query("""WITH c AS (SELECT c_custkey AS product, c_acctbal / 20 AS lon, c_custkey % 160 - 80 AS lat, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey END AS known FROM customer)
SELECT product, round(CASE WHEN known IS NOT NULL THEN ((lon + 180) % 360 + 360) % 360 - 180 END, 6) AS ul_lon, round(CASE WHEN known IS NOT NULL THEN ((lon + 2 + 180) % 360 + 360) % 360 - 180 END, 6) AS lr_lon, CAST(CASE WHEN known IS NOT NULL THEN lat END AS DOUBLE) AS ul_lat FROM c""")
def label_corners(spark, sf):
    """Corners from label keywords: all four or none, longitudes from -180 to 180."""
    lon, lat, known = F.col("c_acctbal") / 20, (F.col("c_custkey") % 160 - 80).cast("double"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey"))
    corners = [lat, lon, lat, lon + 2, lat - 2, lon + 2, lat - 2, F.when(known.isNotNull(), lon)]
    ul_lat, ul_lon, _, _, _, lr_lon, _, _ = expr.label_corners(corners)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("product"), r6(ul_lon).alias("ul_lon"), r6(lr_lon).alias("lr_lon"), ul_lat.alias("ul_lat"))
