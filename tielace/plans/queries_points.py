"""Queries over point sets: expressions, lattice, neighbours, gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tielace.functions import expr
from tielace.operators import gate, near, nearest, uniform

from .registry import query
from .views import POINTS, SIDE, points, table

H = (1.02, 0.03, -5.0, -0.02, 0.98, 7.5, 1e-5, -2e-5, 1.0)


def r6(c):
    return F.round(c, 6)


@query(f"""WITH {POINTS}
SELECT tid, track, round(sigma * sigma + sigma * sigma, 6) AS trace_sigma, round(sqrt((sigma * sigma + sigma * sigma) / 2), 6) AS sigma_rms,
  round(conf / (1 + (sigma * sigma + sigma * sigma)), 6) AS quality FROM points""")
def quality_score(spark, sf):
    trace = expr.trace_sigma(F.col("sigma"), F.col("sigma"))
    return points(spark, sf).select("tid", "track", r6(trace).alias("trace_sigma"), r6(F.sqrt(trace / 2)).alias("sigma_rms"), r6(expr.quality(F.col("conf"), trace)).alias("quality"))


@query(f"""WITH {POINTS}, a AS (SELECT tid, x * 3 - 500 AS p, y * 2 AS q FROM points), d AS (SELECT tid, abs(p - q) % 360 AS d FROM a)
SELECT tid, round(CASE WHEN d < 360 - d THEN d ELSE 360 - d END, 6) AS difference FROM d""")
def angular_difference(spark, sf):
    return points(spark, sf).select("tid", r6(expr.angle_between(F.col("x") * 3 - 500, F.col("y") * 2)).alias("difference"))


_W = "(1e-5 * x + -2e-5 * y + 1.0)"


@query(f"""WITH {POINTS}
SELECT tid, round((1.02 * x + 0.03 * y - 5.0) / {_W}, 6) AS xr, round((-0.02 * x + 0.98 * y + 7.5) / {_W}, 6) AS yr FROM points""")
def apply_homography(spark, sf):
    x, y = expr.apply_homography(H, F.col("x"), F.col("y"))
    return points(spark, sf).select("tid", r6(x).alias("xr"), r6(y).alias("yr"))


@query(f"""WITH {POINTS}, m AS (
  SELECT tid, (1.02 * x + 0.03 * y - 5.0) / {_W} AS x0, (1.02 * (x + 1) + 0.03 * y - 5.0) / (1e-5 * (x + 1) + -2e-5 * y + 1.0) AS x1,
    (-0.02 * x + 0.98 * y + 7.5) / {_W} AS y0, (-0.02 * x + 0.98 * (y + 1) + 7.5) / (1e-5 * x + -2e-5 * (y + 1) + 1.0) AS y2 FROM points)
SELECT tid, round(x1 - x0, 6) AS dxdx, round(y2 - y0, 6) AS dydy FROM m""")
def local_jacobian(spark, sf):
    xx, _, _, yy = expr.jacobian(H, F.col("x"), F.col("y"))
    return points(spark, sf).select("tid", r6(xx).alias("dxdx"), r6(yy).alias("dydy"))


@query(f"""WITH {POINTS}, g AS (SELECT tid, greatest(0, cos(radians(x / 512 * 100))) AS mu0, greatest(1e-6, cos(radians(y / 512 * 80))) AS mu, conf * 160 AS g FROM points),
w AS (SELECT *, greatest(0, least(1, 1.0 - 1.9e-2 * g + 2.42e-4 * g * g - 1.46e-6 * g * g * g)) AS l FROM g)
SELECT tid, round(l, 6) AS weight, round(0.12 * (2 * l * mu0 / (mu0 + mu) + (1 - l) * mu0), 6) AS lunar_lambert, round(0.12 * mu0 / (mu0 + mu), 6) AS lommel_seeliger, round(0.12 * mu0, 6) AS lambert FROM w""")
def lunar_lambert(spark, sf):
    mu0, mu, phase = F.greatest(F.lit(0.0), F.cos(F.radians(F.col("x") / 512 * 100))), F.greatest(F.lit(1e-6), F.cos(F.radians(F.col("y") / 512 * 80))), F.col("conf") * 160
    return points(spark, sf).select("tid", r6(expr.limb_weight(phase)).alias("weight"), r6(expr.lunar_lambert(mu0, mu, phase)).alias("lunar_lambert"), r6(expr.lommel_seeliger(mu0, mu)).alias("lommel_seeliger"), r6(expr.lambert(mu0)).alias("lambert"))


@query(f"""WITH {POINTS}, s AS (SELECT tid, ((x * 2 - 200) % 360 + 360) % 360 AS az, y / 512 * 90 AS el, conf * 40 AS em FROM points),
p AS (SELECT *, 90 - el AS inc FROM s)
SELECT tid, round(az, 6) AS azimuth, round(inc, 6) AS incidence,
  round(degrees(acos(greatest(-1, least(1, cos(radians(inc)) * cos(radians(em)) + sin(radians(inc)) * sin(radians(em)) * cos(radians(az)))))), 6) AS phase,
  round(cos(radians(el)) * sin(radians(az)), 6) AS east, round(cos(radians(el)) * cos(radians(az)), 6) AS north, round(sin(radians(el)), 6) AS up FROM p""")
def illumination_state(spark, sf):
    az, el, em = expr.normalised_azimuth(F.col("x") * 2 - 200), F.col("y") / 512 * 90, F.col("conf") * 40
    inc = expr.incidence_of(F.lit(None).cast("double"), el)
    e, n, u = expr.sun_vector(az, el)
    return points(spark, sf).select("tid", r6(az).alias("azimuth"), r6(inc).alias("incidence"), r6(expr.coplanar_phase(F.lit(None).cast("double"), inc, em, az)).alias("phase"), r6(e).alias("east"), r6(n).alias("north"), r6(u).alias("up"))


@query(f"""WITH {POINTS}, l AS (SELECT tid, x * 2 - 300 AS lon, y / 512 * 178 - 89 AS lat, sigma * 100 AS km FROM points)
SELECT tid, round((((lon + 180) % 360 + 360) % 360) - 180, 6) AS lon, CASE WHEN abs(lat) > 60 THEN 'polar_stereographic' WHEN km > 50 THEN 'oblique_stereographic' ELSE 'equirectangular' END AS kind,
  round(1737400.0 * cos(radians(10)) * radians((((lon - 20 + 180) % 360 + 360) % 360) - 180), 3) AS x, round(1737400.0 * radians(lat), 3) AS y,
  round(pi() * 1737400.0 / 180 * cos(radians(lat)), 4) AS m_per_degree,
  round(2 * 1737400.0 * tan(radians((90 - lat) / 2)) * sin(radians(lon)), 1) AS polar_x FROM l""")
def map_projection(spark, sf):
    lon, lat = F.col("x") * 2 - 300, F.col("y") / 512 * 178 - 89
    x, y = expr.equirectangular(lon, lat, 20.0, 10.0)
    px, _ = expr.polar_stereographic(lon, lat)
    return points(spark, sf).select("tid", r6(expr.wrapped_longitude(lon)).alias("lon"), expr.projection_kind(lat, F.col("sigma") * 100).alias("kind"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(expr.metres_per_degree(lat)[0], 4).alias("m_per_degree"), F.round(px, 1).alias("polar_x"))


@query(f"""WITH {POINTS}, c AS (SELECT tid, track, sigma + 0.1 AS sx, conf + 0.2 AS sy, (sigma + 0.1) * (conf + 0.2) * 0.4 AS sxy, x, y FROM points),
e AS (SELECT *, (sx * sx + sy * sy) / 2 AS mid, sqrt((sx * sx - sy * sy) * (sx * sx - sy * sy) / 4 + sxy * sxy) AS half FROM c)
SELECT tid, round(sqrt(greatest(0, mid + half)), 6) AS major, round(sqrt(greatest(0, mid - half)), 6) AS minor, round(degrees(atan2(2 * sxy, sx * sx - sy * sy)) / 2, 6) AS direction,
  round(x * tan(radians(30)) * sin(radians(y)), 6) AS parallax_x, round(x * tan(radians(30)) * cos(radians(y)), 6) AS parallax_y FROM e""")
def error_ellipse(spark, sf):
    sx, sy = F.col("sigma") + 0.1, F.col("conf") + 0.2
    a, b, t = expr.ellipse(sx, sy, sx * sy * 0.4)
    px, py = expr.parallax(F.col("x"), F.lit(30.0), F.col("y"))
    return points(spark, sf).select("tid", r6(a).alias("major"), r6(b).alias("minor"), r6(t).alias("direction"), r6(px).alias("parallax_x"), r6(py).alias("parallax_y"))


CELLS = """cells AS (
  SELECT *, CAST(least(greatest(floor(y * 8 / 512.0), 0), 7) * 8 + least(greatest(floor(x * 8 / 512.0), 0), 7) AS INTEGER) AS cell FROM points
)"""


@query(f"""WITH {POINTS}, {CELLS}
SELECT tid, cell, cell // 8 * 64 AS row0, cell % 8 * 64 AS col0 FROM cells""")
def cell_assignment(spark, sf):
    p = uniform.with_cells(points(spark, sf), SIDE, 8)
    return p.select("tid", "cell", F.floor(F.col("cell") / 8).cast("int").__mul__(64).alias("row0"), (F.col("cell") % 8 * 64).alias("col0"))


_QUALITY = "conf / (1 + 2 * sigma * sigma)"


def with_quality(spark, sf):
    return points(spark, sf).withColumn("quality", F.col("conf") / (1 + 2 * F.col("sigma") * F.col("sigma")))


@query(f"""WITH {POINTS}, {CELLS}, q AS (SELECT track, cell, tid, {_QUALITY} AS quality FROM cells),
k AS (SELECT *, row_number() OVER (PARTITION BY track, cell ORDER BY quality DESC, tid) AS place FROM q)
SELECT track, cell, tid, round(quality, 6) AS quality, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4""")
def cell_quota(spark, sf):
    return uniform.quota(with_quality(spark, sf), SIDE, 8, 4, "track").select("track", "cell", "tid", r6(F.col("quality")).alias("quality"), "place")


@query(f"""WITH {POINTS}, {CELLS} SELECT track, cell, max_by(tid, struct_pack(c := conf, t := -tid)) AS tid, round(max(conf), 6) AS conf FROM cells GROUP BY track, cell""")
def best_per_cell(spark, sf):
    p = uniform.with_cells(points(spark, sf), SIDE, 8)
    return p.groupBy("track", "cell").agg(F.max_by("tid", F.struct("conf", -F.col("tid"))).alias("tid"), r6(F.max("conf")).alias("conf"))


@query(f"""WITH {POINTS} SELECT tid, round(conf, 6) AS conf FROM points ORDER BY points.conf DESC, tid LIMIT 100""")
def top_confidence(spark, sf):
    return points(spark, sf).orderBy(F.desc("conf"), "tid").limit(100).select("tid", r6(F.col("conf")).alias("conf"))


@query(f"""WITH {POINTS}, k AS (SELECT track, tid, row_number() OVER (PARTITION BY track ORDER BY conf DESC, tid) AS place, count(*) OVER (PARTITION BY track) AS n FROM points)
SELECT track, tid, CAST(place AS INTEGER) AS place, greatest(n - 1200, 0) AS dropped FROM k WHERE place <= 1200""")
def single_track_cap(spark, sf):
    p = points(spark, sf)
    counts = p.groupBy("track").agg(F.greatest(F.count("*") - 1200, F.lit(0)).alias("dropped"))
    best = p.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("conf"), "tid"))).filter("place <= 1200")
    return best.join(counts, "track").select("track", "tid", "place", "dropped")


_OCCUPIED = f"""{POINTS}, {CELLS}, counted AS (SELECT track, cell, count(*) AS n FROM cells GROUP BY 1, 2),
every AS (SELECT track, CAST(cell AS INTEGER) AS cell FROM (SELECT DISTINCT track FROM points) t CROSS JOIN range(64) r(cell)),
occupied AS (SELECT track, cell, coalesce(n, 0) AS n FROM every LEFT JOIN counted USING (track, cell))"""


@query(f"""WITH {POINTS}, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, CAST(least(greatest(floor(y * 8 / 512.0), 0), 7) * 8 + least(greatest(floor(x * 8 / 512.0), 0), 7) AS INTEGER) ORDER BY {_QUALITY} DESC, tid) AS place FROM points) WHERE place <= 4
), cells AS (
  SELECT *, CAST(least(greatest(floor(y * 8 / 512.0), 0), 7) * 8 + least(greatest(floor(x * 8 / 512.0), 0), 7) AS INTEGER) AS cell FROM best
), counted AS (SELECT track, cell, count(*) AS n FROM cells GROUP BY 1, 2),
every AS (SELECT track, CAST(cell AS INTEGER) AS cell FROM (SELECT DISTINCT track FROM points) t CROSS JOIN range(64) r(cell)),
occupied AS (SELECT track, cell, coalesce(n, 0) AS n FROM every LEFT JOIN counted USING (track, cell))
SELECT track, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_cells, round(avg(CAST(n > 0 AS INTEGER)), 6) AS coverage, round(sum(n * n) / (sum(n) / count(*)) - sum(n), 6) AS chi2, count(*) - 1 AS dof FROM occupied GROUP BY track""")
def uniformity_report_by_track(spark, sf):
    best = uniform.quota(with_quality(spark, sf), SIDE, 8, 4, "track").drop("cell", "place")
    u = uniform.uniformity(uniform.occupancy(best, SIDE, 8, "track"), "track")
    return u.select("track", "n_points", "n_cells", r6(F.col("coverage")).alias("coverage"), r6(F.col("chi2")).alias("chi2"), "dof")


@query(f"""WITH {_OCCUPIED}
SELECT track, CAST(sum(n) AS BIGINT) AS n_points, round(sum(n * n) / (sum(n) / count(*)) - sum(n), 6) AS chi2, count(*) - 1 AS dof FROM occupied GROUP BY track""")
def occupancy_chi2(spark, sf):
    u = uniform.uniformity(uniform.occupancy(points(spark, sf), SIDE, 8, "track"), "track")
    return u.select("track", "n_points", r6(F.col("chi2")).alias("chi2"), "dof")


@query(f"""WITH RECURSIVE {_OCCUPIED}, u AS (SELECT track, sum(n * n) / (sum(n) / count(*)) - sum(n) AS x, count(*) - 1 AS dof FROM occupied GROUP BY track),
f AS (SELECT track, 1 AS i, 2 * sqrt(x / 2 / pi()) * exp(-x / 2) AS t, 0.0::DOUBLE AS s, x FROM u UNION ALL SELECT track, i + 1, t * (x / 2) / (i + 0.5), s + t, x FROM f WHERE i <= 31)
SELECT track, 63 AS dof, round(least(1, max(s)), 9) AS p FROM f GROUP BY track""")
def occupancy_p_value(spark, sf):
    """Survival function of the occupancy chi-square. (The SQL leaves erfc out, which is below 1e-12 for so many points.)"""
    u = uniform.uniformity(uniform.occupancy(points(spark, sf), SIDE, 8, "track"), "track")
    return u.select("track", F.col("dof").cast("int").alias("dof"), F.round(uniform.chi2_p("chi2", "dof"), 9).alias("p"))


_SIXTEEN = "CAST(least(greatest(floor(y * 16 / 512.0), 0), 15) * 16 + least(greatest(floor(x * 16 / 512.0), 0), 15) AS INTEGER)"


@query(f"""WITH {POINTS}, has AS (SELECT DISTINCT track, {_SIXTEEN} AS cell FROM points WHERE conf > 0.8)
SELECT track, CAST(cell AS INTEGER) AS cell FROM (SELECT DISTINCT track FROM points) t CROSS JOIN range(256) r(cell) EXCEPT SELECT track, cell FROM has""")
def empty_cells(spark, sf):
    p = points(spark, sf)
    has = uniform.with_cells(p.filter("conf > 0.8"), SIDE, 16).select("track", "cell").distinct()
    return uniform.all_cells(p, 16, "track").join(has, ["track", "cell"], "left_anti")


@query(f"""WITH {POINTS}, n AS (
  SELECT p.tid, p.track, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS nn FROM points p JOIN points q ON p.track = q.track AND p.tid <> q.tid GROUP BY 1, 2)
SELECT track, count(*) AS n, round(avg(nn), 6) AS mean_nn, round(avg(nn) / (0.5 * sqrt(512.0 * 512.0 / count(*))), 6) AS ratio,
  round((avg(nn) - 0.5 * sqrt(512.0 * 512.0 / count(*))) / (0.26136 / sqrt(CAST(count(*) AS DOUBLE) * count(*) / (512.0 * 512.0))), 6) AS z FROM n GROUP BY track""")
def clark_evans(spark, sf):
    p = points(spark, sf)
    found = uniform.clark_evans(p, SIDE * SIDE, "track")
    return found.select("track", "n", r6(F.col("mean_nn")).alias("mean_nn"), r6(F.col("ratio")).alias("ratio"), r6(F.col("z")).alias("z"))


_RADIUS, _TAU = 24.0, 12.0


def tracks(spark, sf):
    """Track A: views, track B: clicks; reference positions are displaced by a little that depends on the point."""
    p = points(spark, sf).withColumns({"xr": F.col("x") + 5 + F.col("conf") * 6, "yr": F.col("y") - 3 + F.col("sigma") * 6})
    cols = ("tid", "x", "y", "xr", "yr", "conf")
    return p.filter("track = 'view'").select(*cols), p.filter("track = 'click'").select(*cols)


_GATE = f"""{POINTS}, t AS (SELECT *, x + 5 + conf * 6 AS xr, y - 3 + sigma * 6 AS yr FROM points), a AS (SELECT * FROM t WHERE track = 'view'), b AS (SELECT * FROM t WHERE track = 'click'),
d AS (SELECT b.tid, b.x, b.y, b.xr, b.yr, b.conf, a.tid AS n_tid, a.xr - a.x AS dx, a.yr - a.y AS dy, a.conf AS n_conf, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM b JOIN a ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_RADIUS} * {_RADIUS}),
k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, n_tid) AS place, 1 / greatest(d, 1e-3) AS w FROM d),
m AS (SELECT tid, x, y, xr, yr, conf, count(*) AS n_near, sum(w * dx) / sum(w) AS dx, sum(w * dy) / sum(w) AS dy, sum(w * n_conf) / sum(w) AS wa FROM k WHERE place <= 4 GROUP BY ALL),
g AS (SELECT *, sqrt((x + dx - xr) * (x + dx - xr) + (y + dy - yr) * (y + dy - yr)) AS gap FROM m),
accepted AS (SELECT * FROM g WHERE gap <= {_TAU} / 4)"""


@query(f"""WITH {_GATE}
SELECT tid, n_near, round(gap, 5) AS gap, round(((x + dx) * wa + xr * conf) / greatest(wa + conf, 1e-9), 5) AS xr, round(((y + dy) * wa + yr * conf) / greatest(wa + conf, 1e-9), 5) AS yr,
  round(greatest(0, least(1, 0.5 * (wa + conf) + 0.25)), 5) AS confidence FROM accepted""")
def agreement_gate(spark, sf):
    a, b = tracks(spark, sf)
    g = gate.agreement(a, b, _RADIUS, _TAU / 4)
    return g.select("tid", "n_near", *[F.round(c, 5).alias(c) for c in ("gap", "xr", "yr", "confidence")])


@query(f"""WITH {_GATE} SELECT tid, round(conf, 6) AS conf FROM a WHERE tid NOT IN (SELECT n_tid FROM k JOIN accepted USING (tid) WHERE place <= 4)""")
def unused_track_a(spark, sf):
    a, b = tracks(spark, sf)
    return gate.unused(a, b, gate.agreement(a, b, _RADIUS, _TAU / 4), _RADIUS).select("tid", r6(F.col("conf")).alias("conf"))


@query(f"""WITH {_GATE} SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM accepted) AS n_agreed, round((SELECT count(*) FROM accepted) / (SELECT count(*) FROM b), 6) AS agreement_rate""")
def gate_counts(spark, sf):
    a, b = tracks(spark, sf)
    count = lambda d, n: d.agg(F.count("*").alias(n))
    one = count(a, "n_a").join(count(b, "n_b")).join(count(gate.agreement(a, b, _RADIUS, _TAU / 4), "n_agreed"))
    return one.withColumn("agreement_rate", r6(F.try_divide("n_agreed", "n_b")))


@query(f"""WITH {POINTS}, q AS (SELECT tid, track, x, y, {_QUALITY} AS q FROM points),
e AS (SELECT track, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) AS diameter FROM q GROUP BY track)
SELECT a.tid, a.track, round(least(coalesce(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), max(diameter)), max(diameter)), 6) AS radius
FROM q a JOIN e ON a.track = e.track LEFT JOIN q b ON a.track = b.track AND b.q > a.q / 0.9 AND b.tid <> a.tid GROUP BY a.tid, a.track""")
def suppression_radius(spark, sf):
    """Distance to the nearest clearly better point of the track, at most the extent of its points."""
    p = with_quality(spark, sf).select("tid", "track", "x", "y", "quality", (F.col("quality") / 0.9).alias("need"))
    extent = p.groupBy("track").agg(F.sqrt(F.pow(F.max("x") - F.min("x"), 2) + F.pow(F.max("y") - F.min("y"), 2)).alias("diameter"))
    found = nearest.nearest(p, p, keys=("track",), above=("need", "quality")).select("tid", "d")
    out = p.join(found, "tid", "left").join(extent, "track")
    return out.select("tid", "track", r6(F.least(F.coalesce("d", "diameter"), F.col("diameter"))).alias("radius"))


@query(f"""WITH {POINTS} SELECT tid, track FROM points WHERE track = 'view' UNION ALL SELECT tid, track FROM points WHERE track = 'click' UNION ALL SELECT tid, 'reseed' FROM points WHERE track = 'error' AND conf > 0.9""")
def union_tracks(spark, sf):
    p = points(spark, sf)
    again = p.filter("track = 'error' AND conf > 0.9").select("tid", F.lit("reseed").alias("track"))
    return p.filter("track = 'view'").select("tid", "track").unionByName(p.filter("track = 'click'").select("tid", "track")).unionByName(again)


@query(f"""WITH {POINTS} SELECT {_SIXTEEN} AS cell FROM points WHERE track = 'signup' AND conf > 0.5 INTERSECT SELECT {_SIXTEEN} FROM points WHERE track = 'purchase' AND conf > 0.5""")
def intersect_cells(spark, sf):
    p = uniform.with_cells(points(spark, sf).filter("conf > 0.5"), SIDE, 16)
    return p.filter("track = 'signup'").select("cell").intersect(p.filter("track = 'purchase'").select("cell"))


@query(f"""WITH {POINTS} SELECT {_SIXTEEN} AS cell FROM points WHERE track = 'signup' AND conf > 0.5 EXCEPT SELECT {_SIXTEEN} FROM points WHERE track = 'purchase' AND conf > 0.9""")
def except_cells(spark, sf):
    p = uniform.with_cells(points(spark, sf), SIDE, 16)
    return p.filter("track = 'signup' AND conf > 0.5").select("cell").subtract(p.filter("track = 'purchase' AND conf > 0.9").select("cell"))


def _rounds(most: int) -> str:
    """Choosing as many points of each cell, a round a table."""
    found = f"""{POINTS}, {CELLS}, q AS (SELECT track, cell, tid, x, y, {_QUALITY} AS quality FROM cells),
w AS (SELECT *, min(quality) OVER c AS low, max(quality) OVER c AS high FROM q WINDOW c AS (PARTITION BY track, cell)),
g1 AS (SELECT track, cell, tid, x, y, quality, (1 + CASE WHEN high - low > 1e-12 THEN sqrt((quality - low) / (high - low)) ELSE 1 END) / 2 AS weight, NULL::DOUBLE AS gap FROM w)"""
    for k in range(1, most + 1):
        worth, some = ("quality", "") if k == 1 else ("gap * weight", "WHERE gap > 0")
        found += f""",
c{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, cell ORDER BY {worth} DESC, quality DESC, tid) AS k FROM g{k} {some}) WHERE k = 1),
g{k + 1} AS (SELECT g.track, g.cell, g.tid, g.x, g.y, g.quality, g.weight, least(coalesce(g.gap, 1e300), sqrt((g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y))) AS gap FROM g{k} g JOIN c{k} c ON g.track = c.track AND g.cell = c.cell AND g.tid <> c.tid)"""
    return f"WITH {found} " + " UNION ALL ".join(f"SELECT track, cell, tid, {k} AS place FROM c{k}" for k in range(1, most + 1))


@query(_rounds(4))
def farthest_point_quota(spark, sf):
    """Four points of each cell that are good and far from each other."""
    return uniform.farthest_points(with_quality(spark, sf), SIDE, 8, 4, "track")


@query()
def greedy_thinning(spark, sf):
    """Greedy minimum distance by confidence, within each track; tests hold it against the sequential rule."""
    return near.greedy_thin(points(spark, sf).select("tid", "track", "x", "y", "conf"), 12.0, F.col("conf"), ("track",)).select("tid", r6(F.col("conf")).alias("conf"))


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 2 = 0), f AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT e.vec_id AS src, f.vec_id AS ref, e.label = f.label AS right_label, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS c FROM e CROSS JOIN f),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, ref) AS place FROM d),
t AS (SELECT src, max(CASE WHEN place = 1 THEN ref END) AS ref, bool_or(place = 1 AND right_label) AS correct, max(CASE WHEN place = 1 THEN c END) AS c1, max(CASE WHEN place = 2 THEN c END) AS c2 FROM k WHERE place <= 2 GROUP BY src)
SELECT src, ref, round(c1, 5) AS cosine, correct FROM t WHERE 1 - c1 < 0.9 * greatest(1 - c2, 1e-9)""")
def lowe_ratio_match(spark, sf):
    from tielace.operators.descriptors import ratio_matches

    d = table(spark, sf, "embeddings")
    found = ratio_matches(d.filter("vec_id % 2 = 0"), d.filter("vec_id % 2 = 1"), 0.9)
    return found.select("src", "ref", F.round("cosine", 5).alias("cosine"), "correct")


@query()
def robust_affine(spark, sf):
    """Affine fit of each track's displaced points; tests recover known transforms."""
    from tielace.operators import robust

    p = points(spark, sf)
    x, y = expr.apply_homography(H, F.col("x"), F.col("y"))
    off = F.when(F.col("conf") < 0.2, F.col("sigma") * 90).otherwise(F.col("sigma") * 0.2)
    fits = robust.fit(p.select(F.col("track").alias("group"), "tid", "x", "y", (x + off).alias("xr"), (y - off).alias("yr")), "affine", 4.0)
    return fits.select("group", "n", "n_inliers", F.round("rmse", 3).alias("rmse"))
