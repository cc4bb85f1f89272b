"""Queries over rasters: stencils, column statistics, shadow, pyramids, structure, shifts, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tielace.operators import raster as ops
from tielace.operators import shadow, structure
from tielace.operators.lineage import cut

from .registry import query
from .views import IMAGE, RASTER, images, raster, raster_sql, table


def r6(c):
    return F.round(c, 6)


_DENSE = f"""{RASTER}, grid AS (SELECT i.image, CAST(a.r AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c FROM (SELECT DISTINCT image FROM raster) i CROSS JOIN range(64) a(r) CROSS JOIN range(64) b(c)),
d AS (SELECT image, r, c, v FROM grid LEFT JOIN raster USING (image, r, c)),
n AS (SELECT image, r, c, v, lag(v) OVER wide AS west, lead(v) OVER wide AS east, lag(v) OVER tall AS up, lead(v) OVER tall AS down FROM d WINDOW wide AS (PARTITION BY image, r ORDER BY c), tall AS (PARTITION BY image, c ORDER BY r))"""
_SLOPES = f"""{_DENSE}, s AS (SELECT image, r, c, CASE WHEN west IS NULL THEN east - v WHEN east IS NULL THEN v - west ELSE (east - west) / 2 END AS e,
  CASE WHEN up IS NULL THEN down - v WHEN down IS NULL THEN v - up ELSE (down - up) / 2 END AS s FROM n)"""


def grid(spark, sf):
    return ops.dense(raster(spark, sf), 64, 64)


@query(f"""WITH {_SLOPES}
SELECT image, r, c, round(-e / sqrt(e * e + s * s + 1), 6) + 0.0 AS nx, round(s / sqrt(e * e + s * s + 1), 6) + 0.0 AS ny, round(1 / sqrt(e * e + s * s + 1), 6) AS nz FROM s""")
def surface_normals(spark, sf):
    n = ops.normals(grid(spark, sf))
    return n.select("image", "r", "c", (r6(F.col("nx")) + 0.0).alias("nx"), (r6(F.col("ny")) + 0.0).alias("ny"), r6(F.col("nz")).alias("nz"))


@query(f"""WITH {_SLOPES}, a AS (SELECT image, degrees(atan(sqrt(e * e + s * s))) AS a FROM s)
SELECT image, round(sqrt(avg(a * a)), 6) AS rms_deg, round(median(a), 6) AS median_deg FROM a GROUP BY image""")
def slope_summary(spark, sf):
    return ops.slope_summary(grid(spark, sf)).select("image", r6(F.col("rms_deg")).alias("rms_deg"), r6(F.col("median_deg")).alias("median_deg"))


@query(f"""WITH {_DENSE}, l AS (SELECT image, up + down + west + east - 4 * v AS l FROM n WHERE up + down + west + east + v IS NOT NULL), m AS (SELECT image, median(l) AS m FROM l GROUP BY image)
SELECT image, count(*) AS n, round(median(abs(l - m)) / 0.6745 / sqrt(6), 6) AS sigma FROM l JOIN m USING (image) GROUP BY image""")
def laplacian_noise(spark, sf):
    return ops.noise_sigma(grid(spark, sf)).select("image", "n", r6(F.col("sigma")).alias("sigma"))


@query(f"""WITH {_DENSE}, m AS (SELECT image, avg(v) AS m, var_pop(v) AS var, count(v) AS k FROM d GROUP BY image),
p AS (SELECT image, max(k) AS n, max(var) AS var, avg((v - m) * (east - m)) AS cx, avg((v - m) * (down - m)) AS cy FROM n JOIN m USING (image) GROUP BY image),
q AS (SELECT image, n, greatest(0, least(0.99, coalesce(cx / nullif(var, 0), 0))) AS rx, greatest(0, least(0.99, coalesce(cy / nullif(var, 0), 0))) AS ry FROM p)
SELECT image, n, round(greatest(16, n * (1 - rx) / (1 + rx) * (1 - ry) / (1 + ry)), 4) AS n_eff FROM q""")
def effective_size(spark, sf):
    return ops.effective_size(grid(spark, sf)).select("image", "n", F.round("n_eff", 4).alias("n_eff"))


@query(f"""WITH {RASTER}, m AS (SELECT image, c, median(v) AS m FROM raster GROUP BY ALL), s AS (SELECT image, median(v) AS s FROM raster GROUP BY ALL)
SELECT image, r, c, round(v - m + s, 6) AS v FROM raster JOIN m USING (image, c) JOIN s USING (image)""")
def destripe(spark, sf):
    return ops.destripe(raster(spark, sf)).select("image", "r", "c", r6(F.col("v")).alias("v"))


@query(f"""WITH {RASTER}, m AS (SELECT image, median(v) AS m FROM raster GROUP BY image), k AS (SELECT image, max(m) AS m, median(abs(v - m)) AS mad FROM raster JOIN m USING (image) GROUP BY image)
SELECT image, r, c, round(v, 6) AS v, coalesce(abs(v - m) > 2.5 * mad / 0.6745, TRUE) AS bad FROM raster JOIN k USING (image)""")
def bad_pixels(spark, sf):
    return ops.bad_pixels(raster(spark, sf), 2.5).select("image", "r", "c", r6(F.col("v")).alias("v"), "bad")


@query(f"""WITH {_DENSE}, m AS (SELECT image, median(v) AS m FROM d GROUP BY image)
SELECT image, r // 4 AS r, c // 4 AS c, round(avg(coalesce(v, m)), 6) AS v, count(*) AS n FROM d JOIN m USING (image) GROUP BY 1, 2, 3""")
def decimate(spark, sf):
    """Block means of the raster with its holes at the image's median."""
    return ops.decimate(ops.filled(grid(spark, sf)), 4).select("image", "r", "c", r6(F.col("v")).alias("v"), "n")


@query(f"""WITH {_DENSE}, mid AS (SELECT image, median(v) AS m FROM d GROUP BY image), f AS (SELECT image, r, c, coalesce(v, m) AS v FROM d JOIN mid USING (image)),
k AS (SELECT unnest(range(-3, 4)) AS k), t AS (SELECT f.image, f.r, f.c, sum(g.v) AS s1, sum(g.v * g.v) AS s2 FROM f, k JOIN f g ON g.image = f.image AND g.r = f.r AND g.c = CASE WHEN f.c + k < 0 THEN -(f.c + k) - 1 WHEN f.c + k > 63 THEN 127 - f.c - k ELSE f.c + k END GROUP BY ALL),
b AS (SELECT f.image, f.r, f.c, any_value(f.v) AS v, sum(s1) / 49 AS mean, sum(s2) / 49 AS sq FROM f, k JOIN t ON t.image = f.image AND t.c = f.c AND t.r = CASE WHEN f.r + k < 0 THEN -(f.r + k) - 1 WHEN f.r + k > 63 THEN 127 - f.r - k ELSE f.r + k END GROUP BY ALL)
SELECT image, r, c, CASE WHEN sq - mean * mean > 1e-12 * sq THEN round((v - mean) / (sqrt(sq - mean * mean) + 1e-10), 4) + 0.0 ELSE 0 END AS z FROM b""")
def local_normalisation(spark, sf):
    """Each pixel against the mean and spread of the 7 x 7 around it, mirrored at the border; holes at the image's median."""
    return structure.local_normalise(ops.filled(grid(spark, sf)), 7, 64).select("image", "r", "c", (F.round("z", 4) + 0.0).alias("z"))


@query(f"""WITH {_DENSE}, a AS (SELECT *, max(v) OVER (PARTITION BY image, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM d),
b AS (SELECT *, max(t) OVER (PARTITION BY image, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS u FROM a),
k AS (SELECT image, r, c, v, row_number() OVER (PARTITION BY image, r // 16, c // 16 ORDER BY v DESC, r, c) AS place FROM b WHERE v = u)
SELECT image, r, c, round(v, 6) AS v, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4""")
def local_maxima(spark, sf):
    return ops.local_maxima(grid(spark, sf), 2, 16, 4).select("image", "r", "c", r6(F.col("v")).alias("v"), "place")


_SHADOW = f"""{RASTER}, sun AS (SELECT image, (image * 40 + 15) % 360 AS az, 12 + image % 20 AS el, least(greatest(1, least(4096, ceil((max(v) - min(v)) / tan(radians(12 + image % 20))))), greatest(max(r), max(c)) + 1) AS far FROM raster GROUP BY image),
step AS (SELECT image, az, el, CAST(k AS BIGINT) AS k FROM sun, range(1, 25) t(k) WHERE k <= far UNION SELECT image, az, el, CAST(round_even(25 * pow(far / 25.0::DOUBLE, i / 31.0::DOUBLE), 0) AS BIGINT) FROM sun, range(32) t(i) WHERE far > 24),
ray AS (SELECT *, CAST(round_even(-cos(radians(az)) * k, 0) AS BIGINT) AS dr, CAST(round_even(sin(radians(az)) * k, 0) AS BIGINT) AS dc FROM step),
blk AS MATERIALIZED (SELECT raster.image, r - dr AS r, c - dc AS c, k, tan(radians(el)) AS rise, v AS high FROM raster JOIN ray USING (image) WHERE dr <> 0 OR dc <> 0),
lit AS (SELECT image, r, c, bool_or((high - v) / k > rise) AS s FROM raster JOIN blk USING (image, r, c) GROUP BY ALL),
shade AS (SELECT raster.image, raster.r, raster.c, coalesce(s, FALSE) AS shadowed FROM raster LEFT JOIN lit USING (image, r, c))"""


def shade(spark, sf):
    """Each image lit from a direction of its own."""
    heights = cut(raster(spark, sf))
    suns = images(spark, sf).select("image", ((F.col("image") * 40 + 15) % 360).cast("double").alias("azimuth"), (12 + F.col("image") % 20).cast("double").alias("elevation"))
    return shadow.cast_shadows(heights, suns, 1.0, 64)


@query(f"WITH {_SHADOW} SELECT image, r, c, shadowed FROM shade")
def horizon_shadow(spark, sf):
    return shade(spark, sf)


@query(f"WITH {_SHADOW} SELECT image, round(avg(CAST(shadowed AS INTEGER)), 6) AS shadow_fraction FROM shade GROUP BY image")
def shadow_fraction(spark, sf):
    return shade(spark, sf).groupBy("image").agg(r6(F.avg(F.col("shadowed").cast("int"))).alias("shadow_fraction"))


_NM = "CASE WHEN image % 3 = 2 THEN 2000 + 100 * band ELSE 700 + 150 * band END"


@query(f"""WITH all_b AS (SELECT l_orderkey // {IMAGE} AS image, l_linenumber AS band, CAST(l_orderkey % 64 AS INTEGER) AS r, CAST(l_partkey % 64 AS INTEGER) AS c, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
nm AS (SELECT image, band, {_NM} AS nm FROM (SELECT DISTINCT image, band FROM all_b)),
own AS (SELECT image, band, nm BETWEEN 900 AND 1600 AS solar, bool_or(nm BETWEEN 900 AND 1600) OVER (PARTITION BY image) AS has, row_number() OVER (PARTITION BY image ORDER BY nm, band) AS place, count(*) OVER (PARTITION BY image) AS n FROM nm),
b AS (SELECT all_b.* FROM all_b JOIN own USING (image, band) WHERE solar OR (NOT has AND place <= greatest(1, n // 4))),
m AS (SELECT image, band, c, median(v) AS m FROM b GROUP BY ALL), s AS (SELECT image, band, median(v) AS s FROM b GROUP BY ALL),
d AS (SELECT b.image, b.band, b.r, b.c, v - m + s AS v FROM b JOIN m USING (image, band, c) JOIN s USING (image, band)),
q AS (SELECT image, band, median(v) AS q FROM d GROUP BY ALL), k AS (SELECT image, band, max(q) AS q, greatest(median(abs(v - q)) / 0.6745, 1e-6) AS sigma FROM d JOIN q USING (image, band) GROUP BY ALL),
p AS (SELECT image, r, c, avg(CASE WHEN abs(v - q) <= 6 * sigma THEN v END) AS pan, count(CASE WHEN abs(v - q) <= 6 * sigma THEN v END) AS n_bands FROM d JOIN k USING (image, band) GROUP BY ALL),
f AS (SELECT image, median(pan) AS f FROM p GROUP BY image)
SELECT image, r, c, round(coalesce(pan, f), 6) AS pan, n_bands FROM p JOIN f USING (image)""")
def pseudo_panchromatic(spark, sf):
    """Bands of reflected sunlight (the shortest quarter where an image has none), each destriped by its own columns and without its bad
    pixels, averaged by pixel; holes at the image's median."""
    place = [F.floor(F.col("l_orderkey") / IMAGE).alias("image"), F.col("l_linenumber").alias("band"), (F.col("l_orderkey") % 64).cast("int").alias("r"), (F.col("l_partkey") % 64).cast("int").alias("c")]
    every = table(spark, sf, "lineitem").groupBy(*place).agg(F.avg("l_quantity").alias("v"))
    nm = F.when(F.col("image") % 3 == 2, 2000 + 100 * F.col("band")).otherwise(700 + 150 * F.col("band"))
    chosen = ops.solar_bands(every.select("image", "band").distinct().withColumn("nm", nm))
    # An image and band are one raster to the operators.
    bands = every.join(chosen, ["image", "band"]).select(F.struct("image", "band").alias("image"), "r", "c", "v")
    good = ops.bad_pixels(ops.destripe(bands))
    pan = good.groupBy(F.col("image.image").alias("image"), "r", "c").agg(F.avg(F.when(~F.col("bad"), F.col("v"))).alias("v"), F.count(F.when(~F.col("bad"), F.col("v"))).alias("n_bands"))
    mid = pan.groupBy("image").agg(F.median("v").alias("m"))
    return pan.join(mid, "image").select("image", "r", "c", r6(F.coalesce("v", "m")).alias("pan"), "n_bands")


@query(f"""WITH {RASTER}, s AS (SELECT a.image, a.r, a.v AS x, b.v AS y FROM raster a JOIN raster b ON a.image = b.image AND a.r = b.r AND a.c + 1 = b.c)
SELECT image, r // 16 AS tile, count(*) AS n, CASE WHEN count(*) >= 16 THEN round(corr(x, y), 6) END AS ncc FROM s GROUP BY 1, 2""")
def normalised_correlation(spark, sf):
    """Pearson correlation of each pixel with its eastern neighbour by tile; null below 16 pairs."""
    p = raster(spark, sf)
    shifted = p.select("image", "r", (F.col("c") - 1).alias("c"), F.col("v").alias("y"))
    tile = F.floor(F.col("r") / 16).cast("int").alias("tile")
    return p.join(shifted, ["image", "r", "c"]).groupBy("image", tile).agg(F.count("*").alias("n"), F.when(F.count("*") >= 16, r6(F.corr("v", "y"))).alias("ncc"))


@query(f"""WITH {RASTER}, {raster_sql("other", "l_extendedprice / 1024")}
SELECT image, r, c, round(CASE WHEN (r // 8 + c // 8) % 2 = 0 THEN raster.v ELSE other.v END, 4) AS v FROM raster JOIN other USING (image, r, c)""")
def checkerboard(spark, sf):
    """Squares of two co-registered rasters in turn."""
    even = (F.floor(F.col("r") / 8) + F.floor(F.col("c") / 8)) % 2 == 0
    other = raster(spark, sf, F.col("l_extendedprice") / 1024).withColumnRenamed("v", "w")
    return raster(spark, sf).join(other, ["image", "r", "c"]).select("image", "r", "c", F.round(F.when(even, F.col("v")).otherwise(F.col("w")), 4).alias("v"))


@query(f"""WITH {RASTER}, q AS (SELECT image, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM raster WHERE v <> 0 GROUP BY image)
SELECT image, r, c, round(greatest(0, least(1, (v - lo) / nullif(hi - lo, 0))), 6) AS v FROM raster JOIN q USING (image)""")
def percentile_stretch(spark, sf):
    """Between the image's 1st and 99th percentile of what isn't 0."""
    p = raster(spark, sf)
    q = p.filter("v <> 0").groupBy("image").agg(F.percentile("v", F.lit(0.01)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi"))
    z = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    return p.join(q, "image").select("image", "r", "c", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z))).alias("v"))


_C = "0.7071067811865476"


@query(f"""WITH {_SLOPES}, p AS (SELECT image, r, c, e * e AS xx, e * s AS xy, s * s AS yy FROM s),
a AS (SELECT image, r, c, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy, sum(yy) OVER w AS yy FROM p WINDOW w AS (PARTITION BY image, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT image, r, c, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy, sum(yy) OVER w AS yy FROM a WINDOW w AS (PARTITION BY image, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
f AS (SELECT image, r, c, greatest(0, xx) AS e0, greatest(0, xx * 0.5 + xy + yy * 0.5) AS e1, greatest(0, yy) AS e2, greatest(0, xx * 0.5 - xy + yy * 0.5) AS e3 FROM b WHERE xx IS NOT NULL AND xy IS NOT NULL AND yy IS NOT NULL)
SELECT image, r, c, round(e0 / greatest(sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3), 1e-9), 4) AS east, round(e2 / greatest(sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3), 1e-9), 4) AS south FROM f""")
def orientation_energy(spark, sf):
    """Shares of the change of brightness along east and south, of four directions."""
    e = ops.orientation_energy(grid(spark, sf))
    return e.select("image", "r", "c", F.round(F.get("energy", F.lit(0)), 4).alias("east"), F.round(F.get("energy", F.lit(2)), 4).alias("south"))


@query(f"""WITH {RASTER}, k AS (SELECT unnest(range(-2, 3)) AS k), m AS (SELECT s.image, s.r // 32 AS tile_row, s.c // 32 AS tile_col, x.k AS dr, y.k AS dc, s.v AS a, t.v AS b
  FROM raster s CROSS JOIN k x CROSS JOIN k y JOIN raster t ON t.image = s.image AND t.r = s.r + x.k AND t.c = s.c + y.k + 1),
f AS (SELECT image, tile_row, tile_col, dr, dc, count(*) AS n, corr(a, b) AS ncc FROM m GROUP BY ALL HAVING count(*) >= 16 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b))),
p AS (SELECT *, row_number() OVER (PARTITION BY image, tile_row, tile_col ORDER BY round(ncc, 9) DESC, dr * dr + dc * dc, dr, dc) AS place FROM f)
SELECT image, tile_row, tile_col, CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, round(ncc, 6) AS ncc, n FROM p WHERE place = 1""")
def tile_shift(spark, sf):
    """Each tile found again in the raster moved west by a pixel, at the best of 25 shifts."""
    p = raster(spark, sf)
    moved = p.select("image", "r", (F.col("c") - 1).alias("c"), "v")
    return ops.best_shift(p, moved, 32, 2).select("image", "tile_row", "tile_col", "dr", "dc", r6(F.col("ncc")).alias("ncc"), "n")


#: Footprints of a cell that one part of it takes from one side.
CROWD = 512
_BOXES = """b AS (SELECT o_custkey % 50 + 50 * (o_orderkey // 20000) AS product, min(o_totalprice) AS x0, min(o_totalprice) + 20000 + (o_custkey % 50) * 100 AS x1,
  min(o_custkey) AS y0, min(o_custkey) + 300 AS y1 FROM orders GROUP BY product, o_custkey % 50)"""


@query(f"""WITH {_BOXES}
SELECT a.product AS a, c.product AS b, round(least(a.x1, c.x1) - greatest(a.x0, c.x0), 4) AS width, round(least(a.y1, c.y1) - greatest(a.y0, c.y0), 4)::DOUBLE AS height,
  round((least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)), 2) AS area
FROM b a JOIN b c ON a.product < c.product AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1""")
def footprint_overlap(spark, sf):
    """Footprints that overlap, by joining the grid cells that each covers; a pair counts in its first shared cell. A crowded cell is joined in parts."""
    o, side, high = table(spark, sf, "orders"), 10_000.0, 100.0
    product = (F.col("o_custkey") % 50 + 50 * F.floor(F.col("o_orderkey") / 20000)).alias("product")
    boxes = o.groupBy(product, (F.col("o_custkey") % 50).alias("k")).agg(F.min("o_totalprice").alias("x0"), F.min("o_custkey").alias("y0"))
    boxes = boxes.select("product", "x0", (F.col("x0") + 20000 + F.col("k") * 100).alias("x1"), "y0", (F.col("y0") + 300).alias("y1"))
    at = lambda c, size: F.floor(F.col(c) / size)
    cells = boxes.withColumn("i", F.explode(F.sequence(at("x0", side), at("x1", side)))).withColumn("j", F.explode(F.sequence(at("y0", high), at("y1", high))))
    parts = cells.groupBy("i", "j").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    cells = cells.join(parts, ["i", "j"])
    other = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    cells = cells.withColumn("part", F.pmod(F.xxhash64("product"), "parts").cast("int")).drop("parts")
    other = other.select(*[F.col(c).alias(f"o_{c}") for c in other.columns])
    low_x, low_y = F.greatest("x0", "o_x0"), F.greatest("y0", "o_y0")
    first = (F.floor(low_x / side) == F.col("i")) & (F.floor(low_y / high) == F.col("j"))
    near = (F.col("x0") <= F.col("o_x1")) & (F.col("o_x0") <= F.col("x1")) & (F.col("y0") <= F.col("o_y1")) & (F.col("o_y0") <= F.col("y1"))
    met = cells.join(other, (F.col("i") == F.col("o_i")) & (F.col("j") == F.col("o_j")) & (F.col("part") == F.col("o_part")) & (F.col("product") < F.col("o_product")) & near & first)
    width, height = F.least("x1", "o_x1") - low_x, F.least("y1", "o_y1") - low_y
    return met.select(F.col("product").alias("a"), F.col("o_product").alias("b"), F.round(width, 4).alias("width"), height.cast("double").alias("height"), F.round(width * height, 2).alias("area"))


@query("""WITH s AS (SELECT DISTINCT CAST(p_size * 40 AS INTEGER) AS h FROM part), o AS (SELECT h, unnest(CASE WHEN h <= 256 THEN [0] ELSE list_distinct(list_concat(range(0, h - 256 + 1, 128), [h - 256])) END) AS o FROM s)
SELECT h, CAST(o AS INTEGER) AS origin FROM o""")
def tile_origins(spark, sf):
    """Tiles of 256 with half overlap along each distinct height; the last one is flush with the border."""
    h = F.col("h")
    steps = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(h - 256, F.lit(0)), F.lit(128)), F.array(F.greatest(h - 256, F.lit(0)))))
    return table(spark, sf, "part").select((F.col("p_size") * 40).cast("int").alias("h")).distinct().select("h", F.explode(steps).alias("origin"))
