"""Queries over pair results and labels: summaries, intervals, calibration, leaderboards, policy lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tielace.functions import expr, fixed
from tielace.operators import stats

from .registry import query
from .views import PAIRS, POINTS, pair_results, points, table


def r6(c):
    return F.round(c, 6)


_RESIDUAL = "sqrt((x - 256) * (x - 256) + (y - 256) * (y - 256)) / 40"


def with_residual(spark, sf):
    dx, dy = F.col("x") - 256, F.col("y") - 256
    return points(spark, sf).withColumn("residual", F.sqrt(dx * dx + dy * dy) / 40)


@query(f"""WITH {POINTS} SELECT track, count(*) AS n, round(sqrt(avg((x - 256) * (x - 256) + (y - 256) * (y - 256))), 6) AS rmse, round(quantile_cont({_RESIDUAL}, 0.9), 6) AS ce90,
  round(median({_RESIDUAL}), 6) AS median_residual, round(avg(CAST({_RESIDUAL} <= 3 AS INTEGER)), 6) AS precision_3px, round(least(8, greatest(0.75, 3 * median(CASE WHEN sigma > 0 THEN sigma END))), 6) AS threshold FROM points GROUP BY track""")
def residual_metrics(spark, sf):
    p = with_residual(spark, sf)
    dx, dy, res = F.col("x") - 256, F.col("y") - 256, F.col("residual")
    return p.groupBy("track").agg(F.count("*").alias("n"), r6(stats.rmse(dx, dy)).alias("rmse"), r6(stats.ce90(res)).alias("ce90"), r6(F.median(res)).alias("median_residual"), r6(stats.success_rate(res, 3.0)).alias("precision_3px"), r6(stats.adaptive_threshold(F.col("sigma"))).alias("threshold"))


@query(f"""WITH {POINTS}, r AS (SELECT track, tid, {_RESIDUAL} / sigma AS ratio FROM points WHERE sigma > 1e-9), k AS (SELECT track, ratio, row_number() OVER (PARTITION BY track ORDER BY ratio, tid) AS place, count(*) OVER (PARTITION BY track) AS n FROM r)
SELECT track, max(n) AS n, round(CASE WHEN max(n) < 12 THEN 1 ELSE greatest(0.2, least(50, sqrt(avg(ratio * ratio) FILTER (n - 2 * floor(n * 0.2) < 8 OR (place > floor(n * 0.2) AND place <= n - floor(n * 0.2)))))) END, 6) AS factor FROM k GROUP BY track""")
def variance_factor(spark, sf):
    f = stats.variance_factor(with_residual(spark, sf), ["track"], "sigma", "residual")
    return f.select("track", "n", r6(F.col("factor")).alias("factor"))


@query(f"""WITH {POINTS}, s AS (SELECT sigma, {_RESIDUAL} AS residual FROM points WHERE sigma > 0), e AS (SELECT list_sort(list_distinct(quantile_cont(sigma, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS e FROM s),
b AS (SELECT i - 1 AS bin, e[i] AS lo, e[i + 1] AS hi FROM e, range(1, 9) t(i) WHERE i < len(e))
SELECT CAST(bin AS INTEGER) AS bin, round(avg(sigma), 6) AS sigma_pred, round(sqrt(avg(residual * residual)), 6) AS residual_rms, count(*) AS n FROM b JOIN s ON sigma BETWEEN lo AND hi GROUP BY bin HAVING count(*) >= 3""")
def sigma_calibration(spark, sf):
    c = stats.calibration(with_residual(spark, sf), "sigma", "residual")
    return c.select("bin", r6(F.col("sigma_pred")).alias("sigma_pred"), r6(F.col("residual_rms")).alias("residual_rms"), "n")


@query(f"""WITH {PAIRS} SELECT method, count(*) AS n_pairs, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, round(avg(rmse), 6) AS rmse_mean, round(median(rmse), 6) AS rmse_median,
  round(avg(CASE WHEN rmse IS NOT NULL THEN CAST(rmse <= 50 AS INTEGER) END), 6) AS sr_ok_50, round(avg(coalesce(CAST(rmse <= 50 AS INTEGER), 0)), 6) AS sr_all_50,
  round(avg(CASE WHEN rmse IS NOT NULL THEN CAST(rmse <= 100 AS INTEGER) END), 6) AS sr_ok_100, round(avg(coalesce(CAST(rmse <= 100 AS INTEGER), 0)), 6) AS sr_all_100,
  round(avg(CASE WHEN rmse IS NOT NULL THEN CAST(rmse <= 200 AS INTEGER) END), 6) AS sr_ok_200, round(avg(coalesce(CAST(rmse <= 200 AS INTEGER), 0)), 6) AS sr_all_200,
  array_to_string(list_sort(list(DISTINCT error) FILTER (error IS NOT NULL))[1:3], '; ') AS errors FROM pairs GROUP BY method""")
def method_summary(spark, sf):
    s = stats.method_summary(pair_results(spark, sf))
    return s.select(*[r6(F.col(c)).alias(c) if c.startswith(("rmse", "sr_")) else F.col(c) for c in s.columns])


@query(f"""WITH {PAIRS} SELECT method, sweep, count(*) AS n, count(rmse) AS n_known, round(avg(rmse), 6) AS rmse FROM pairs GROUP BY method, sweep""")
def sweep_mean(spark, sf):
    return pair_results(spark, sf).groupBy("method", "sweep").agg(F.count("*").alias("n"), F.count("rmse").alias("n_known"), r6(F.avg("rmse")).alias("rmse"))


@query(f"""WITH {PAIRS}, v AS (SELECT method, pair_id, unnest([struct_pack(metric := 'rmse', value := rmse), struct_pack(metric := 'log_rmse', value := CASE WHEN ok THEN ln(1 + rmse) END), struct_pack(metric := 'ok_share', value := CAST(ok AS DOUBLE))]) AS m FROM pairs),
k AS (SELECT method, pair_id, m.metric AS metric, m.value AS v FROM v WHERE m.value IS NOT NULL),
ids AS (SELECT DISTINCT pair_id FROM k), n AS (SELECT pair_id, rep, {stats.drawn_sql("pair_id", "rep")} AS n FROM ids CROSS JOIN range(1, 1001) r(rep)),
r AS (SELECT method, metric, rep, sum(n * v) / nullif(sum(n), 0) AS mean FROM k JOIN n USING (pair_id) WHERE n > 0 GROUP BY ALL),
e AS (SELECT method, metric, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM r GROUP BY ALL), o AS (SELECT method, metric, count(*) AS n, avg(v) AS mean FROM k GROUP BY ALL)
SELECT method, metric, n, round(mean, 4) AS mean, round(CASE WHEN n = 1 THEN mean ELSE lo END, 4) AS lo, round(CASE WHEN n = 1 THEN mean ELSE hi END, 4) AS hi FROM o JOIN e USING (method, metric)""")
def bootstrap_interval(spark, sf):
    """Intervals of every metric of every method over all pairs, 1000 replicates."""
    p = pair_results(spark, sf).select("method", "pair_id", "rmse", F.when(F.col("ok"), F.log1p("rmse")).alias("log_rmse"), F.col("ok").cast("double").alias("ok_share"))
    b = stats.bootstrap_all(p, "method", ["rmse", "log_rmse", "ok_share"], "pair_id")
    return b.select("method", "metric", "n", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")])


@query(f"""WITH {PAIRS}, s AS (SELECT method, count(*) AS n, count(rmse) AS n_ok, avg(rmse) AS rmse FROM pairs GROUP BY method)
SELECT CAST(row_number() OVER (ORDER BY rmse NULLS LAST, method) AS INTEGER) AS place, method, CASE WHEN n_ok = 0 THEN 'no registration' ELSE format('{{:.3f}} ({{}}/{{}} failed)', rmse, n - n_ok, n) END AS line FROM s""")
def leaderboard(spark, sf):
    """One row a method (a few), so the ranking window is over that table."""
    s = pair_results(spark, sf).groupBy("method").agg(F.count("*").alias("n"), F.count("rmse").alias("n_ok"), F.avg("rmse").alias("rmse"))
    line = F.when(F.col("n_ok") == 0, "no registration").otherwise(F.format_string("%.3f (%d/%d failed)", "rmse", F.col("n") - F.col("n_ok"), "n"))
    return s.select(F.row_number().over(Window.orderBy(F.asc_nulls_last("rmse"), "method")).alias("place"), "method", line.alias("line"))


@query(f"""WITH {PAIRS}, s AS (SELECT method, sweep, avg(rmse) AS rmse FROM pairs GROUP BY 1, 2)
SELECT a.method, a.sweep, round(a.rmse / nullif(f.rmse, 0), 6) AS ratio FROM s a JOIN s f ON a.sweep = f.sweep AND f.method = '1-URGENT' WHERE a.method <> '1-URGENT'""")
def ablation_delta(spark, sf):
    s = pair_results(spark, sf).groupBy("method", "sweep").agg(F.avg("rmse").alias("rmse"))
    full = s.filter("method = '1-URGENT'").select("sweep", F.col("rmse").alias("full"))
    return s.filter("method <> '1-URGENT'").join(full, "sweep").select("method", "sweep", r6(F.try_divide("rmse", "full")).alias("ratio"))


@query(f"""WITH {PAIRS} SELECT m.method, p.sweep, count(*) AS cells FROM (SELECT DISTINCT method FROM pairs) m CROSS JOIN pairs p GROUP BY ALL""")
def methods_by_pairs(spark, sf):
    """Every method with every pair, counted by sweep; the pairs are counted first, so few rows meet."""
    p = pair_results(spark, sf)
    counts = p.groupBy("sweep").agg(F.count("*").alias("cells"))
    return p.select("method").distinct().crossJoin(counts)


@query(f"""WITH {PAIRS} SELECT CASE WHEN n < 30 THEN 'similarity' WHEN d > 10 THEN 'homography' ELSE 'affine' END AS kind, count(*) AS n FROM (SELECT CAST(rmse AS INTEGER) AS n, pair_id % 25 AS d FROM pairs WHERE ok) GROUP BY 1""")
def model_choice(spark, sf):
    kind = expr.model_kind(F.bround("rmse").cast("int"), F.col("pair_id") % 25)
    return pair_results(spark, sf).filter("ok").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def policy(spark):
    """The payload policy: six fixed rows."""
    rows = [(p, list(refs), lo, hi) for p, refs, lo, hi in fixed.REFERENCE_POLICY]
    return spark.createDataFrame(rows, "payload string, preferred array<string>, least_gsd double, most_gsd double")


_PAYLOADS, _REFERENCES = ("OHRC", "TMC2_NADIR", "IIRS", "WAC", "TMC2_AFT"), ("NAC_L", "KAGUYA_TC", "WAC", "NAC_R", "SLDEM_HILLSHADE")
_PRODUCTS = f"SELECT s_suppkey AS product, {list(_PAYLOADS)}[CAST(s_suppkey % 5 AS INTEGER) + 1] AS payload, {list(_REFERENCES)}[CAST(s_nationkey % 5 AS INTEGER) + 1] AS reference, abs(s_acctbal) / 100 AS gsd, 1 + s_nationkey AS ref_gsd FROM supplier"
_POLICY = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {list(refs)}, {lo}::DOUBLE, {hi}::DOUBLE)" for p, refs, lo, hi in fixed.REFERENCE_POLICY) + ") AS t(payload, preferred, lo, hi)"


@query(f"""WITH p AS ({_PRODUCTS}), k AS ({_POLICY}), j AS (SELECT p.*, coalesce(k.preferred, {list(fixed.DEFAULT_POLICY[0])}) AS preferred, coalesce(lo, {fixed.DEFAULT_POLICY[1]}) AS lo, coalesce(hi, {fixed.DEFAULT_POLICY[2]}) AS hi FROM p LEFT JOIN k USING (payload))
SELECT product, payload, reference, preferred[1] AS first_choice, round(greatest(gsd, ref_gsd) / greatest(1e-9, least(gsd, ref_gsd)), 3) AS scale_ratio, ref_gsd BETWEEN lo AND hi AS within_gsd_band,
  ref_gsd BETWEEN lo AND hi AND list_contains(preferred, reference) AS within_policy FROM j""")
def pairing_verdict(spark, sf):
    """Policy lookup with a default row, then the verdict on the reference: its resolution within the band, and its sensor among the preferred ones."""
    of = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.col(k) % 5).cast("int"))
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("product"), of(_PAYLOADS, "s_suppkey").alias("payload"), of(_REFERENCES, "s_nationkey").alias("reference"), (F.abs("s_acctbal") / 100).alias("gsd"), (F.col("s_nationkey") + 1).alias("ref_gsd"),
    )
    names, low, high = fixed.DEFAULT_POLICY
    j = s.join(F.broadcast(policy(spark)), "payload", "left").withColumn("preferred", F.coalesce("preferred", F.array(*map(F.lit, names))))
    inside = F.col("ref_gsd").between(F.coalesce("least_gsd", F.lit(low)), F.coalesce("most_gsd", F.lit(high)))
    ratio = F.greatest("gsd", "ref_gsd") / F.greatest(F.lit(1e-9), F.least("gsd", "ref_gsd"))
    return j.select("product", "payload", "reference", F.get("preferred", F.lit(0)).alias("first_choice"), F.round(ratio, 3).alias("scale_ratio"), inside.alias("within_gsd_band"), (inside & F.array_contains("preferred", F.col("reference"))).alias("within_policy"))


@query("""WITH k AS (SELECT o_orderkey AS label, unnest([struct_pack(k := 'image.sub_solar_azimuth', v := CAST(round(o_totalprice % 360, 2) AS VARCHAR) || ' <deg>', p := 1), struct_pack(k := 'a.b.sun_elev', v := 'elev ' || CAST(o_custkey % 90 AS VARCHAR), p := 2),
    struct_pack(k := CASE WHEN o_orderkey % 3 = 0 THEN 'x.solar_azimuth' ELSE 'other' END, v := '12.5', p := 3), struct_pack(k := 'map_scale', v := '-1.5e1 m', p := 4)]) AS e FROM orders),
t AS (SELECT label, regexp_extract(e.k, '[^.]+$') AS tail, e.v AS v, e.p AS p FROM k),
a AS (SELECT * FROM (VALUES ('sun_azimuth', 'sun_azimuth', 0), ('sun_azimuth', 'solar_azimuth', 1), ('sun_azimuth', 'sub_solar_azimuth', 2), ('sun_elevation', 'sun_elev', 2), ('gsd', 'map_scale', 1)) x(quantity, alias, place)),
m AS (SELECT label, quantity, min_by(v, struct_pack(a := place, b := p)) AS v FROM t JOIN a ON t.tail = a.alias GROUP BY 1, 2)
SELECT label, quantity, round(TRY_CAST(regexp_extract(v, '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?') AS DOUBLE), 6) AS number FROM m""")
def label_alias(spark, sf):
    """Label keys matched by their last part against ordered spellings; the first spelling, then the first key, wins."""
    o = table(spark, sf, "orders")
    price = F.format_string("%s <deg>", F.round(F.col("o_totalprice") % 360, 2).cast("string"))
    entry = lambda k, v, p: F.struct(k.alias("k"), v.alias("v"), F.lit(p).alias("p"))
    entries = F.array(
        entry(F.lit("image.sub_solar_azimuth"), price, 1),
        entry(F.lit("a.b.sun_elev"), F.concat(F.lit("elev "), (F.col("o_custkey") % 90).cast("string")), 2),
        entry(F.when(F.col("o_orderkey") % 3 == 0, "x.solar_azimuth").otherwise("other"), F.lit("12.5"), 3),
        entry(F.lit("map_scale"), F.lit("-1.5e1 m"), 4),
    )
    from tielace.sources.labels import quantities

    return quantities(o.select(F.col("o_orderkey").alias("label"), F.explode(entries).alias("e")).select("label", F.col("e.k").alias("key"), F.col("e.v").alias("value"), F.col("e.p").alias("place"))).select("label", "quantity", r6(F.col("number")).alias("number"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS t FROM orders)
SELECT id, epoch_us(coalesce(try_strptime(rtrim(t, 'Z'), '%Y-%m-%dT%H:%M:%S'), try_strptime(rtrim(t, 'Z'), '%Y-%m-%d %H:%M:%S'), try_strptime(rtrim(t, 'Z'), '%Y-%m-%d'))) AS micros FROM s""")
def parse_time(spark, sf):
    from tielace.sources.labels import parsed_time

    o, d = table(spark, sf, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("unknown")
    return o.select(F.col("o_orderkey").alias("id"), F.unix_micros(parsed_time(text)).alias("micros"))


@query("""SELECT d.quality AS truth, count(*) AS n, round(avg(CAST(n_chars > 1000 AS INTEGER)), 6) AS long_share, count(*) FILTER (n_chars > 1000 AND d.quality = 1) AS true_positive FROM labels d JOIN documents USING (doc_id) GROUP BY d.quality""")
def scored_truth(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    big = F.col("n_chars") > 1000
    return j.groupBy(F.col("quality").alias("truth")).agg(F.count("*").alias("n"), r6(F.avg(big.cast("int"))).alias("long_share"), F.count_if(big & (F.col("quality") == 1)).alias("true_positive"))


@query("""WITH s AS (SELECT conv_id AS run, turn AS seq, role AS stage, length(text) AS size, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT run, seq, stage, CAST(size AS BIGINT) AS size, CAST(size - coalesce(before, 0) AS BIGINT) AS step FROM s""")
def stage_log(spark, sf):
    """Per-run stages with the change from the stage before."""
    before = F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    size = F.length("text").cast("long")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("role").alias("stage"), size.alias("size"), (size - F.coalesce(before, F.lit(0))).alias("step"))


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN upper(p_type) LIKE '%BRASS%' THEN 'OHRC' WHEN upper(p_type) LIKE '%STEEL%' THEN 'IIRS' WHEN upper(p_name) LIKE '%A%' THEN 'TMC2_NADIR' ELSE 'SYNTHETIC' END AS sensor FROM part),
p AS (SELECT * FROM (VALUES ('OHRC', 100.0, 0.55), ('IIRS', 35.0, 0.70), ('TMC2_NADIR', 90.0, 0.50), ('SYNTHETIC', 1e6, 0.0)) t(sensor, snr, psf))
SELECT sensor, count(*) AS n, round(max(snr)::DOUBLE, 3) AS snr, round(max(psf)::DOUBLE, 3) AS psf FROM s JOIN p USING (sensor) GROUP BY sensor""")
def sensor_profiles(spark, sf):
    """Sensor from label text, then the degradation profile by broadcast lookup (ten fixed rows)."""
    kind, name = F.upper("p_type"), F.upper("p_name")
    sensor = F.when(kind.contains("BRASS"), "OHRC").when(kind.contains("STEEL"), "IIRS").when(name.contains("A"), "TMC2_NADIR").otherwise("SYNTHETIC")
    profiles = spark.createDataFrame([(p[0], p[1], p[2]) for p in fixed.SENSOR_PROFILES], "sensor string, snr double, psf double")
    s = table(spark, sf, "part").groupBy(sensor.alias("sensor")).agg(F.count("*").alias("n"))
    return s.join(F.broadcast(profiles), "sensor").select("sensor", "n", F.round("snr", 3).alias("snr"), F.round("psf", 3).alias("psf"))
