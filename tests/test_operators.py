"""Operators without SQL: sequential rules, physical limits, known point processes, partition invariance."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tielace.functions import expr
from tielace.operators import near, nearest, raster, shadow, stats, uniform


def frame(spark, xy, **columns):
    rows = [(i, "t", float(x), float(y), *[float(c[i]) for c in columns.values()]) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "tid long, track string, x double, y double" + "".join(f", {c} double" for c in columns))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_photometry(spark):
    weight = lambda g: value(spark, expr.limb_weight(F.lit(float(g))))
    assert weight(0) == 1.0 and all(0 <= weight(g) <= 1 for g in (30, 90, 150, 180)) and weight(60) < weight(20)
    shade = lambda mu0, g: value(spark, expr.lunar_lambert(F.lit(mu0), F.lit(1.0), F.lit(float(g))))
    assert shade(0.0, 30) == 0.0 and shade(0.4, 30) < shade(0.9, 30)
    assert value(spark, expr.angle_between(F.lit(350.0), F.lit(10.0))) == pytest.approx(20.0)
    assert value(spark, expr.projection_kind(F.lit(-70.0), F.lit(1.0))) == "polar_stereographic"


def test_homography_and_its_guard(spark):
    x, y = expr.apply_homography((1, 0, 3, 0, 1, 4, 0, 0, 1), F.lit(1.0), F.lit(1.0))
    assert (value(spark, x), value(spark, y)) == (4.0, 5.0)
    assert value(spark, expr.apply_homography((1, 0, 0, 0, 1, 0, 0, 0, 0), F.lit(1.0), F.lit(1.0))[0]) == pytest.approx(1e12)


def test_errors_of_a_known_shift(spark):
    for dx, dy in ((1, 0), (0.3, -0.4), (3, 4)):
        rows = spark.range(200).select(F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy"))
        assert rows.agg(stats.rmse(F.col("dx"), F.col("dy"))).first()[0] == pytest.approx(math.hypot(dx, dy))
    ramp = spark.range(100).select((F.col("id") / 99).alias("r"))
    assert ramp.agg(stats.ce90(F.col("r"))).first()[0] == pytest.approx(0.9)
    known = spark.createDataFrame([(0.5,), (2.0,), (4.0,), (20.0,), (None,)], "v double")
    assert [known.agg(stats.success_rate(F.col("v"), t)).first()[0] for t in (1.0, 3.0, 5.0, 10.0)] == [0.25, 0.5, 0.75, 0.75]


def test_chi_square_tail(spark):
    table = ((1, 3.841459), (2, 5.991465), (3, 7.814728), (8, 15.507313), (63, 82.528727), (99, 123.225221))  # tabulated 5 % points
    rows = spark.createDataFrame([(x, d) for d, x in table], "x double, d int")
    assert [r[0] for r in rows.select(uniform.chi2_p("x", "d")).collect()] == pytest.approx([0.05] * len(table), abs=2e-5)
    edges = spark.createDataFrame([(0.0, 5), (None, 5), (9.0, 0), (0.3, 1), (8.5, 1)], "x double, d int")
    assert [r[0] for r in edges.select(uniform.chi2_p("x", "d")).collect()] == [1.0, None, 1.0, pytest.approx(math.erfc(0.15**0.5)), pytest.approx(math.erfc(4.25**0.5))]


def test_clark_evans_of_known_patterns(spark):
    rng = np.random.default_rng(1)
    ratio = lambda xy: uniform.clark_evans(frame(spark, xy), 512.0**2, "track").first()["ratio"]
    grid = np.stack(np.meshgrid(np.linspace(12, 500, 20), np.linspace(12, 500, 20)), -1).reshape(-1, 2)
    assert ratio(rng.uniform(0, 512, (2000, 2))) == pytest.approx(1.0, abs=0.06)
    assert ratio(grid) > 1.8
    assert ratio(rng.normal(256, 18, (400, 2)).clip(0, 511)) < 0.4


def test_nearest_distance_of_far_points(spark):
    xy = np.array([[0, 0], [1, 1], [400, 400], [511, 0]])
    got = {r["tid"]: r["nn"] for r in near.nearest_distance(frame(spark, xy)).collect()}
    want = [min(np.hypot(*(a - b)) for j, b in enumerate(xy) if j != i) for i, a in enumerate(xy)]
    assert [got[i] for i in range(4)] == pytest.approx(want)
    assert near.nearest_distance(frame(spark, xy[:1])).first()["nn"] is None


@pytest.mark.parametrize("tile", [2048, 50])
def test_nearest_points_are_those_of_all_pairs(spark, tile, monkeypatch):
    """Even, crowded and coincident points, whole and split into tiles, with a radius, and with a value to exceed."""
    monkeypatch.setattr(nearest, "TILE", tile)
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.uniform(0, 512, (500, 2)), rng.normal(100, 3, (300, 2)), np.repeat([[5.0, 5.0]], 60, 0)])
    group, q = rng.integers(0, 2, len(xy)), rng.uniform(0, 1, len(xy))
    rows = [(i, "ab"[group[i]], float(x), float(y), float(q[i]), float(q[i] / 0.9)) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame([*rows, (9999, "a", None, 1.0, 0.5, 0.5), (9998, "b", float("nan"), 1.0, 0.5, 0.5)], "tid long, track string, x double, y double, q double, need double")
    for k, radius, above in ((1, None, None), (4, 24.0, None), (1, None, ("need", "q"))):
        got = {}
        for r in nearest.nearest(points, points, k, radius, ("track",), above).collect():
            got.setdefault(r["tid"], {})[r["rank"]] = (r["n_tid"], r["d"])
        assert not {9998, 9999} & set(got)
        for i in range(len(xy)):
            d = np.hypot(*(xy - xy[i]).T)
            ok = (group == group[i]) & (np.arange(len(xy)) != i) & (d <= (radius or np.inf))
            ok &= q > q[i] / 0.9 if above else True
            best = np.flatnonzero(ok)
            best = best[np.lexsort((best, d[best]))][:k]
            own = got.get(i, {})
            assert [own[n][1] for n in sorted(own)] == pytest.approx(d[best].tolist())
            assert above or [own[n][0] for n in sorted(own)] == best.tolist()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_greedy_thinning_is_the_sequential_rule(spark, parts):
    rng = np.random.default_rng(7)
    xy, p = rng.uniform(0, 200, (400, 2)), rng.integers(0, 40, 400)
    kept = []
    for i in sorted(range(400), key=lambda i: (-p[i], i)):
        if all(np.hypot(*(xy[i] - xy[k])) > 12 for k in kept):
            kept.append(i)
    got = near.greedy_thin(frame(spark, xy, conf=p).repartition(parts), 12.0, F.col("conf"))
    assert sorted(r["tid"] for r in got.collect()) == sorted(kept)


def test_greedy_thinning_query_covers_every_track(spark, small):
    from tielace import catalogue
    from tielace.plans.views import points

    kept = {}
    for p in sorted(points(spark, small).select("tid", "track", "x", "y", "conf").collect(), key=lambda p: (-p["conf"], p["tid"])):
        own = kept.setdefault(p["track"], [])
        if all((p["x"] - k["x"]) ** 2 + (p["y"] - k["y"]) ** 2 > 144 for k in own):
            own.append(p)
    got = [r["tid"] for r in catalogue.QUERIES["greedy_thinning"](spark, small).collect()]
    assert len(kept) == 5 and sorted(got) == sorted(p["tid"] for own in kept.values() for p in own)


def test_thinning_of_a_chain_and_of_nothing(spark):
    chain = frame(spark, [(i * 1.0, 0) for i in range(40)], conf=range(40))
    assert sorted(r["tid"] for r in near.greedy_thin(chain, 1.5, F.col("conf")).collect()) == list(range(1, 40, 2))
    assert near.greedy_thin(chain.limit(0), 1.5, F.col("conf")).count() == 0


def test_farthest_points_are_the_sequential_rule(spark):
    rng = np.random.default_rng(9)
    xy, q = rng.uniform(0, 64, (120, 2)), rng.uniform(0, 1, 120)
    order = sorted(range(120), key=lambda i: (-q[i], i))
    weight = {i: ((q[i] - q.min()) / (q.max() - q.min())) ** 0.5 for i in order}
    chosen = [order[0]]
    while len(chosen) < 10:
        gap = {i: min(np.hypot(*(xy[i] - xy[c])) for c in chosen) for i in order}
        chosen.append(max((i for i in order if i not in chosen), key=lambda i: gap[i] * (0.5 + 0.5 * weight[i])))
    got = uniform.farthest_points(frame(spark, xy, quality=q), 64.0, 1, 10, "track").orderBy("place").collect()
    assert [r["tid"] for r in got] == chosen


def test_shadow_falls_away_from_the_sun(spark):
    """A peak of ten pixels with the sun at a rise of two in the east: four pixels to its west; far shadows on a long slope, by tiles."""
    pixels = spark.createDataFrame([(1, r, c, 10.0 if (r, c) == (5, 5) else 0.0) for r in range(11) for c in range(11)], "image int, r int, c int, v double")
    sun = lambda az, el: spark.createDataFrame([(1, az, el)], "image int, azimuth double, elevation double")
    for tile in (4, 256):
        dark = lambda az, el, tile=tile: {(r["r"], r["c"]) for r in shadow.cast_shadows(pixels, sun(az, el), 1.0, tile).collect() if r["shadowed"]}
        assert dark(90.0, math.degrees(math.atan(2.1))) == {(5, c) for c in range(1, 5)}
        assert dark(0.0, math.degrees(math.atan(3.9))) == {(6, 5), (7, 5)} and dark(0.0, 89.95) == set()
    assert shadow.cast_shadows(pixels.withColumn("v", F.lit(0.0)), sun(10.0, 20.0)).filter("shadowed").count() == 0
    assert shadow.cast_shadows(pixels.limit(0), sun(10.0, 20.0)).count() == 0
    far = shadow.steps(300)
    assert far[:24].tolist() == list(range(1, 25)) and far[-1] == 300 and len(far) <= 56 and shadow.steps(7).tolist() == list(range(1, 8))
    ridge = spark.createDataFrame([(1, 0, c, 100.0 if c == 299 else 0.0) for c in range(300)], "image int, r int, c int, v double")
    got = {r["c"] for r in shadow.cast_shadows(ridge, sun(90.0, math.degrees(math.atan(0.401))), 1.0, 64).collect() if r["shadowed"]}
    assert got == {299 - int(k) for k in shadow.steps(250) if k < 250}


def test_normals_of_a_plane(spark):
    plane = spark.createDataFrame([(1, r, c, 2.0 * c - 1.0 * r) for r in range(8) for c in range(8)], "image int, r int, c int, v double")
    got = raster.normals(plane).collect()
    size = math.sqrt(6)
    assert all((r["nx"], r["ny"], r["nz"]) == pytest.approx((-2 / size, -1 / size, 1 / size)) for r in got)


@pytest.mark.parametrize("slack", [0.01, 0.2])
def test_quantiles_are_exact(spark, slack):
    rng = np.random.default_rng(6)
    groups = {"even": rng.uniform(0, 1, 3000), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "same": np.full(100, 7.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("even", None), ("two", float("nan"))]
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, slack).collect()}
    for g, x in groups.items():
        assert got[g][0] == len(x) and got[g][1] == pytest.approx(np.quantile(x, shares).tolist())


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(3)
    rows = [(str(t), i, float(v)) for t in range(30) for i, v in enumerate(rng.normal(5, 1, 60))]
    got = stats.bootstrap(spark.createDataFrame(rows, "key string, i int, v double"), "key", "v", "i", replicates=200).collect()
    assert sum(r["lo"] <= 5 <= r["hi"] for r in got) >= 24 and all(r["n"] == 60 for r in got)


@pytest.mark.parametrize("kind", ["similarity", "affine", "homography"])
def test_robust_fit_recovers_the_transform(spark, kind):
    from tielace.operators import robust

    rng = np.random.default_rng(2)
    truth = {"similarity": [[0.98, -0.1, 12], [0.1, 0.98, -7], [0, 0, 1]], "affine": [[1.02, 0.05, 3], [-0.04, 0.97, 9], [0, 0, 1]], "homography": [[1.02, 0.05, 3], [-0.04, 0.97, 9], [2e-5, -3e-5, 1]]}[kind]
    rows = []
    for g in ("a", "b"):
        src = rng.uniform(0, 512, (400, 2))
        p = np.c_[src, np.ones(400)] @ np.array(truth, float).T
        ref = p[:, :2] / p[:, 2:] + rng.normal(0, 0.3, (400, 2))
        ref[:140] += rng.uniform(-80, 80, (140, 2))
        rows += [(g, i, *map(float, src[i]), *map(float, ref[i])) for i in range(400)]
    points = spark.createDataFrame(rows, "group string, tid long, x double, y double, xr double, yr double")
    got = robust.fit(points, kind, threshold=1.5).collect()
    assert sorted(r["group"] for r in got) == ["a", "b"]
    check = np.stack(np.meshgrid(np.linspace(25, 487, 24), np.linspace(25, 487, 24)), -1).reshape(-1, 2)
    p = np.c_[check, np.ones(len(check))] @ np.array(truth, float).T
    for r in got:
        assert np.sqrt((robust.residuals(np.array(r["h"]).reshape(3, 3), check, p[:, :2] / p[:, 2:]) ** 2).mean()) < 0.2
        assert 230 <= r["n_inliers"] <= 280 and r["n"] == 400
    assert robust.fit(points.limit(1), kind).count() == 0


def test_robust_fit_goes_on_until_it_is_sure(spark):
    """One point in six fits: 200 hypotheses hardly ever hold one of inliers alone, the 2000 that the confidence asks for do."""
    from tielace.operators import robust

    ask = lambda share, n: spark.range(1).select(robust.needed(F.lit(share), n, 0.9999)).first()[0]
    assert ask(0.5, 3) == 69 and ask(1 / 6, 3) == 1985 and ask(1.0, 3) == 1 and ask(0.0, 3) > 10_000
    rng = np.random.default_rng(5)
    src = rng.uniform(0, 512, (600, 2))
    ref = src @ np.array([[1.02, -0.04], [0.05, 0.97]]) + [3, 9] + rng.normal(0, 0.2, (600, 2))
    ref[:500] = rng.uniform(0, 512, (500, 2))
    rows = [("a", i, *map(float, src[i]), *map(float, ref[i])) for i in range(600)]
    got = robust.fit(spark.createDataFrame(rows, "group string, tid long, x double, y double, xr double, yr double"), "affine", threshold=1.5, hypotheses=700).collect()[0]
    assert 95 <= got["n_inliers"] <= 112 and np.allclose(np.array(got["h"]).reshape(3, 3)[:2, :2], [[1.02, 0.05], [-0.04, 0.97]], atol=0.01)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=20))
@settings(max_examples=80, deadline=None)
def test_hull_corners_have_all_points_on_one_side(xy):
    xy = sorted(set(xy))
    at = uniform.hull_of(np.array([x for x, _ in xy], float), np.array([y for _, y in xy], float))
    corners = [xy[i] for i in at]
    assert len(set(corners)) == len(corners)
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        cross = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in xy]
        assert min(cross) >= 0
        assert not [p for p, c in zip(xy, cross, strict=True) if c == 0 and p in corners and p not in (a, b)] or len(corners) == 2


def test_hull_of_every_track(spark, small):
    from tielace.plans.views import points

    rows = points(spark, small).collect()
    got = {}
    for r in uniform.convex_hull(points(spark, small).repartition(5), "track").orderBy("place").collect():
        got.setdefault(r["track"], []).append(r["tid"])
    for track, tids in got.items():
        own = [r for r in rows if r["track"] == track]
        at = uniform.hull_of(np.array([r["x"] for r in own]), np.array([r["y"] for r in own]))
        assert [own[i]["tid"] for i in at] == tids
