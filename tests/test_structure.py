"""Structural matching and refinement on small images with known answers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_rasters import imaged, terrain

from tielace.operators import descriptors, refine, reseed, structure, tiles


def stacked(found, rows, cols, n=8):
    out = np.full((rows, cols, n), np.nan)
    for r in found.collect():
        out[r["r"], r["c"]] = [r[f"c{k}"] for k in range(n)]
    return out


def test_channels_by_tiles_are_those_of_the_whole_image(spark):
    a = terrain(50)[:, :41]
    names = [f"c{k}" for k in range(8)]
    got = [stacked(tiles.pixels(structure.channel_tiles(imaged(spark, a), t), t, *names).filter("r < 50 AND c < 41"), 50, 41) for t in (16, 64)]
    whole = structure.channels(np.pad(a, 9, constant_values=np.nan), -9, -9, 50, 41)
    assert np.isfinite(whole).all() and np.allclose((whole**2).sum(axis=2), 1)
    for g in got:
        assert np.allclose(g, whole)
    assert np.allclose(whole, structure.channels(np.pad(5 - 3 * a, 9, constant_values=np.nan), -9, -9, 50, 41))
    assert structure.channel_tiles(imaged(spark, a).limit(0), 16).count() == 0


def test_correlation_is_pearson_by_channel():
    rng = np.random.default_rng(1)
    search, template = rng.standard_normal((12, 10, 3)), rng.standard_normal((5, 4, 3))
    template[:, :, 2] = 1.0  # flat: adds nothing
    got = structure.correlation(search, template)
    want = [[sum(np.corrcoef(search[r : r + 5, c : c + 4, k].ravel(), template[:, :, k].ravel())[0, 1] for k in range(2)) / 3 for c in range(7)] for r in range(8)]
    assert np.allclose(got, want)


def test_peaks():
    y, x = np.mgrid[0:15, 0:15]
    surface = 1 - 0.01 * ((y - 6.3) ** 2 + (x - 8.8) ** 2)
    r, c, top, sharp = structure.peak_of(surface)
    assert (r, c) == pytest.approx((6.3, 8.8)) and top == surface[6, 9] and sharp == pytest.approx(top / max(surface[10, 9], surface[6, 5]))
    assert structure.peak_of(surface[:4, :4])[3] is None and structure.peak_of(surface - 5)[3] is None
    assert structure.peak_of(np.zeros((9, 9)))[:3] == (0, 0, 0)


@pytest.mark.parametrize("light", [1.0, -2.5])
def test_a_patch_is_found_again_whatever_the_contrast(spark, light):
    a = terrain(150)
    source, reference = a[10:130, 10:130], 3 + light * a[7:127, 14:134]  # reference(r + 3, c - 4) shows source(r, c)
    rows = [(1, k, 40.0 + 9 * (k % 4), 45.0 + 11 * (k // 4), 40.0 + 9 * (k % 4) - 2, 45.0 + 11 * (k // 4) + 1) for k in range(12)]
    rows += [(1, 90, 5.0, 60.0, 5.0, 60.0), (1, 91, 60.0, 60.0, 115.0, 60.0), (1, 92, 500.0, 60.0, 60.0, 60.0), (2, 93, 60.0, 60.0, 60.0, 60.0)]
    points = spark.createDataFrame(rows, "image int, key int, xs double, ys double, xr double, yr double")
    for tile in (32, 256):
        got = {r["key"]: r for r in structure.template_match(points, imaged(spark, source), imaged(spark, reference), 24, 16, tile).collect()}
        assert len(got) == len(rows)
        for _, k, xs, ys, _, _ in rows[:12]:
            assert got[k]["x"] == pytest.approx(xs - 4, abs=0.15) and got[k]["y"] == pytest.approx(ys + 3, abs=0.15)
            assert got[k]["peak"] > 0.95 and (got[k]["sharpness"] is None or got[k]["sharpness"] > 1.2)
        assert all((got[k]["peak"], got[k]["sharpness"], got[k]["x"]) == (0, 0, x) for k, x in ((90, 5), (91, 115), (92, 60), (93, 60)))


def test_templates_of_many_points_leave_python_in_small_batches(spark):
    """What templates of sixty tiles' points come to, 64 KB each, is given back as it is made."""
    rows = spark.range(0, 60, 1, 1).selectExpr("id image", "cast(0 as double) v")
    taken = []

    class Rows:
        """A table whose step is run here."""

        columns, schema, sparkSession = rows.columns, rows.schema, spark

        def mapInArrow(self, run, schema):
            taken.extend(run(iter([pa.RecordBatch.from_pydict({"image": list(range(60)), "v": [0.0] * 60})])))

    made = lambda row: [[{"key": k, "template": np.full(1 << 13, float(row["image"]))} for k in range(16)]]
    tiles.each(Rows(), made, "found array<struct<key:int,template:array<double>>>", keep=["image"])
    assert [i for b in taken for i in b.column(0).to_pylist()] == list(range(60))
    assert max(b.nbytes for b in taken) <= tiles.OUT_BYTES + (2 << 20)


def test_crowded_tiles_become_several_rows(spark):
    a = terrain(40)
    points = spark.range(1000).selectExpr("1 image", "id key", "20.0D x", "20.0D y")
    held = structure.met(points, tiles.cut(imaged(spark, a), 64), "x", "y", 64, "key").select(F.size("points").alias("n"), "v").collect()
    assert sum(r["n"] for r in held) == 1000 and len(held) == 8 and max(r["n"] for r in held) < 200


@pytest.mark.parametrize("run", [lambda p, a: structure.template_match(p, a, a, 24, 16, 32), lambda p, a: refine.refine(p, a, a, 24, 4.0, tile=32)], ids=["template_match", "refine"])
def test_patches_are_cut_once(spark, run):
    """Four Python steps: both sides' tiles, the patches of the source, and what is found with them; points are counted by tile before that."""
    rows = [(1, k, 30.0 + k, 30.0, 30.0 + k, 30.0) for k in range(300)] + [(2, 300, 30.0, 30.0, 30.0, 30.0)]
    points = spark.createDataFrame(rows, "image int, key int, xs double, ys double, xr double, yr double")
    found = run(points, imaged(spark, terrain(70)).localCheckpoint())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4
    assert sorted(r["key"] for r in found.select("key").collect()) == list(range(301))


def shifted(a, dx, dy):
    """A periodic image whose content lies (dx, dy) further, by its spectrum."""
    fy, fx = np.meshgrid(np.fft.fftfreq(a.shape[0]), np.fft.fftfreq(a.shape[1]), indexing="ij")
    return np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (fx * dx + fy * dy))).real


def smooth(n, seed=4, spread=2.0):
    """A periodic terrain without what interpolation can't follow."""
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(n), np.fft.fftfreq(n)))
    a = np.fft.ifft2(np.fft.fft2(np.random.default_rng(seed).standard_normal((n, n))) * np.exp(-2 * (np.pi * f * spread) ** 2)).real
    return (a - a.mean()) / a.std()


@pytest.mark.parametrize(("dx", "dy"), [(0.0, 0.0), (1.26, -2.38), (-3.5, 0.14)])
def test_phase_shifts_to_a_twentieth_of_a_pixel(dx, dy):
    a = terrain(64)
    got = refine.phase_shift(a, shifted(a, dx, dy) * 2 + 1, 50)
    assert got[:2] == pytest.approx((dx, dy), abs=0.05)
    assert refine.phase_shift(np.ones((16, 16)), a[:16, :16]) is None


def test_least_squares_matching_recovers_shift_scale_and_light():
    a = smooth(96)
    blocks, wants = [], []
    v, u = np.mgrid[0:48, 0:48].astype(float)
    for k, (dx, dy) in enumerate([(0.3, -0.4), (-0.8, 0.55), (0.0, 0.0), (0.1, 0.9)]):
        turn = np.array([[1.0, 0.02 * k], [-0.015 * k, 1 - 0.01 * k]])
        xs, ys = turn[0, 0] * (u - 23.5 - dx) + turn[0, 1] * (v - 23.5 - dy) + 47.5, turn[1, 0] * (u - 23.5 - dx) + turn[1, 1] * (v - 23.5 - dy) + 47.5
        blocks.append(3 + 1.7 * refine.interpolated(a[None], xs[None], ys[None])[0])
        wants.append((dx, dy))
    own = np.stack([a[24:72, 24:72]] * 4)
    got = refine.least_squares(own, np.stack(blocks))
    assert got["converged"].all() and (got["rounds"] <= 12).all()
    assert np.allclose(np.stack([got["dx"], got["dy"]], 1), wants, atol=0.05) and np.isfinite(got["cov"]).all()
    flat = refine.least_squares(np.stack([np.ones((48, 48)), own[0]]), np.stack([own[0], np.random.default_rng(0).standard_normal((48, 48))]))
    assert not flat["converged"][0] and np.isnan(flat["cov"][0]).all()


def test_sigma_is_that_of_the_errors():
    """Noise on both patches: the errors of 80 matches spread as their covariances say, within a factor of two."""
    a, rng = smooth(64), np.random.default_rng(3)
    own, other = (np.stack([a[8:56, 8:56] + 0.15 * rng.standard_normal((48, 48)) for _ in range(80)]) for _ in range(2))
    got = refine.least_squares(own, other)
    error = np.sqrt((got["dx"] ** 2 + got["dy"] ** 2)[got["converged"]].mean())
    said = np.sqrt((got["cov"][:, 0] + got["cov"][:, 1])[got["converged"]].mean())
    assert got["converged"].mean() > 0.9 and 0.5 < error / said < 2


def test_paraboloids():
    y, x = np.mgrid[-1:2, -1:2]
    dx, dy, cov = refine.paraboloid(3 - (x - 0.3) ** 2 - 2 * (y + 0.2) ** 2 + 0.1 * x * y)
    assert -2 * (dx - 0.3) + 0.1 * dy == pytest.approx(0) and -4 * (dy + 0.2) + 0.1 * dx == pytest.approx(0) and np.allclose(cov, 0)
    assert np.isnan(refine.paraboloid((x * x - y * y).astype(float))[2]).all()
    assert np.isfinite(refine.surface_covariance(smooth(32), smooth(32), 4)).all()


def test_matches_are_refined_across_tiles(spark):
    a = smooth(200)
    source, reference = a[20:180, 20:180], shifted(a, 1.3, -0.7)[20:180, 20:180] * 0.5 + 4
    rows = [(1, f"k{k}", 45.0 + 17.3 * (k % 4), 45.0 + 22.9 * (k // 4), 45.0 + 17.3 * (k % 4) + 2, 45.0 + 22.9 * (k // 4), None) for k in range(12)]
    rows += [(1, "edge", 10.0, 60.0, 60.0, 60.0, None), (1, "far", 60.0, 60.0, 70.0, 60.0, None), (2, "none", 60.0, 60.0, 60.0, 60.0, None), (1, "turned", 80.0, 80.0, 81.0, 79.0, [1.0, 0.0, 0.0, 1.0])]
    points = spark.createDataFrame(rows, "image int, key string, xs double, ys double, xr double, yr double, turn array<double>")
    for tile in (48, 256):
        got = {r["key"]: r for r in refine.refine(points, imaged(spark, source), imaged(spark, reference), 40, 4.0, tile=tile).collect()}
        assert len(got) == len(rows)
        for _, k, xs, ys, xr, yr, _ in [*rows[:12], rows[-1]]:
            assert (got[k]["x"], got[k]["y"]) == pytest.approx((xs + 1.3, ys - 0.7), abs=0.05) and got[k]["method"] == "lsm" and got[k]["reason"] is None
            assert 0 < got[k]["var_x"] < 0.01 and got[k]["shift"] == pytest.approx(np.hypot(got[k]["x"] - xr, got[k]["y"] - yr))
        assert got["edge"]["reason"] == got["none"]["reason"] == "patch" and got["far"]["reason"] == "drift" and got["far"]["x"] == 70
    only = refine.refine(points.filter("key = 'k1'"), imaged(spark, source), imaged(spark, reference), 40, 4.0, squares=False).collect()[0]
    assert only["method"] == "paraboloid" and only["x"] == pytest.approx(rows[1][2] + 1.3, abs=0.5)
    assert refine.refine(points.limit(0), imaged(spark, source), imaged(spark, reference), 40).count() == 0


def test_a_task_holds_few_tiles_however_many_it_has(spark):
    """Forty tiles of a MB in one task, with a session whose batches have no bound: a row's array is a part of its batch's."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("image"), F.array_repeat(F.lit(0.5), 1 << 17).alias("v"))
    got = tiles.each(rows, lambda row: [row["v"].base.nbytes, float(row["v"].sum())], "held long, total double", keep=["image"]).collect()
    assert len(got) == 40 and all(r["total"] == 1 << 16 for r in got)
    assert max(r["held"] for r in got) <= tiles.IN_BYTES + (1 << 20)


def test_the_query_finds_the_moved_place(spark, small):
    from tielace.plans.queries_structure import lattice, refined_matches

    at = {(r["image"], r["key"]): r for r in lattice(spark, small).collect()}
    got = refined_matches(spark, small).collect()
    assert len(got) == len(at)
    good = [r for r in got if r["reason"] is None and abs(r["x"] - at[r["image"], r["key"]]["xs"] + 2) < 0.05 and abs(r["y"] - at[r["image"], r["key"]]["ys"] - 1) < 0.05]
    assert len(good) >= 0.9 * len(got)


def test_paraboloids_as_joins_are_those_of_the_patches(spark):
    a = terrain(20)
    peaks = spark.createDataFrame([(1, r, c) for r in range(20) for c in range(20)], "image int, r int, c int")
    got = {(r["r"], r["c"]): r for r in refine.paraboloids(imaged(spark, a), peaks).collect()}
    assert sorted(got) == [(r, c) for r in range(1, 19) for c in range(1, 19)]
    for (r, c), row in got.items():
        dx, dy, cov = refine.paraboloid(a[r - 1 : r + 2, c - 1 : c + 2])
        assert (row["dx"], row["dy"]) == pytest.approx((dx, dy), abs=1e-7)
        assert np.isnan(cov[0]) == (row["var_x"] is None) and (np.isnan(cov[0]) or np.allclose(cov, [row["var_x"], row["var_y"], row["cov_xy"]], rtol=1e-4, atol=1e-9))


def test_a_turned_copy_is_matched(spark):
    """Directions turned by some steps, as a turned image has them: the best of six shifts is the same point."""
    rng = np.random.default_rng(2)
    index = rng.integers(0, 6, (80, 80))
    index = np.repeat(np.repeat(index[::4, ::4], 4, 0), 4, 1)
    rows = [(1, k, 30.0 + 5 * (k % 5), 30.0 + 5 * (k // 5)) for k in range(25)] + [(1, 99, 5.0, 40.0), (7, 98, 40.0, 40.0)]
    points = spark.createDataFrame(rows, "image int, key int, x double, y double")
    make = lambda a: structure.index_descriptors(imaged(spark, a), points, 48, tile=32).withColumnRenamed("image", "pair")
    own, other = make(index), make((index + 4) % 6)
    sizes = {r["key"]: r["n"] for r in own.select("key", F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v).alias("n")).collect()}
    assert all(sizes[k] == pytest.approx(1) for k in range(25)) and sizes[98] == sizes[99] == 0
    for block in (7, 2048):
        got = descriptors.pair_matches(own.filter("key < 25"), other.filter("key < 25"), 0.85, 6, block).collect()
        assert sorted((r["src"], r["ref"]) for r in got) == [(k, k) for k in range(25)] and all(r["cosine"] == pytest.approx(1) for r in got)
    assert len(descriptors.pair_matches(own.filter("key < 25"), other.filter("key < 25"), 0.85, 1).collect()) < 25
    assert [r["ref"] for r in descriptors.pair_matches(own.filter("key < 5"), other.filter("key = 3"), 0.85, 6).collect()] == [3] * 5
    assert descriptors.pair_matches(own.limit(0), other, 0.85, 6).count() == 0


def test_empty_cells_are_reseeded_in_passes(spark):
    """A 4 x 4 lattice: cells without a candidate, with a weak one and with good ones; the search stays near where the transform leads."""
    a = terrain(160)
    other = a.copy()
    rng = np.random.default_rng(0)
    other[80:120, 80:120] = a[80:120, 80:120] * 0.35 + rng.standard_normal((40, 40))  # hardly alike
    reference = np.roll(other, (2, 3), (0, 1))
    points = spark.createDataFrame([(1, 5.0, 5.0), (1, 150.0, 150.0)], "image int, x double, y double")
    shapes = spark.createDataFrame([(1, 160, 160)], "image int, rows int, cols int")
    at = [(1, 10 * i + j, 20.0 + 40 * j, 20.0 + 40 * i + d, 1.0 - d) for i in range(4) for j in range(4) for d in (0.0, 0.25) if (i, j) not in ((0, 0), (1, 1))]
    at = [(im, k * 2 + (s < 1), x, y, s) for im, k, x, y, s in at] + [(1, 999, 300.0, 20.0, 9.0)]
    candidates = spark.createDataFrame(at, "image int, key int, x double, y double, strength double")
    h = spark.createDataFrame([(1, [1.0, 0.0, 4.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0])], "image int, h array<double>")
    both = imaged(spark, a), imaged(spark, reference)
    assert {r["cell"] for r in reseed.empty_cells(points, shapes, 4, 4).collect()} == set(range(1, 15))
    # Patches of 24 and a window of 4 leave the image around the outermost cells' candidates only beyond 16 pixels: all searches fit.
    got = {r["cell"]: r for r in reseed.reseed(points, candidates, h, *both, shapes, 4, 4, patch=24, window=4, tile=64).collect()}
    assert set(got) >= set(range(1, 15)) - {5, 10} and 5 not in got and 0 not in got and 15 not in got
    for cell, r in got.items():
        if cell != 10:
            assert (r["x"], r["y"]) == pytest.approx((r["xs"] + 3, r["ys"] + 2), abs=0.2) and r["pass"] == 1 and r["conf"] > 0.9
    assert 10 not in got or got[10]["conf"] < 0.6
    few = reseed.reseed(points, candidates, h, *both, shapes, 4, 4, valid=spark.createDataFrame([(1, 1), (1, 5), (1, 0)], "image int, cell int"), patch=24, window=4, tile=64)
    assert [r["cell"] for r in few.collect()] == [1]
    told = reseed.report(points, few, shapes, 4, 4).collect()[0]
    assert (told["passes"], told["cells_targeted"], told["cells_filled"]) == (2, 14 + 13, 1) and told["coverage_after"] == pytest.approx(3 / 16)
    assert reseed.reseed(points, candidates.limit(0), h, *both, shapes, 4, 4).count() == 0
    edges = spark.range(1).select(*[c.alias(k) for k, c in reseed.bounds(F.lit(6), F.lit(100), F.lit(60), 5, 4).items()]).first().asDict()
    assert edges == {"r0": 20, "c0": 30, "r1": 40, "c1": 45}


def test_local_normalisation_by_tiles(spark):
    a = terrain(60)[:50, :45]
    wide = np.pad(a, 4, mode="symmetric")
    boxes = np.lib.stride_tricks.sliding_window_view(wide, (9, 9)).reshape(50, 45, -1)
    want = (a - boxes.mean(axis=2)) / boxes.std(axis=2)
    for tile in (16, 24, 256):
        got = np.full(a.shape, np.nan)
        for r in structure.local_normalise(imaged(spark, a), 9, tile).collect():
            got[r["r"], r["c"]] = r["z"]
        assert np.allclose(got, want, atol=1e-6)
    assert structure.local_normalise(imaged(spark, np.ones((5, 5))), 9, 16).filter("abs(z) > 1e-9").count() == 0


def test_ratio_matches_in_chunks_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 8)).round(2)
    v[40:50] = v[:10]  # equal vectors: ties to the smaller vec_id
    rows = [(k, k % 3, [float(x) for x in a]) for k, a in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = {}
    for chunk in (7, 512):
        monkeypatch.setattr(descriptors, "CHUNK", chunk)
        found[chunk] = sorted(map(tuple, descriptors.ratio_matches(d.filter("vec_id % 2 = 0"), d.filter("vec_id % 2 = 1"), 0.9).collect()))
    assert found[7] == found[512]
    e = np.array([[np.float32(x) for x in r[2]] for r in rows], float)
    want = []
    for s in range(0, 60, 2):
        order = sorted((-round(float(e[s] @ e[r]), 12), r) for r in range(1, 60, 2))
        if 1 + order[0][0] < 0.9 * max(1 + order[1][0], 1e-9):
            want.append((s, order[0][1]))
    assert [r[:2] for r in found[7]] == want
