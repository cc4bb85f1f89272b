"""Tiles, matching, local models, sources, sinks and streams on small made-up inputs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tielace.operators import localmodel, raster, resample, tiles
from tielace.plans import sinks
from tielace.sources import labels, rasters, windows
from tielace.streaming import stages


def terrain(n, seed=4):
    rng = np.random.default_rng(seed)
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(n), np.fft.fftfreq(n)))
    f[0, 0] = 1
    a = np.fft.ifft2(np.fft.fft2(rng.standard_normal((n, n))) / f**1.2).real
    return (a - a.mean()) / a.std()


def pixels(spark, a):
    r, c = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"r": r.ravel(), "c": c.ravel(), "v": a.ravel()})).selectExpr("cast(r as int) r", "cast(c as int) c", "v")


def test_tiles_have_their_borders(spark):
    got = tiles.with_borders(pixels(spark, np.zeros((8, 8))), 4, 1).groupBy("tile_row", "tile_col").count().collect()
    assert sorted(r["count"] for r in got if r["tile_row"] < 2 and r["tile_col"] < 2) == [25, 25, 25, 25]


def test_a_shift_is_found_again_whatever_the_light(spark):
    a = terrain(112)
    source, reference = a[20:84, 20:84], a[17:81, 22:86] * 0.7 + 0.1  # reference(r + 3, c - 2) shows source(r, c)
    both = pixels(spark, source).withColumn("image", F.lit(1)), pixels(spark, reference).withColumn("image", F.lit(1))
    got = raster.best_shift(*both, 32, 4).collect()
    assert len(got) == 4 and all((r["dr"], r["dc"]) == (3, -2) and r["ncc"] > 0.999 and r["ratio"] > 1 for r in got)
    assert raster.best_shift(both[0].limit(0), both[1], 32, 4).count() == 0


def test_orientation_of_an_edge_survives_a_change_of_light(spark):
    a = np.zeros((16, 16))
    a[:, 8:] = 1.0
    for light in (1.0, 0.25):
        got = raster.orientation_energy(pixels(spark, a * light).withColumn("image", F.lit(1))).collect()
        edge = [r for r in got if r["c"] == 8]
        assert all(r["strongest"] == 0 and r["energy"] == pytest.approx([0.8165, 0.4082, 0.0, 0.4082], abs=1e-3) for r in edge)


def test_quadratic_field(spark):
    rng = np.random.default_rng(1)
    u, v = rng.uniform(-1, 1, (2, 500))
    f = pd.DataFrame({"g": "a", "u": u, "v": v, "dx": 0.5 + u - 0.3 * u * v, "dy": v * v})
    r = localmodel.quadratic(spark.createDataFrame(f), "g", 1e-9).first()
    assert r["cx"] == pytest.approx([0.5, 1, 0, 0, -0.3, 0], abs=1e-5) and r["cy"] == pytest.approx([0, 0, 0, 0, 0, 1], abs=1e-5)


def test_spline_choice(spark):
    rng = np.random.default_rng(1)
    u, v = rng.uniform(-1, 1, (2, 60))
    smooth = pd.DataFrame({"g": "a", "tid": range(60), "u": u, "v": v, "dx": np.sin(2 * u), "dy": u * v})
    noisy = smooth.assign(g="b", dx=rng.normal(0, 1, 60), dy=rng.normal(0, 1, 60))
    got = {r["g"]: r for r in localmodel.spline_choice(spark.createDataFrame(pd.concat([smooth, noisy])), "g").collect()}
    assert got["a"]["smoothing"] <= 0.01 and got["a"]["loocv"] < 0.1 and got["b"]["smoothing"] >= 1.0 and got["a"]["n"] == 60


def test_jitter_between_rows(spark):
    known = spark.createDataFrame([(0, 1, 0.0, 1.0), (10, 1, 1.0, 3.0)], "row long, n long, dx double, dy double")
    got = {r["row"]: (r["dx"], r["dy"]) for r in localmodel.jitter_at(spark.createDataFrame([(-5,), (0,), (4,), (99,)], "row long"), known).collect()}
    assert got == {-5: (0.0, 1.0), 0: (0.0, 1.0), 4: (pytest.approx(0.4), pytest.approx(1.8)), 99: (1.0, 3.0)}
    same = {r["row"]: (r["dx"], r["dy"]) for r in localmodel.jitter_at(spark.createDataFrame([(-5,), (0,), (4,), (99,)], "row long"), known, 3).collect()}
    assert same == got


@pytest.mark.parametrize("kind, bits, dtype", [(k, b, d) for k, b, d in rasters.SAMPLE_TYPES])
def test_sample_types(kind, bits, dtype):
    assert rasters.sample_type(kind.upper(), bits) == dtype


def test_sample_types_beyond_the_table():
    assert [rasters.sample_type(*k) for k in (("SUN_REAL", 32), ("MSB_UNSIGNED_INTEGER", 64), ("VAX_INTEGER", 64), ("msb_real", 16))] == ["<f4", ">u8", "<i8", ">f4"]
    for kind, bits in (("CHARACTER", 8), ("MSB_BIT_STRING", 16), ("MSB_INTEGER", 12), ("real_integer_x", 32)):
        with pytest.raises(ValueError, match="can't be read"):
            rasters.sample_type(kind, bits)
    assert [rasters.pds4_type(k) for k in ("IEEE754MSBSingle", "IEEE754LSBDouble", "UnsignedMSB2", "SignedByte", "UnsignedByte", "SignedLSB4")] == [">f4", "<f8", ">u2", "<i1", "<u1", "<i4"]


def values(spark, path):
    return {(r["product"], r["plane"], r["band"], r["r"], r["c"]): r["v"] for r in rasters.read_pixels(spark, str(path)).collect()}


def test_detached_labels(spark, tmp_path):
    a = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    (tmp_path / "p1.img").write_bytes(a.tobytes())
    (tmp_path / "p1.lbl").write_text('^IMAGE = "P1.IMG"\nLINES = 3\nLINE_SAMPLES = 4\nBANDS = 2\nSAMPLE_TYPE = MSB_INTEGER\nSAMPLE_BITS = 16 <bits>\nEND\nLINES = 99\n')
    got = values(spark, tmp_path)
    assert len(got) == 24 and got["p1", "image", 1, 2, 3] == 23.0
    assert values(spark, tmp_path / "p1.img") == got  # the label beside it
    (tmp_path / "p1.lbl").write_text("LINES = 3\nEND\n")
    with pytest.raises(Exception, match="LINE_SAMPLES"):
        rasters.read_pixels(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="unsupported extension"):
        rasters.read_pixels(spark, str(tmp_path / "p1.xyz"))


def test_attached_labels_and_record_pointers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "BLOCK_ROWS", 2)
    a = np.arange(15, dtype="<u2").reshape(5, 3)
    head = "LINES = 5\r\nLINE_SAMPLES = 3\r\nSAMPLE_TYPE = LSB_UNSIGNED_INTEGER\r\nSAMPLE_BITS = 16\r\n"
    (tmp_path / "after.img").write_bytes((head + "END\r\n").encode() + a.tobytes())
    (tmp_path / "record.img").write_bytes((head + "RECORD_BYTES = 256\r\n^IMAGE = 2\r\nEND\r\n").encode().ljust(256) + a.tobytes())
    (tmp_path / "other.lbl").write_text(head + 'RECORD_BYTES = 6\r\n^IMAGE = ("Samples.DAT", 3)\r\nEND\r\n')
    (tmp_path / "samples.dat").write_bytes(b"\0" * 12 + a.tobytes())
    got = values(spark, tmp_path)
    for name in ("after", "record", "other"):
        assert [got[name, "image", 0, r, c] for r in range(5) for c in range(3)] == list(range(15))
    (tmp_path / "samples.dat").unlink()
    with pytest.raises(Exception, match="no raster"):
        rasters.read_pixels(spark, str(tmp_path / "other.lbl")).collect()


def test_xml_labels_with_planes(spark, tmp_path):
    cube, plane = np.arange(24, dtype=">f4").reshape(2, 3, 4), np.arange(12, dtype="<i2").reshape(3, 4)
    (tmp_path / "cube.dat").write_bytes(cube.tobytes() + plane.tobytes())
    axis = lambda n, k: f"<p:Axis_Array><p:elements>{n}</p:elements><p:sequence_number>{k}</p:sequence_number></p:Axis_Array>"
    array = lambda tag, name, at, kind, axes: f"<p:{tag}><p:name>{name}</p:name><p:offset unit='byte'>{at}</p:offset><p:Element_Array><p:data_type>{kind}</p:data_type></p:Element_Array>{axes}</p:{tag}>"
    image = array("Array_3D_Spectrum", "radiance", 0, "IEEE754MSBSingle", axis(2, 1) + axis(3, 2) + axis(4, 3))
    side = array("Array_2D", "Incidence angle", 96, "SignedLSB2", axis(3, 1) + axis(4, 2))
    (tmp_path / "cube.xml").write_text(f"<p:Product xmlns:p='http://x/y'><p:title>IIRS</p:title><p:File_Area><p:File><p:file_name>cube.dat</p:file_name></p:File>{side}{image}</p:File_Area></p:Product>")
    got = values(spark, tmp_path)
    assert len(got) == 36 and got["cube", "image", 1, 2, 3] == 23.0 and got["cube", "incidence", 0, 2, 3] == 11.0


def test_sensors_cameras_and_bands(spark):
    words = spark.createDataFrame([("Chandrayaan OHRC",), ("tmc2 aft view",), ("TMC",), ("imaging infrared spectrometer",), ("x",)], "t string")
    assert [r[0] for r in words.select(rasters.sensor_of(F.col("t"))).collect()] == ["OHRC", "TMC2_AFT", "TMC2_NADIR", "IIRS", "SYNTHETIC"]
    names = spark.createDataFrame([("LROC NACR", "a"), (None, "M1LE"), ("WAC", None), (None, None)], "i string, p string")
    assert [r[0] for r in names.select(rasters.camera_of(F.col("i"), F.col("p"))).collect()] == ["NAC_R", "NAC_L", "WAC", "NAC_L"]
    bands = spark.createDataFrame([([1.0, 2.0], 2), ([1.0], 43), (None, 3)], "w array<double>, n int")
    assert [r[0] and (r[0][0], r[0][-1], len(r[0])) for r in bands.select(rasters.wavelengths(F.col("w"), F.col("n"))).collect()] == [(1.0, 2.0, 2), (800.0, 5000.0, 43), None]


def test_label_numbers_and_times(spark):
    texts = [("12.3 <deg>", "2009-07-01T12:00:00Z"), ("az -1.5e2", "2009-182T00:00:00"), ("none", "July")]
    got = spark.createDataFrame(texts, "n string, t string").select(labels.number_in(F.col("n")).alias("n"), labels.parsed_time(F.col("t")).cast("string").alias("t")).collect()
    assert [r["n"] for r in got] == [12.3, -150.0, None]
    assert [r["t"] for r in got] == ["2009-07-01 12:00:00", "2009-07-01 00:00:00", None]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, 1.23456, float("nan"), True, 20.5, -3.25), (2, 2.0, 0.5, False, None, None)], "id long, src_line double, sigma_x double, inlier boolean, src_lon double, src_lat double")
    sinks.write_tiepoints(p, str(tmp_path / "t"))
    back = spark.read.option("header", True).csv(str(tmp_path / "t")).orderBy("id").collect()
    assert back[0].asDict()["src_line"] == "1.2346" and back[0]["sigma_x"] is None and back[0]["inlier"] == "1" and len(back[0]) == 19
    one, two = (json.loads(r["value"]) for r in sinks.features(p).collect())
    assert one["geometry"]["coordinates"] == [20.5, -3.25] and two["properties"]["coordinates_in"] == "pixel"


def test_streams(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    for name, frame in (("w", stages.tumbling(stream)), ("s", stages.sessions(stream)), ("o", stages.once(stream))):
        mode = "append" if name == "o" else "complete"
        q = frame.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    n = spark.read.parquet(f"{small}/events.parquet").count()
    assert spark.table("t_w").agg(F.sum("n")).first()[0] == n
    assert spark.table("t_s").agg(F.sum("n")).first()[0] == n
    assert spark.table("t_o").count() == n


def grid_values(found, rows, cols, column="v"):
    out = np.full((rows, cols), np.nan)
    for r in found.collect():
        out[r["r"], r["c"]] = np.nan if r[column] is None else r[column]
    return out


def imaged(spark, a, image=1):
    return pixels(spark, a).withColumn("image", F.lit(image))


@pytest.mark.parametrize("kernel", ["nearest", "linear", "cubic", "lanczos"])
def test_kernels_add_up_and_keep_pixels(kernel):
    t = np.linspace(0, 0.999, 50)
    assert np.allclose(resample.weights(kernel, t).sum(-1), 1)
    a = terrain(24)
    rows, cols = np.mgrid[4:20, 4:20].astype(float)
    assert np.allclose(resample.sampled(a, cols, rows, kernel, None), a[4:20, 4:20])
    moved = resample.sampled(a, cols + 0.4, rows, kernel, None)
    want = [sum(w * a[r, int(first) + k] for k, w in enumerate(resample.weights(kernel, np.array([0.4]))[0])) for r in range(4, 20) for first in resample.first_taps(kernel, np.arange(4, 20) + 0.4)]
    assert np.allclose(moved.ravel(), want)


def test_a_warp_across_tiles_and_images(spark):
    """Tiles of 16: rotation and scale from many source tiles; holes and what lies beyond the source; an image without pixels."""
    a = terrain(50)
    a[20, 20] = np.nan
    turn = np.array([[0.9, -0.4, 12.0], [0.35, 0.95, -3.0], [0.001, 0.0, 1.0]])
    both = imaged(spark, a).union(imaged(spark, a[:30, :20] * 2, 2))
    targets = spark.createDataFrame([(1, 60, 45, turn.ravel().tolist()), (2, 10, 12, np.eye(3).ravel().tolist()), (3, 5, 5, np.eye(3).ravel().tolist())], "image int, rows int, cols int, h array<double>")
    for border in (None, 0.0):
        found = resample.warp(both, targets, "cubic", border, tile=16).cache()
        cols, rows = np.meshgrid(np.arange(45.0), np.arange(60.0))
        xs, ys = resample.applied(np.linalg.inv(turn), cols, rows)
        want = resample.sampled(a, xs, ys, "cubic", border)
        got = grid_values(found.filter("image = 1"), 60, 45)
        assert np.allclose(got, want, equal_nan=True) and np.isnan(got).any() == (border is None)
        inside = grid_values(found.filter("image = 1"), 60, 45, "covered").astype(bool)
        assert (inside == ((xs >= 0) & (ys >= 0) & (xs < 50) & (ys < 50))).all() and 0.2 < inside.mean() < 1
        assert np.allclose(grid_values(found.filter("image = 2"), 10, 12)[2:, 2:], a[2:10, 2:12] * 2)
        assert found.filter("image = 3").count() == 0
    assert resample.warp(both.limit(0), targets, tile=16).count() == 0


def test_nodes_say_what_the_homography_does(spark):
    a = terrain(40)
    targets = spark.createDataFrame([(1, 40, 40)], "image int, rows int, cols int")
    nodes = resample.nodes_of(targets, 8, F.col("gx") * 0.9 + 1.5, F.col("gy") + F.col("gx") * 0.05)
    got = grid_values(resample.warp_by_nodes(imaged(spark, a), targets, nodes, "linear", None, tile=16, step=8), 40, 40)
    cols, rows = np.meshgrid(np.arange(40.0), np.arange(40.0))
    assert np.allclose(got, resample.sampled(a, cols * 0.9 + 1.5, rows + cols * 0.05, "linear", None), equal_nan=True)
    with pytest.raises(ValueError):
        resample.node_maps(targets, nodes, 20, 8)


def test_orthorectified_halves_what_is_far_too_fine(spark):
    """A step of ten source pixels: two halvings (as rows of means), then cubic weights; without heights nothing leans."""
    a = terrain(96)
    h = [10.0, 0.0, 0.0, 0.0, -10.0, 90.0, 0.0, 0.0, 1.0]
    grids = spark.createDataFrame([(1, 9, 9, 0.0, 9.0, 1.0, h, 20.0, 0.0)], "image int, rows int, cols int, x0 double, y1 double, gsd double, h array<double>, emission double, azimuth double")
    got = grid_values(resample.orthorectify(imaged(spark, a), grids, tile=16), 9, 9)
    small = a.reshape(24, 4, 24, 4).mean(axis=(1, 3))
    cols, rows = np.meshgrid(np.arange(9.0), np.arange(9.0))
    want = resample.sampled(small, ((cols + 0.5) * 10 + 0.5) / 4 - 0.5, ((rows + 0.5) * 10 + 0.5) / 4 - 0.5, "cubic", None)
    assert np.allclose(got, want, equal_nan=True) and np.isfinite(got[1:-1, 1:-1]).all()
    flat = imaged(spark, np.full((5, 4), 7.0))
    assert np.allclose(grid_values(resample.orthorectify(imaged(spark, a), grids, flat, tile=16), 9, 9), want, equal_nan=True)


def test_windows_are_pushed_into_the_source(spark, tmp_path, monkeypatch):
    """The rows of read_pixels under a filter, from the byte ranges of the window alone."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1000, (3, 40, 64)).astype(">i2"), rng.integers(0, 9, (20, 8, 5)).astype("<f4")
    (tmp_path / "one.img").write_bytes(a.tobytes())
    (tmp_path / "one.lbl").write_text('^IMAGE = "ONE.IMG"\nLINES = 40\nLINE_SAMPLES = 64\nBANDS = 3\nSAMPLE_TYPE = MSB_INTEGER\nSAMPLE_BITS = 16\nEND\n')
    axis = lambda n, k: f"<Axis_Array><elements>{n}</elements><sequence_number>{k}</sequence_number></Axis_Array>"
    (tmp_path / "two.dat").write_bytes(b.tobytes())
    (tmp_path / "two.xml").write_text(f"<P><File_Area><File><file_name>two.dat</file_name></File><Array_3D_Image><name>cube</name><offset>0</offset><Element_Array><data_type>IEEE754LSBSingle</data_type></Element_Array>{axis(20, 1)}{axis(8, 2)}{axis(5, 3)}</Array_3D_Image></File_Area></P>")
    spark.dataSource.register(windows.RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source, whole = spark.read.format("raster").load(str(tmp_path)), rasters.read_pixels(spark, str(tmp_path))
    for where in ("true", "r >= 5 AND r < 9 AND c = 3", "band = 1 AND product = 'one' AND c BETWEEN 10 AND 20", "product IN ('two') AND band > 2 AND r <= 1", "r > 39", "v > 500 AND r % 7 = 3", "plane = 'incidence'"):
        assert sorted(map(tuple, source.filter(where).collect())) == sorted(map(tuple, whole.filter(where).collect()))
    assert spark.read.format("raster").load(str(tmp_path / "two.xml")).count() == 800
    # Its reads, counted without Spark.
    reads = []
    plain = rasters.read_range
    monkeypatch.setattr(rasters, "read_range", lambda path, offset, size: reads.append((offset, size)) or plain(path, offset, size))
    reader = windows.RasterReader(str(tmp_path))
    left = list(reader.pushFilters([windows.GreaterThanOrEqual(("r",), 10), windows.LessThan(("r",), 12), windows.LessThanOrEqual(("c",), 3), windows.EqualTo(("band",), 2), windows.EqualTo(("product",), "one"), windows.GreaterThan(("v",), 1.0)]))
    assert [type(f) for f in left] == [windows.GreaterThan]
    blocks = reader.partitions()
    reads.clear()
    got = pd.concat([x.to_pandas() for blk in blocks for x in reader.read(blk)])
    assert got["v"].tolist() == a[2, 10:12, :4].ravel().tolist() and set(zip(got["r"], got["c"], strict=True)) == {(r, c) for r in (10, 11) for c in range(4)}
    assert reads == [(2 * (2 * 40 * 64 + r * 64), 8) for r in (10, 11)]
    reader = windows.RasterReader(str(tmp_path))
    assert not list(reader.pushFilters([windows.LessThan(("r",), 4), windows.EqualTo(("product",), "one"), windows.EqualTo(("band",), 0)]))
    blocks = reader.partitions()
    reads.clear()
    assert sum(x.num_rows for blk in blocks for x in reader.read(blk)) == 4 * 64 and reads[-1] == (0, 4 * 128) and len(blocks) == 1
    (tmp_path / "one.img").unlink()
    with pytest.raises(Exception, match="no raster"):
        spark.read.format("raster").load(str(tmp_path / "one.lbl")).collect()


def test_tiles_reach_python_as_numbers_in_small_batches(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    a = terrain(40)
    (row,) = [r for r in tiles.cut(imaged(spark, a), 32, 4).collect() if (r["tile_row"], r["tile_col"]) == (1, 0)]
    assert np.array_equal(np.array(row["v"]).reshape(40, 40)[:12, 4:40], a[28:40, :36])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= tiles.IN_BYTES
    places = tiles.plain(pa.array([[1, 2], None, [3]], pa.list_(pa.int32())))
    assert isinstance(places[0], np.ndarray) and places[1] is None
    # What is made of a row counts whole, arrays in structs included, so that a batch ends in time.
    assert tiles._bytes([{"key": 1, "template": np.zeros(1000)}] * 3) > 24_000


def test_maps_are_made_by_many_tasks_and_once(spark):
    targets = spark.createDataFrame([(k, 200, 200, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for k in range(20)], "image long, rows int, cols int, h array<double>")
    assert resample.output_tiles(targets, 64).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = resample.to_pixels(resample.homography_maps(targets, 64), 64, "xs")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.count() == 20 * 200 * 200


def test_a_warp_runs_few_python_steps(spark):
    """Each step has a worker of its own in every task; what lies in the source is said where the map is made, not in a step after it."""
    a = terrain(40)
    targets = spark.createDataFrame([(1, 40, 40, np.eye(3).ravel().tolist())], "image int, rows int, cols int, h array<double>")
    nodes = resample.nodes_of(targets.drop("h"), 8, F.col("gx"), F.col("gy"))
    for found in (resample.warp(imaged(spark, a), targets, "linear", tile=16), resample.warp_by_nodes(imaged(spark, a), targets.drop("h"), nodes, "linear", tile=16, step=8)):
        # The maps twice (what they ask for, what they weigh), that, the source's tiles, and the weighing.
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5
        assert found.filter("covered").count() == 1600


def test_splines_are_the_least_squares_solutions():
    """Distinct places, some twice, on a line, and all at one place: each against its whole system."""
    rng = np.random.default_rng(3)
    xy = rng.uniform(-0.1, 0.1, (40, 24, 2))
    xy[10:20, 12:] = xy[10:20, :12]
    xy[20:30, :, 0] = np.linspace(-0.1, 0.1, 24)  # apart from each other: the whole system is solved to few digits where they are not
    xy[20:30, :, 1] = 2 * xy[20:30, :, 0]
    xy[30:] = xy[30:, :1]
    values, at, smoothings = rng.standard_normal((40, 24, 2)), rng.uniform(-0.1, 0.1, (40, 2)), (0.0, 0.01, 1.0)
    at[30:] = xy[30:, 0]
    got = localmodel.splines(xy, values, at, smoothings)

    def kernel(a, b):
        r2 = ((a[:, None] - b[None]) ** 2).sum(-1)
        return np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0)

    for m in range(40):
        for s, smoothing in enumerate(smoothings):
            p = np.c_[np.ones(24), xy[m]]
            system = np.block([[kernel(xy[m], xy[m]) + smoothing * np.eye(24), p], [p.T, np.zeros((3, 3))]])
            w = np.linalg.lstsq(system, np.r_[values[m], np.zeros((3, 2))], rcond=None)[0]
            want = kernel(at[m : m + 1], xy[m]) @ w[:24] + np.r_[1, at[m]] @ w[24:]
            assert np.allclose(got[m, s], want[0], rtol=1e-7, atol=1e-8), (m, s)


def test_what_is_made_of_neighbours_is_that_of_all_pairs(spark, monkeypatch):
    """Across tiles, in whichever task it is made; only the rows at borders go through a second one."""
    import pyarrow as pa

    from tielace.operators import nearest

    monkeypatch.setattr(nearest, "TILE", 64)
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 10, (700, 2)).round(1)
    points = spark.createDataFrame([(k, "a" if k < 600 else "b", float(x), float(y)) for k, (x, y) in enumerate(xy)], "tid long, g string, x double, y double")

    def made(own, near, counts):
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), near.column("tid").combine_chunks().cast(pa.float64()))

    got = {r["tid"]: [int(v) for v in r["found"]] for r in nearest.nearest(points, points, 6, keys=("g",), made=made).collect()}
    assert len(got) == 700
    for k in range(700):
        others = [j for j in range(*((0, 600) if k < 600 else (600, 700))) if j != k]
        assert got[k] == sorted(others, key=lambda j: (np.hypot(*(xy[j] - xy[k])), j))[:6]
