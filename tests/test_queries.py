"""Every query against its SQL, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__
from tielace import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows(found):
    return sorted((tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, sql, small, name):
    want = sql.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, small)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def _tables(spark, folder, **rows):
    for name, (given, schema) in rows.items():
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for name in rows:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


def test_tiles_beyond_the_eighth_column_have_their_own_places(spark, tmp_path):
    from datetime import datetime

    # 25 points in row 0, column 8, and 25 in row 1, column 0: one number, two tiles.
    given = [(k, datetime(2024, 1, 1, 1 if k < 25 else 4), "view", 510.0 if k < 25 else 10.0, '{"k": 1}') for k in range(50)]
    con = _tables(spark, tmp_path, events=(given, "event_id long, ts timestamp_ntz, event_type string, value double, props string"))
    got = catalogue.QUERIES["tile_cap"](spark, str(tmp_path)).select("place", "tid", "tile")
    assert rows(got.collect()) == rows(con.sql(catalogue.ORACLE_SQL["tile_cap"]).select("place", "tid", "tile").fetchall())
    assert got.count() == 40


def test_a_place_on_the_edge_of_the_source_is_covered(spark, tmp_path):
    # In images 4, 16, 28 and 76 of every 84 row 40, column 0 comes from x = 0 exactly; a rounding error put it beside the source.
    given = [(image * 4096 + k, 7 * k, float(k % 50)) for image in (4, 16, 28, 40, 76, 88) for k in range(40)]
    con = _tables(spark, tmp_path, lineitem=(given, "l_orderkey long, l_partkey long, l_quantity double"))
    got = catalogue.QUERIES["warp_cubic"](spark, str(tmp_path)).select("image", "r", "c", "v", "covered")
    want = con.sql(catalogue.ORACLE_SQL["warp_cubic"]).select("image", "r", "c", "v", "covered").fetchall()
    assert len(want) == 6 * 72 * 80 and not {tuple(r) for r in got.collect()} ^ set(want)


def test_the_order_of_a_mean_decides_no_cell(spark, tmp_path):
    # Means of 0.03 to rounding, whatever the order of their terms: none is above it.
    taxes = ([0.01, 0.05], [0.0, 0.02, 0.07], [0.03, 0.03, 0.03], [0.08, 0.01, 0.0])
    given = [(r, c, 30.0, t) for r in range(4) for c, own in enumerate(taxes) for t in own]
    con = _tables(spark, tmp_path, lineitem=(given, "l_orderkey long, l_partkey long, l_quantity double, l_tax double"))
    got = catalogue.QUERIES["valid_cells"](spark, str(tmp_path)).select("cell", "image", "share", "valid")
    assert rows(got.collect()) == rows(con.sql(catalogue.ORACLE_SQL["valid_cells"]).select("cell", "image", "share", "valid").fetchall()) == [(0, 0, 0.0, False)]


def test_a_crowded_cell_of_footprints_is_joined_in_parts(spark, sql, small, monkeypatch):
    from tielace.plans import queries_raster

    monkeypatch.setattr(queries_raster, "CROWD", 7)
    want = sql.sql(catalogue.ORACLE_SQL["footprint_overlap"])
    got = catalogue.QUERIES["footprint_overlap"](spark, small)
    keys = got._jdf.queryExecution().optimizedPlan().toString()
    assert "o_part" in keys and rows(got.select(*sorted(want.columns)).collect()) == rows(want.select(*sorted(want.columns)).fetchall())
