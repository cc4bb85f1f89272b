"""Running coverage against the batch query, with late points, over several batches and a restart."""

from datetime import datetime, timedelta

import pytest

from tielace.operators import uniform
from tielace.plans.views import points
from tielace.streaming import coverage


def run(spark, path, out, name):
    schema = "key string, x double, y double, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    seen = []
    query = coverage.running_coverage(stream, 512.0, 8).writeStream.outputMode("update").option("checkpointLocation", f"{path}/{out}").foreachBatch(lambda d, i: seen.append({r["key"]: r for r in d.collect()})).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return seen


def test_a_stream_gives_what_the_batch_gives(spark, small, tmp_path):
    own = points(spark, small).selectExpr("track key", "x", "y", "timestamp'2024-01-01 00:00:00' ts").repartition(3)
    own.write.parquet(f"{tmp_path}/in")
    seen = run(spark, tmp_path, "c", "whole")
    last = {}
    for batch in seen:
        last |= batch
    want = {r["track"]: r for r in uniform.uniformity(uniform.occupancy(points(spark, small), 512.0, 8, "track"), "track").collect()}
    assert {k: (r["n_points"], r["n_cells"]) for k, r in last.items()} == {k: (r["n_points"], round(r["coverage"] * 64)) for k, r in want.items()}
    assert all(r["late"] == 0 and r["coverage"] == pytest.approx(want[k]["coverage"]) for k, r in last.items()) and len(seen) == 3


def test_late_points_are_counted_and_state_outlives_a_restart(spark, tmp_path):
    noon = datetime(2024, 1, 1, 12)
    batches = [
        [("a", 10.0, 10.0, noon), ("a", 500.0, 10.0, noon - timedelta(days=2)), ("b", 10.0, 10.0, noon)],
        [("a", 100.0, 300.0, noon - timedelta(minutes=50)), ("a", 300.0, 300.0, noon - timedelta(hours=2)), ("b", None, 1.0, noon), ("b", 9e9, -5.0, noon)],
        [("a", 11.0, 11.0, noon + timedelta(hours=3)), (None, 1.0, 1.0, noon)],
    ]
    seen = []
    for k, rows in enumerate(batches):  # each run is a restart from the checkpoint
        spark.createDataFrame(rows, "key string, x double, y double, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen += run(spark, tmp_path, "c", f"part{k}")
    told = [{k: (r["n_points"], r["n_cells"], r["late"]) for k, r in batch.items()} for batch in seen]
    assert told == [{"a": (2, 2, 0), "b": (1, 1, 0)}, {"a": (3, 3, 1), "b": (2, 2, 1)}, {"a": (4, 3, 1), None: (1, 1, 0)}]
