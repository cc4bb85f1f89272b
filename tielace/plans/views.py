"""The given tables read as points, descriptors, rasters, pair results and labels, in Spark and in SQL.

A query is written twice over the same view: on its DataFrame, and as SQL below the view's common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extent of the point sets, in pixels.
SIDE = 512.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, track, x, y, sigma, conf from events."""
    day = 86_400_000_000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tid"),
        F.col("event_type").alias("track"),
        (F.col("value") / F.lit(500.0) * SIDE).alias("x"),
        (F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(day)) / F.lit(float(day)) * SIDE).alias("y"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("sigma"),
        (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)).alias("conf"),
    )


POINTS = """points AS (
  SELECT event_id AS tid, event_type AS track, value / 500.0::DOUBLE * 512.0::DOUBLE AS x,
    CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 86400000000.0::DOUBLE * 512.0::DOUBLE AS y,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0::DOUBLE AS sigma,
    CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS conf
  FROM events
)"""


#: Order numbers of one image.
IMAGE = 4096


def raster(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> DataFrame:
    """image, r, c, v: mean quantity by order number (its rows, 64 of them) and part number modulo 64, an image for each
    4096 order numbers, so that images grow in number with the table; cells without a row are missing."""
    place = [(F.floor(F.col("l_orderkey") / IMAGE)).alias("image"), (F.col("l_orderkey") % 64).cast("int").alias("r"), (F.col("l_partkey") % 64).cast("int").alias("c")]
    return table(spark, sf_dir, "lineitem").groupBy(*place).agg(F.avg(value).alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image: those of the raster, without its pixels."""
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / IMAGE).alias("image")).distinct()


def raster_sql(name: str = "raster", value: str = "l_quantity") -> str:
    return f"{name} AS (SELECT l_orderkey // {IMAGE} AS image, CAST(l_orderkey % 64 AS INTEGER) AS r, CAST(l_partkey % 64 AS INTEGER) AS c, avg({value}) AS v FROM lineitem GROUP BY 1, 2, 3)"


RASTER = raster_sql()


def pair_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, pair_id, ok, rmse, sweep from orders: a failed pair (status F) has no rmse."""
    ok = F.col("o_orderstatus") != "F"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("pair_id"), ok.alias("ok"), F.when(ok, F.col("o_totalprice") / F.lit(1000.0)).alias("rmse"), F.year("o_orderdate").alias("sweep"),
        F.when(~ok, F.concat(F.lit("failed at stage "), (F.col("o_custkey") % 7).cast("string"))).alias("error"),
    )


PAIRS = """pairs AS (
  SELECT o_orderpriority AS method, o_orderkey AS pair_id, o_orderstatus <> 'F' AS ok,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 1000.0::DOUBLE END AS rmse, CAST(year(o_orderdate) AS INTEGER) AS sweep,
    CASE WHEN o_orderstatus = 'F' THEN 'failed at stage ' || CAST(o_custkey % 7 AS VARCHAR) END AS error
  FROM orders
)"""
