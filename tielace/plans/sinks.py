"""Sinks: tie points as CSV and GeoJSON, documents as JSON with nulls for what isn't finite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the tie-point table, and the decimals they are written with.
TIEPOINT_COLUMNS = (
    ("id", None), ("src_line", 4), ("src_sample", 4), ("ref_line", 4), ("ref_sample", 4), ("src_lon", 6), ("src_lat", 6), ("ref_lon", 6), ("ref_lat", 6), ("conf", 4),
    ("track", None), ("sigma_x", 6), ("sigma_y", 6), ("sigma_xy", 8), ("residual_x", 4), ("residual_y", 4), ("inlier", 0), ("reseeded", 0), ("cell_id", None),
)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def tiepoint_rows(points: DataFrame) -> DataFrame:
    """All columns in order; numbers rounded, what isn't finite or known empty, flags 0 or 1."""
    made = []
    for name, digits in TIEPOINT_COLUMNS:
        x = F.col(name) if name in points.columns else F.lit(None).cast("double")
        if name in ("inlier", "reseeded"):
            x = x.cast("int")
        elif digits:
            x = F.round(finite(x.cast("double")), digits)
        made.append(x.alias(name))
    return points.select(*made)


def write_tiepoints(points: DataFrame, path: str) -> None:
    tiepoint_rows(points).write.mode("overwrite").option("header", True).csv(path)


def features(points: DataFrame) -> DataFrame:
    """value: a GeoJSON feature a line; map coordinates where they are known, else pixels, and which of them."""
    rows = tiepoint_rows(points)
    known = F.col("src_lon").isNotNull() & F.col("src_lat").isNotNull()
    place = F.when(known, F.array("src_lon", "src_lat")).otherwise(F.array("src_sample", "src_line"))
    geometry = F.struct(F.lit("Point").alias("type"), place.alias("coordinates"))
    properties = F.struct(*[F.col(c) for c, _ in TIEPOINT_COLUMNS], F.when(known, "map").otherwise("pixel").alias("coordinates_in"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))
