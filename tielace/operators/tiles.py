"""Tile tables: rasters as one row a tile, with borders, and NumPy on such rows.

A tile's pixels are an array of doubles by rows, NaN where there is none. A row is bounded by the side of a tile, so images of any
size are many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of an Arrow batch of rows on their way to Python, and of values on their way back, about.
IN_BYTES, OUT_BYTES = 4 << 20, 4 << 20


def with_borders(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """Pixels with tile_row, tile_col; a pixel within halo of other tiles is repeated for each of them."""
    span = lambda v: F.sequence(F.floor((v - halo) / tile), F.floor((v + halo) / tile))
    sent = pixels.withColumn("tile_row", F.explode(span(F.col("r")))).withColumn("tile_col", F.explode(span(F.col("c"))))
    return sent.filter("tile_row >= 0 AND tile_col >= 0")


def sizes(pixels: DataFrame) -> DataFrame:
    """image, rows, cols: up to the last pixel that is there."""
    return pixels.groupBy("image").agg((F.max("r") + 1).cast("int").alias("rows"), (F.max("c") + 1).cast("int").alias("cols"))


def cut(pixels: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """image, tile_row, tile_col (int), v: tiles with their borders, (tile + 2 halo)^2 values; one shuffle, by tile.

    Pixels (image, r, c from 0, v) that are missing or null are NaN; a tile that no pixel lies in or beside isn't there.
    """
    side = tile + 2 * halo
    place = (F.col("r") - F.col("tile_row") * tile + halo) * side + F.col("c") - F.col("tile_col") * tile + halo
    own = with_borders(pixels, tile, halo).select("image", F.col("tile_row").cast("int"), F.col("tile_col").cast("int"), place.cast("int").alias("p"), F.col("v").cast("double").alias("v"))
    # Only tiles of the image itself: a border reaches beyond the last one.
    own = own.filter("v IS NOT NULL OR " + _inside(side, halo)).groupBy("image", "tile_row", "tile_col").agg(F.collect_list(F.struct("p", "v")).alias("at"), F.max(F.expr(_inside(side, halo))).alias("own"))

    def dense(row: dict) -> list:
        out = np.full(side * side, np.nan)
        out[row["p"]] = row["x"]
        return [out]

    # Two arrays of numbers instead of one of structs: Python gets them without an object a pixel.
    flat = own.filter("own").select("image", "tile_row", "tile_col", F.col("at.p").alias("p"), F.col("at.v").alias("x"))
    return each(flat, dense, "v array<double>", drop=["p", "x"])


def _inside(side: int, halo: int) -> str:
    return f"(p DIV {side} BETWEEN {halo} AND {side - halo - 1} AND p % {side} BETWEEN {halo} AND {side - halo - 1})"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's size of Arrow batches to IN_BYTES: a row is a tile, and ten thousand of them are too many for a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > IN_BYTES:
        spark.conf.set(name, str(IN_BYTES))


def each(rows: DataFrame, f: Callable[[dict], list | None], added: str, drop: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows with what f makes of each of them (a list of values for the added columns, or None: no row), a task's rows one by one.

    A worker holds a batch of about IN_BYTES and what is made of it up to OUT_BYTES, or a single row, however many rows a task has.

    f gets a row as a dictionary; arrays of numbers come as NumPy arrays. drop or keep say which columns stay.
    """
    small_batches(rows.sparkSession)
    more = _parse_datatype_string(added)
    names = [c for c in rows.columns if (c in keep if keep is not None else c not in (drop or []))]
    schema = StructType([*(rows.schema[c] for c in names), *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            columns = {c: plain(batch.column(c)) for c in batch.schema.names}
            found, at, held = [], [], 0
            for i in range(batch.num_rows):
                made = f({c: v[i] for c, v in columns.items()})
                if made is not None:
                    found.append(made)
                    at.append(i)
                    held += sum(map(_bytes, made))
                if held > OUT_BYTES:
                    yield _batch(batch, names, at, found, target)
                    found, at, held = [], [], 0
            if found:
                yield _batch(batch, names, at, found, target)

    return rows.mapInArrow(run, schema)


def _bytes(value) -> int:
    """About the memory of a value: arrays, and lists and structs of them."""
    if isinstance(value, np.ndarray):
        return value.nbytes
    if isinstance(value, (list, dict)):
        return 64 + sum(map(_bytes, value.values() if isinstance(value, dict) else value))
    return 32


def _batch(batch: pa.RecordBatch, names: list[str], at: list[int], found: list[list], target: pa.Schema) -> pa.RecordBatch:
    kept = batch.take(pa.array(at, pa.int64()))
    arrays = [kept.column(c).cast(target.field(c).type) for c in names]
    for k, field in enumerate(list(target)[len(names) :]):
        arrays.append(pa.array([f[k] for f in found], field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def plain(column: pa.Array) -> list:
    """A column's values; arrays of numbers as NumPy arrays (null: NaN; integers with nulls: lists)."""
    whole = pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.values.null_count
    if whole or (pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type)):
        flat = column.values.to_numpy(zero_copy_only=False)
        ends = column.offsets.to_numpy()
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        return [None if n else flat[a:b] for n, a, b in zip(nulls, ends, ends[1:], strict=False)]
    if pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type):
        own = column.values
        parts = {own.type.field(i).name: plain(own.field(i)) for i in range(own.type.num_fields)}
        ends = column.offsets.to_numpy()
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        return [None if n else [{c: v[k] for c, v in parts.items()} for k in range(a, b)] for n, a, b in zip(nulls, ends, ends[1:], strict=False)]
    return column.to_pylist()


def pixels(tiled: DataFrame, tile: int, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """image, r, c and the columns (arrays of tile^2 values each), one row a pixel; further columns of the tile to keep as they are."""
    at = tiled.select("image", "tile_row", "tile_col", *keep, F.posexplode(F.arrays_zip(*columns)).alias("p", "x"))
    r, c = F.col("tile_row") * tile + F.floor(F.col("p") / tile), F.col("tile_col") * tile + F.col("p") % tile
    return at.select("image", r.cast("int").alias("r"), c.cast("int").alias("c"), *[F.col("x")[x].alias(x) for x in columns], *keep)
