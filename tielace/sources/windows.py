"""A Spark data source of rasters: spark.read.format("raster").load(folder), with windows of rows, columns and bands pushed into its reads.

    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("raster").load(folder).filter("r >= 1000 AND r < 1512 AND c BETWEEN 0 AND 511 AND band = 0")

The driver lists the folder and reads the labels' first bytes, as it lists the files of other sources; samples are read by tasks, each a
range of rows of one band. For a folder of very many products rasters.read_pixels reads the labels in tasks as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import rasters

SCHEMA = "product string, plane string, band int, r int, c int, v double"
FIELDS = pa.schema([("product", pa.string()), ("plane", pa.string()), ("band", pa.int32()), ("r", pa.int32()), ("c", pa.int32()), ("v", pa.float64())])
#: Lines are read whole unless the wanted columns are less than this share of them; then each line's part is read alone.
NARROW = 0.25
RANGED, NAMED = ("r", "c", "band"), ("product", "plane")


@dataclass
class Block(InputPartition):
    """Rows of one layer of a raster: where its samples are and which of them are wanted."""

    product: str
    plane: str
    path: str
    offset: int
    dtype: str
    layer: int
    deep: int  # samples of a pixel that lie together
    lines: int
    samples: int
    rows: tuple[int, int]
    cols: tuple[int, int]
    bands: tuple[int, int]


class RasterSource(DataSource):
    """Pixels of the products of a folder, or of one label's product (option path)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"])


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.low, self.high = dict.fromkeys(RANGED, 0), dict.fromkeys(RANGED, 2**31 - 1)
        self.names: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Take comparisons of r, c and band with numbers, and the names of products and planes; give back all others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in NAMED and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names[column] = self.names.get(column, wanted) & wanted
            elif column in RANGED and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[column] = max(self.low[column], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[column] = min(self.high[column], f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def planned(self) -> Iterator[tuple]:
        """The plan of each raster (as rasters.PLAN says) with the path of its samples."""
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", self.path))
        one = system.get_file_info(inside).type == fs.FileType.File
        folder = inside.rsplit("/", 1)[0] if one else inside
        base = self.path.rsplit("/", 1)[0] if one else self.path.rstrip("/")
        files = {f.base_name: f"{base}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File}
        stem = lambda n: n.rsplit(".", 1)[0].lower()
        kind = lambda n: n.rsplit(".", 1)[-1].lower()
        detached = {stem(n) for n in files if kind(n) in rasters.READERS and kind(n) != "img"}
        labels = [n for n in sorted(files) if kind(n) in rasters.READERS and not (kind(n) == "img" and stem(n) in detached) and (not one or stem(n) == stem(inside.rsplit("/", 1)[-1]))]
        by_name = {n.lower(): p for n, p in files.items()}
        for label in labels:
            for row in rasters.READERS[kind(label)](label.rsplit(".", 1)[0], label, rasters.read_range(files[label], 0, rasters.LABEL_BYTES)):
                stemmed = min((p for n, p in files.items() if stem(n) == stem(label) and kind(n) in ("img", "dat", "qub")), default=None)
                data = by_name.get(row[3].lower(), stemmed)
                if data is None:
                    raise ValueError(f"{row[0]}: no raster {row[3]}")
                yield (*row, data)

    def partitions(self) -> list[Block]:
        found = []
        for product, plane, _, _, offset, dtype, bands, lines, samples, interleaved, data in self.planned():
            if product not in self.names.get("product", {product}) or plane not in self.names.get("plane", {plane}):
                continue
            window = {k: (max(0, self.low[k]), min(n, self.high[k])) for k, n in (("r", lines), ("c", samples), ("band", bands))}
            if any(a >= b for a, b in window.values()):
                continue
            layers = [(0, bands, window["band"])] if interleaved else [(k, 1, (k, k + 1)) for k in range(*window["band"])]
            for top in range(window["r"][0], window["r"][1], rasters.BLOCK_ROWS):
                rows = (top, min(top + rasters.BLOCK_ROWS, window["r"][1]))
                found += [Block(product, plane, data, offset, dtype, layer, deep, lines, samples, rows, window["c"], own) for layer, deep, own in layers]
        return found

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:  # what Spark asks for where nothing is planned
            return
        values = window_of(block)
        rows, cols = (np.arange(*x, dtype=np.int32) for x in (block.rows, block.cols))
        for band in range(*block.bands):
            own = values[:, :, band if block.deep > 1 else 0]
            n = own.size
            yield pa.RecordBatch.from_arrays([
                pa.array([block.product] * n), pa.array([block.plane] * n), pa.array(np.full(n, band, np.int32)),
                pa.array(np.repeat(rows, len(cols))), pa.array(np.tile(cols, len(rows))), pa.array(own.ravel().astype(np.float64)),
            ], schema=FIELDS)


def window_of(block: Block) -> np.ndarray:
    """The block's samples (rows, columns, deep), by one read of whole lines, or one of each line's part where little of the lines is wanted."""
    dtype = np.dtype(block.dtype)
    pixel = dtype.itemsize * block.deep
    line = block.samples * pixel
    start = block.offset + block.layer * block.lines * line
    high, wide = block.rows[1] - block.rows[0], block.cols[1] - block.cols[0]
    if wide < NARROW * block.samples:
        parts = [rasters.read_range(block.path, start + r * line + block.cols[0] * pixel, wide * pixel) for r in range(*block.rows)]
        raw, shape, cut = b"".join(parts), (high, wide, block.deep), slice(None)
    else:
        raw, shape, cut = rasters.read_range(block.path, start + block.rows[0] * line, high * line), (high, block.samples, block.deep), slice(*block.cols)
    if len(raw) < np.prod(shape) * dtype.itemsize:
        raise ValueError(f"{block.product}: the raster ends too early")
    return np.frombuffer(raw, dtype).reshape(shape)[:, cut]
