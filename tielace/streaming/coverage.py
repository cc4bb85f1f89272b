"""Running coverage of a lattice by a stream of points, with late points counted apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "cells binary, n long, late long, top timestamp"
OUT = "key string, n_points long, n_cells long, coverage double, late long"


def running_coverage(points: DataFrame, side: float, cells: int, late: str = "1 hour") -> DataFrame:
    """key, n_points, n_cells, coverage (share of cells x cells that hold a point), late of a stream of points (key, x, y, ts), in update mode.

    A key's state is a bit a cell, two counts and the latest time of the batches before: as large at the thousandth batch as at the first, however many
    points a key has. A point that is more than late behind that time is counted and not placed; points beyond the square count to its edge; those with
    a null place or time are late. Each batch gives a row for the keys it brought points of.
    """
    behind = pd.Timedelta(late)
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col(c) / side * cells)))
    cell = F.when(F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y"), None).otherwise((at("y") * cells + at("x")).cast("int"))
    placed = points.select(F.col("key").cast("string").alias("key"), cell.alias("cell"), F.col("ts").cast("timestamp").alias("ts"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, n, missed, top = state.get if state.exists else (bytes(-(-cells * cells // 8)), 0, 0, None)
        bits, last = np.frombuffer(held, np.uint8).copy(), top
        for frame in frames:
            known = frame["cell"].notna() & frame["ts"].notna()
            if top is not None:
                known &= frame["ts"] >= pd.Timestamp(top) - behind
            own = frame[known]
            np.bitwise_or.at(bits, own["cell"].to_numpy(np.int64) >> 3, (1 << (own["cell"].to_numpy(np.int64) & 7)).astype(np.uint8))
            n, missed = n + len(own), missed + int((~known).sum())
            if len(own):
                last = max(x for x in (last, own["ts"].max().to_pydatetime()) if x is not None)
        state.update((bits.tobytes(), n, missed, last))
        full = int(np.unpackbits(bits).sum())
        yield pd.DataFrame({"key": [key[0]], "n_points": [n], "n_cells": [full], "coverage": [full / (cells * cells)], "late": [missed]})

    return placed.groupBy("key").applyInPandasWithState(update, OUT, STATE, "update", "NoTimeout")
