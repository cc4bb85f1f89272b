"""Packing documents into sequences: length patterns fitted by non-negative least squares.

Few-document patterns are enumerated from the histogram of lengths, their counts fitted to it and rounded down, again and
again on what is left; best fit places the last few hundred pieces.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, partitions, pick, text_batches
from .dac import crc
from .tokens import kept_encoder, public_file, with_end

#: Rounds of coordinate steps of a fit at most, and steps of a round.
ROUNDS, STEPS = 3000, 256
#: Pieces that are left to best fit.
RESIDUAL = 600


@dataclass
class Shapes:
    """Patterns of up to three parts; part k of a pattern is times[:, k] documents of length lengths[:, k] (0: no part)."""

    lengths: np.ndarray
    times: np.ndarray

    def norms(self) -> np.ndarray:
        """Squared lengths of the patterns' columns: a length in two parts counts once, with the sum of its times."""
        found = (self.times**2).sum(axis=1)
        for i, j in ((0, 1), (0, 2), (1, 2)):
            same = (self.lengths[:, i] == self.lengths[:, j]) & (self.lengths[:, i] > 0)
            found = found + 2 * same * self.times[:, i] * self.times[:, j]
        return found.astype(float)

    def documents(self, at: int) -> dict[int, int]:
        """How many documents of each length a pattern has."""
        found: dict[int, int] = defaultdict(int)
        for length, times in zip(self.lengths[at].tolist(), self.times[at].tolist(), strict=True):
            if length:
                found[length] += times
        return found


def patterns(histogram: np.ndarray, size: int) -> Shapes:
    """All patterns of two or three parts that fill a sequence.

    A part is one document, or 2, 4, 8 ... of one length where none is as long as they are together, so that short
    documents fill a sequence as well.
    """
    length, times = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for n in (1 << k for k in range(size.bit_length())):
        own = np.flatnonzero(histogram[: size // n + 1] >= n)
        own = own[(own > 0) & (length[own * n] == 0)]
        length[own * n], times[own * n] = own, n
    parts = np.flatnonzero(length)
    a, b = (x.ravel() for x in np.meshgrid(parts, parts, indexing="ij"))
    a, b = a[(a >= b) & (a + b <= size)], b[(a >= b) & (a + b <= size)]
    c = size - a - b
    some = (c == 0) | ((c <= b) & (length[c] > 0))
    values = np.stack([a, b, c], axis=1)[some]
    return Shapes(length[values], times[values])


def fit_counts(shapes: Shapes, histogram: np.ndarray) -> np.ndarray:
    """Counts x >= 0 of the patterns that least-squares fit their documents to the histogram.

    Coordinate descent: a round sets the counts with the steepest descent, no two of which share a length, to their
    best values, down to 0 at least, until no step is worth taking.
    """
    x, left = np.zeros(len(shapes.lengths)), histogram.astype(float)
    left[0] = 0.0
    if not len(x):
        return x
    norm, least = shapes.norms(), max(0.02, 1e-5 * float(histogram.max()))
    columns = [(np.ascontiguousarray(v), np.ascontiguousarray(t).astype(float)) for v, t in zip(shapes.lengths.T, shapes.times.T, strict=True)]
    for _ in range(ROUNDS):
        gain = np.maximum(sum(left[v] * t for v, t in columns) / norm, -x)
        worth = gain * gain * norm
        best = np.argpartition(-worth, min(STEPS, len(x) - 1))[:STEPS]
        best = best[np.argsort(-worth[best], kind="stable")]
        best = best[np.abs(gain[best]) >= least]
        used: set[int] = {0}
        for at, step, own, times in zip(best.tolist(), gain[best].tolist(), shapes.lengths[best].tolist(), shapes.times[best].tolist(), strict=True):
            if used.isdisjoint(v for v in own if v):
                used.update(own)
                x[at] += step
                for v, t in zip(own, times, strict=True):
                    left[v] -= t * step
        if not len(best):
            break
    return x


def best_fit(histogram: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Patterns and counts from placing lengths, longest first, where they leave the least room; equal bins at once."""
    open_bins: dict[int, list[list]] = defaultdict(list)
    room = np.zeros(size + 1, np.int64)

    def put(pattern: tuple[int, ...], n: int) -> None:
        left = size - sum(pattern)
        open_bins[left].append([pattern, n])
        room[left] += n

    for length in range(size, 0, -1):
        count = int(histogram[length])
        while count:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                left = length + int(fits[0])
                entry = open_bins[left][-1]
                n = min(entry[1], count)
                entry[1] -= n
                room[left] -= n
                if not entry[1]:
                    open_bins[left].pop()
                put((*entry[0], length), n)
                count -= n
            else:
                each = size // length
                if count >= each:
                    put((length,) * each, count // each)
                    count %= each
                else:
                    put((length,) * count, 1)
                    count = 0
    found: dict[tuple[int, ...], int] = defaultdict(int)
    for entries in open_bins.values():
        for pattern, n in entries:
            found[pattern] += n
    return found


def fitted(histogram: np.ndarray, size: int) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Patterns with their counts, and the histogram of what is left: RESIDUAL pieces or what no pattern takes.

    Counts are fitted and rounded down, and what is left is fitted again: rounding down leaves a mix of lengths that
    still fits together. Where all counts are below one, those of a half or more are taken once.
    """
    left, chosen = histogram.astype(np.int64), defaultdict(int)
    while left.sum() > RESIDUAL:
        shapes, took = patterns(left, size), 0
        x = fit_counts(shapes, left)
        n = np.floor(x) if (x >= 1).any() else (x >= 0.5).astype(float)
        for at in np.argsort(-x, kind="stable")[: int((n > 0).sum())].tolist():
            own = shapes.documents(at)
            count = min(int(n[at]), *(int(left[length]) // times for length, times in own.items()))
            if count > 0:
                took += count
                chosen[tuple(sorted((v for v, k in own.items() for _ in range(k)), reverse=True))] += count
                for length, times in own.items():
                    left[length] -= count * times
        if not took:
            break
    return chosen, left


def choose(histogram: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Patterns and how many sequences take each: fitted ones, which are full, then best fit for the residual."""
    rest = histogram.astype(np.int64)
    full, rest[size] = int(rest[size]), 0
    chosen, left = fitted(rest, size)
    for pattern, n in best_fit(left, size).items():
        chosen[pattern] += n
    return {(size,): full} | chosen if full else chosen


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    A document's ids, with the end id, are one piece, or if they are longer than size, pieces of size ids of which
    the first may be shorter. Null texts count as empty: they are the end id alone. Rows with one doc_id, or a null
    one, are documents of their own. No rows: no pieces.

    Only the histogram of piece lengths (size numbers) comes to the driver, which chooses patterns of lengths and
    their counts. The rank of a piece among those of its length then says which sequence has it and where.
    Ranks are made of counts by length and salt, so that no task has a whole length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    salts = max(64, 4 * partitions(spark))

    def cut(batches):
        encoder = kept_encoder(tokenizer)
        for batch in text_batches(batches, 4 << 20):
            ids, lengths = with_end(*encoder.encode(batch.column("text")), end_id)
            n = -(-lengths // size)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = lengths - (n - 1) * size
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            length = np.where(piece == 0, first[row], size)
            crcs = [crc(x) for x in np.split(ids, np.cumsum(length)[:-1])] if len(row) else []
            columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(c) for c in (piece.astype(np.int32), start, length, np.array(crcs, np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    made = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = scratch.save(made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = scratch.save(pieces.groupBy("length", "salt").count())
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # size rows at most
        histogram[r["length"]] = r["n"]

    slots, taken, base = [], np.zeros(size + 1, np.int64), 0
    for pattern, n in choose(histogram, size).items():
        at = 0
        for v in pattern:
            slots.append((v, taken[v], base, at))
            taken[v] += n
            at += v
        base += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(before, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_file("byte_bpe_50k.json"))
