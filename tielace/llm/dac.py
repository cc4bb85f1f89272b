"""Token ids in directly addressable codes: chunk levels, continuation bitmaps, rank directories."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scratch, pick, text_batches
from .tokens import kept_encoder, public_file, with_end

#: Ids of a shard, about; a document is never divided.
SHARD_IDS = 1 << 19
#: Bits of a bitmap for each entry of its rank directory.
RANK_BITS = 512
#: Bits of a chunk: a byte, so that levels are read and written as they lie in memory.
CHUNK_BITS = 8

SHARD_SCHEMA = "part int, seq int, n long, doc_ids binary, lengths binary, widths array<int>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


def widths_for(ids: np.ndarray) -> list[int]:
    """Chunk widths, from the low bits up: whole bytes, as many as the largest id needs."""
    return [CHUNK_BITS] * max(1, -(-int(ids.max(initial=0)).bit_length() // CHUNK_BITS))


class Codes:
    """A sequence of ids: level k has width[k] further bits of the ids that need them, bitmap k says which go on."""

    def __init__(self, widths: list[int], chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], n: int):
        self.widths, self.chunks, self.bitmaps, self.n = widths, chunks, bitmaps, n
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        widths, chunks, bitmaps, ranks, left = widths_for(ids), [], [], [], ids.astype(np.uint32)
        for k, width in enumerate(widths):
            chunks.append(left.astype(np.uint8).tobytes())  # the low byte
            left = left >> np.uint32(width)
            if k + 1 < len(widths):
                more = left > 0
                bitmaps.append(np.packbits(more, bitorder="little").tobytes())
                full = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
                ranks.append(np.concatenate([[0], np.cumsum(full)]).astype("<u4").tobytes())
                left = left[more]
        return cls(widths, chunks, bitmaps, ranks, len(ids))

    def rank(self, k: int, at: int) -> int:
        """Set bits of bitmap k before place at: the directory's count and the rest of one stretch."""
        block = at // RANK_BITS
        low = block * RANK_BITS // 8
        rest = np.unpackbits(np.frombuffer(self.bitmaps[k], np.uint8)[low : -(-at // 8)], bitorder="little", count=at - block * RANK_BITS) if at % RANK_BITS else ()
        return int(self.ranks[k][block]) + int(np.sum(rest))

    def slice(self, start: int, end: int) -> np.ndarray:
        """ids[start:end], without reading any that stand before or after."""
        found, here, shift = np.zeros(end - start, np.uint32), np.arange(end - start), 0
        for k, width in enumerate(self.widths):
            if start == end:
                break
            part = np.frombuffer(self.chunks[k], np.uint8, end - start, start).astype(np.uint32)
            if k:
                found[here] |= part << np.uint32(shift)
            else:
                found = part
            shift += width
            if k + 1 < len(self.widths):
                raw = np.frombuffer(self.bitmaps[k], np.uint8)[start // 8 : -(-end // 8)]
                more = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
                start = self.rank(k, start)
                here, end = here[more], start + int(more.sum())
        return found

    def __getitem__(self, at: int) -> int:
        return int(self.slice(at, at + 1)[0])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of all texts, each with the end id, in ascending doc_id order, to a folder of shards.

    A shard is a row of Parquet, so that Spark's writers commit it: part and seq (its place in the order), n (ids),
    doc_ids and lengths (little-endian long and unsigned int arrays) and the levels of its Codes. Null texts count as
    empty; rows with a null doc_id come first; rows with one doc_id stand together in any order, also in several
    shards if they are many. No rows: no shards.
    """

    def run(batches):
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, kept_encoder(tokenizer)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def shard():
            doc_ids = [d for x in held for d in x[0]]
            ids, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            c = Codes.of(ids)
            known = np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes() + np.packbits([d is None for d in doc_ids]).tobytes()
            columns = [[part], [seq], [len(ids)], [known], [lengths.astype("<u4").tobytes()], [c.widths], [c.chunks], [c.bitmaps], [[r.tobytes() for r in c.ranks]]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.binary())] * 3]
            names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

        for batch in text_batches(batches, 8 << 20):
            ids, lengths = with_end(*encoder.encode(batch.column("text")), end_id)
            doc_ids = batch.column("doc_id").to_pylist()
            cuts = np.cumsum(lengths)
            part_of = (cuts - 1) // SHARD_IDS
            edges = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), len(doc_ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                piece = ids[(cuts[a - 1] if a else 0) : cuts[b - 1]]
                held.append((doc_ids[a:b], piece, lengths[a:b]))
                size += len(piece)
                if size >= SHARD_IDS:
                    yield shard()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield shard()

    # The place parts rows that share a doc_id, so that no task has to take all of them.
    keyed = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "_place").sortWithinPartitions("doc_id").drop("_place")
    ordered.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, n, base (ids before the shard) of a folder's shards, from their sizes alone."""
    sizes = shards.select("part", "seq", "n")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("all"))  # a row for each task that wrote
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inside.join(parts.select("part", before.alias("base")), "part").select("part", "seq", "n", (F.col("base") + F.col("inside")).alias("base"))


def read_places(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """place, id of the ids at places start to end (not included) of all ids of a folder, in the order written.

    Only shards that hold some of them are read, and of these only the codes asked for. Places beyond the end: no rows.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    wanted = shard_starts(shards).filter((F.col("base") < end) & (F.col("base") + F.col("n") > start)).drop("n")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(*(row[c] for c in ("widths", "chunks", "bitmaps", "ranks", "n")))
                first, last = max(0, start - row["base"]), min(row["n"], end - row["base"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last) + row["base"]), pa.array(codes.slice(first, last).astype(np.int64))], names=["place", "id"])

    return shards.drop("doc_ids", "lengths").join(wanted, ["part", "seq"]).mapInArrow(run, "place long, id long")


def read_ids(spark: SparkSession, path: str, visit=None, extra: str = "") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens of a folder of shards, and what visit makes of the ids.

    visit(ids) gives a tuple of values for the columns that extra declares.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(*(row[c] for c in ("widths", "chunks", "bitmaps", "ranks", "n")))
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends, n = np.cumsum(lengths), len(lengths)
                unknown = np.unpackbits(np.frombuffer(row["doc_ids"], np.uint8)[8 * n :], count=n).astype(bool)
                columns = [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(np.frombuffer(row["doc_ids"], "<i8", n), mask=unknown), pa.array(ends - lengths), pa.array(lengths)]
                names = ["part", "seq", "doc_id", "before", "n_tokens"]
                if visit:
                    ids = codes.slice(0, codes.n)
                    made = [visit(x) for x in np.split(ids, ends[:-1])]
                    fields = [f.split() for f in extra.split(",")]
                    columns += [pa.array([m[i] for m in made], pa.int64() if kind == "long" else pa.list_(pa.int64())) for i, (_, kind) in enumerate(fields)]
                    names += [name for name, _ in fields]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = shards.mapInArrow(run, "part int, seq int, doc_id long, before long, n_tokens long" + (f", {extra}" if extra else ""))
    starts = shard_starts(shards).drop("n")
    return found.join(starts, ["part", "seq"]).withColumn("start", F.col("base") + F.col("before")).drop("part", "seq", "base", "before")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op5_dac_tokens(spark, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'ids').root}/shards"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_file("word_bpe_49k.json"))
    return read_ids(spark, folder, lambda ids: (crc(ids),), "ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")
