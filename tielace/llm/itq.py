"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Centred vectors are turned so that the signs of their projections, cut at the medians, are balanced and lose the least.
Parts of these codes are the keys of the tables; in a bucket the Hamming distance of the whole codes discards, and the
vectors decide. Only codes go into the tables; a vector follows where its code has a near one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, pick
from .components import connected_components, spanning
from .runs import pairs_in_runs, whole_runs

#: The rotations are learned from at most so many vectors and so many numbers, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
SAMPLE_NUMBERS = 4_000_000
#: A bucket of more vectors than this is compared block by block.
BUCKET = 2048
#: Vectors that a bucket of the largest label has on average, about.
AVERAGE = 32
#: A pair exactly at the threshold is missed by all tables with this probability; closer ones less often.
MISSED = 0.002


def random_rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Quantiser:
    """A vector's bits: unit @ directions >= cuts."""

    directions: np.ndarray
    cuts: np.ndarray

    @classmethod
    def learn(cls, unit: np.ndarray, seed: int, rounds: int = 30) -> Quantiser:
        """Alternates codes = sign(data @ rotation) with the rotation that fits them best (orthogonal Procrustes), on centred
        data in its principal directions; bits are cut at the medians, so that half of the data is on either side."""
        dim = unit.shape[1]
        if len(unit) < 2:
            return cls(random_rotation(dim, seed), np.zeros(dim))
        centred = unit - unit.mean(axis=0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        data, turn = centred @ axes[:, ::-1], random_rotation(dim, seed)
        for _ in range(rounds):
            codes = np.where(data @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ data)
            turn = (left @ right).T
        directions = axes[:, ::-1] @ turn
        return cls(directions, np.median(unit @ directions, axis=0))

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions >= self.cuts


@dataclass
class Plan:
    """bits of a table's key, number of tables, and the largest Hamming distance of whole codes that isn't discarded."""

    quantisers: list[Quantiser]
    bits: int
    tables: int
    limit: int

    @classmethod
    def of(cls, unit: np.ndarray, rows: int, threshold: float) -> Plan:
        """As many tables as miss a pair at the threshold with probability MISSED, judged by neighbours made for the sample."""
        dim = unit.shape[1]
        bits = max(1, min(dim, 40, math.ceil(math.log2(max(2, rows / AVERAGE)))))
        first = Quantiser.learn(unit, 0)
        some = unit[: 4000]
        aside = np.random.default_rng(3).standard_normal(some.shape)
        aside -= (aside * some).sum(axis=1, keepdims=True) * some
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        other = threshold * some + math.sqrt(max(0.0, 1 - threshold**2)) * aside
        unlike = (first.bits(some) != first.bits(other)).mean(axis=1)
        hit, tables = (1 - unlike) ** bits, 1
        while ((1 - hit) ** tables).mean() > MISSED and tables < 4096:
            tables += 1
        turns = -(-tables // (dim // bits))
        # Codes of such neighbours lie farther apart than six deviations once in a hundred million times.
        limit = math.ceil(turns * dim * (unlike.mean() + 6 * float(unlike.std())))
        return cls([first, *(Quantiser.learn(unit, seed) for seed in range(1, turns))], bits, tables, min(limit, turns * dim))

    def for_dim(self, dim: int) -> Plan:
        """The same plan for vectors of another length than the sample's: random rotations, no discarding."""
        own = self.quantisers[0].directions.shape[0]
        if dim == own:
            return self
        bits = min(self.bits, dim)
        turns = -(-self.tables // (dim // bits))
        return Plan([Quantiser(random_rotation(dim, seed), np.zeros(dim)) for seed in range(turns)], bits, self.tables, turns * dim)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """[vector, word]: all bits of all rotations as unsigned 64-bit words."""
        packed = np.packbits(np.concatenate([q.bits(unit) for q in self.quantisers], axis=1), axis=1, bitorder="little")
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

    def keys(self, codes: np.ndarray, tables: int) -> np.ndarray:
        """[vector, table]: the parts of the codes that are the keys of the first tables."""
        dim = self.quantisers[0].directions.shape[0]
        bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
        each, weights = dim // self.bits, 1 << np.arange(self.bits)
        starts = [k // each * dim + k % each * self.bits for k in range(tables)]
        return np.stack([bits[:, s : s + self.bits] @ weights for s in starts], axis=1) if tables else np.zeros((len(codes), 0), np.int64)


def near_codes(plan: Plan, key: np.ndarray, table: np.ndarray, codes: np.ndarray, apart: np.ndarray, once: bool):
    """Pairs i < j of equal neighbouring keys whose codes are within the limit.

    apart: numbers that pairs must not share (the blocks of a bucket met crosswise), -1 where they may. once: without the
    pairs that an earlier table has together.
    """
    keys = np.ascontiguousarray(plan.keys(codes, plan.tables).T) if once else None
    words = np.ascontiguousarray(codes.T)
    for i, j in pairs_in_runs(key):
        far = np.zeros(len(i), np.int16)
        for w in words:
            far += np.bitwise_count(w[i] ^ w[j])
        ok = (far <= plan.limit) & ((apart[i] < 0) | (apart[i] != apart[j]))
        i, j = i[ok], j[ok]
        if once:
            for t in range(int(table.max(initial=0))):  # most pairs of a dense bucket go at the first tables
                new = (keys[t][i] != keys[t][j]) | (table[i] <= t)
                i, j = i[new], j[new]
        yield i, j


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector.

    Two vectors link if their labels are equal and not null and their cosine, in doubles, is at least the
    threshold. n_links counts the other rows that a row links with; component_id is the smallest vec_id reachable.
    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or
    vec_id, link with nothing (component_id is their own vec_id). Vectors of different lengths don't link.
    Equal vectors of a label are counted, not paired. Repeated rows count and are returned as often as they occur.

    Every vector's code goes into each table under a part of it; members of a bucket that have a near code in it are
    compared by their vectors, so no false link is made. A pair counts in the first table that has it in one bucket.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    x = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = pick(vectors, "vec_id", "embedding", "label").withColumn("good", good)
    distinct = scratch.save(rows.filter("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    dims = distinct.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = dims["dim"]
    most = distinct.groupBy("label").count().agg(F.max("count")).first()[0]
    few = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim))
    sample = distinct.filter(F.size("embedding") == dim).orderBy(F.xxhash64("rep", F.lit(10)), "rep").limit(few).select(x.alias("embedding")).toArrow()
    plan = Plan.of(_unit(sample.column("embedding").combine_chunks()), most, threshold)

    def encode(batches):
        plans: dict[int, Plan] = {}
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for d in np.unique(size).tolist():
                own = plans.setdefault(d, plan.for_dim(d))
                part = pa.Table.from_batches([batch]).filter(pa.array(size == d)).combine_chunks()
                codes = own.codes(_unit(part.column("embedding").combine_chunks()))
                keys = own.keys(codes, own.tables)
                made = part.drop_columns(["embedding"]).append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))
                yield from made.append_column("keys", pa.array(list(keys), pa.list_(pa.int64()))).to_batches()

    # Floats travel as they are given; cosines are taken in doubles. A vector's place is its rep and hash.
    floats = dict(distinct.dtypes)["embedding"] == "array<float>"
    kept = F.col("embedding") if floats else x.alias("embedding")
    source = distinct.select(F.xxhash64("label").alias("label"), "rep", F.xxhash64("label", "embedding").alias("own"), "copies", F.size("embedding").alias("dim"), kept)
    codes = source.select("label", "rep", "own", "dim", "embedding").mapInArrow(encode, "label long, rep long, own long, dim int, code binary, keys array<long>")
    spread = codes.select("label", "rep", "own", "dim", "code", F.posexplode("keys").alias("t", "part")).withColumn("bucket", F.xxhash64("label", "dim", "t", "part")).drop("part")
    spread = scratch.save(spread)
    heavy = scratch.save(spread.groupBy("bucket").count().filter(F.col("count") > BUCKET).select(F.col("bucket").alias("_b"), F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks")))
    if heavy.isEmpty():
        dealt = spread.withColumns({"block": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    else:
        some = spread.join(heavy, F.col("bucket") == F.col("_b"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        some = some.withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = some.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    columns = ("key", "label", "rep", "own", "dim", "t", "block", "low", "high", "code")
    dealt = dealt.withColumn("key", F.xxhash64("bucket", "low", "high")).select(*columns)

    def parts(batches, once):
        """Tables of whole buckets, of vectors of one length each, with their near pairs."""
        plans: dict[int, Plan] = {}
        for table, _ in whole_runs(batches, "key", 1 << 30):
            size = table.column("dim").to_numpy()
            for d in np.unique(size).tolist():
                own = plans.setdefault(d, plan.for_dim(d))
                part = table.filter(pa.array(size == d)) if size.min() != size.max() else table
                key, label, t, block, low, high = (part.column(c).to_numpy() for c in ("key", "label", "t", "block", "low", "high"))
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(part.num_rows, -1)
                pairs = near_codes(own, key, t, codes, np.where(low != high, block, -1), once)
                yield part, ((i[label[i] == label[j]], j[label[i] == label[j]]) for i, j in pairs)

    def discard(batches):
        """The members of buckets that have a near code there."""
        for part, pairs in parts(batches, False):
            hits = np.zeros(part.num_rows, bool)
            for i, j in pairs:
                hits[i] = hits[j] = True
            yield from part.filter(pa.array(hits)).to_batches()

    def compare(batches):
        for part, pairs in parts(batches, True):
            unit, rep, copies = _unit(part.column("embedding").combine_chunks()), part.column("rep").to_numpy(), part.column("copies").to_numpy()
            n = np.zeros(part.num_rows, np.int64)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i, j in pairs:
                near = (unit[i] * unit[j]).sum(axis=1) >= threshold
                i, j = i[near], j[near]
                n += (np.bincount(i, copies[j], len(n)) + np.bincount(j, copies[i], len(n))).astype(np.int64)
                a, b = spanning(np.concatenate([a, rep[i]]), np.concatenate([b, rep[j]]))
            has = np.flatnonzero(n)
            no = lambda k: pa.nulls(k, pa.int64())
            own = pa.array(part.column("own").to_numpy()[has])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), no(len(a)), no(len(a))], names=["a", "b", "own", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(rep[has]), no(len(has)), own, pa.array(n[has])], names=["a", "b", "own", "n"])

    types = "key long, label long, rep long, own long, dim int, t int, block int, low int, high int, code binary"
    left = scratch.save(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(discard, types))
    vectors_of = source.select(F.col("rep").alias("_rep"), F.col("own").alias("_own"), "copies", "embedding")
    asked = left.join(vectors_of, (F.col("rep") == F.col("_rep")) & (F.col("own") == F.col("_own"))).select(*columns, "copies", "embedding")
    found = scratch.save(asked.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, own long, n long"))
    linked = connected_components(found.filter("b IS NOT NULL"), scratch)
    counted = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("_a"), F.col("own").alias("_own")).agg(F.sum("n").alias("n"))
    known = distinct.withColumn("own", F.xxhash64("label", "embedding"))
    merged = known.join(linked, F.col("rep") == F.col("node"), "left").join(counted, (F.col("rep") == F.col("_a")) & (F.col("own") == F.col("_own")), "left")
    groups = scratch.save(merged.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    joined = rows.join(groups, F.col("good") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _unit(embedding: pa.Array) -> np.ndarray:
    v = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embedding), -1) if len(embedding) else np.zeros((0, 1))
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), np.finfo(float).tiny)  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def op10_itq_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: By brute force; equal as long as the tables miss no link.
OP10_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.v = l.a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), least AS (
  SELECT v, min(c) AS component_id FROM reach GROUP BY v
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least ON e.vec_id = v LEFT JOIN counts ON e.vec_id = a
"""
