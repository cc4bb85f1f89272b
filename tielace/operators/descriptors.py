"""Descriptor matching: best two by cosine and the ratio test."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on either side, and those compared with the other side at once.
BLOCK, CHUNK = 4096, 512


def best_two(distances: np.ndarray) -> np.ndarray:
    """[row, 2]: the two smallest of each row, ties to the earlier column."""
    first = distances.argmin(axis=1)
    if distances.shape[1] == 1:
        return first[:, None]
    rest = distances.astype(float)
    rest[np.arange(len(rest)), first] = np.inf
    return np.stack([first, rest.argmin(axis=1)], axis=1)


def hamming_matches(source: DataFrame, reference: DataFrame, ratio: float) -> DataFrame:
    """src, ref, distance of the source codes (vec_id, code) whose nearest reference code is nearer than ratio times the second.

    All against all, in blocks, as ratio_matches; equal distances go to the smaller vec_id.
    """
    n, m = (max(1, -(-d.count() // BLOCK)) for d in (source, reference))
    part = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    left = source.select(F.col("vec_id").alias("src"), "code", part(n).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = reference.select(F.col("vec_id").alias("ref"), "code", part(m).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if x.num_rows and y.num_rows:
            y = y.sort_by("ref")
            a, b = (t.column("code").to_numpy().view(np.uint64) for t in (x, y))
            src, ref, parts = x.column("src").to_numpy(), y.column("ref").to_numpy(), []
            for at in range(0, len(a), CHUNK):
                far = np.bitwise_count(a[at : at + CHUNK, None] ^ b)
                top = best_two(far)
                parts.append((np.repeat(src[at : at + CHUNK], top.shape[1]), ref[top].ravel(), np.take_along_axis(far, top, 1).ravel().astype(np.int64)))
            found = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["src", "ref", "d"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "src long, ref long, d long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("d", "ref"))).filter("place <= 2")
    pick = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    two = ranked.groupBy("src").agg(pick("ref", 1).alias("ref"), pick("d", 1).alias("d1"), pick("d", 2).alias("d2"))
    return two.filter(F.col("d1") < ratio * F.col("d2")).select("src", "ref", F.col("d1").cast("int").alias("distance"))


def ratio_matches(source: DataFrame, reference: DataFrame, ratio: float) -> DataFrame:
    """src, ref, cosine, correct (labels agree) of the source descriptors whose best match is clearly better.

    All against all, in blocks: each task multiplies one block of either side and gives the best two of each source
    row; a window merges the blocks. (1 - best) has to be below ratio * (1 - second).
    """
    blocks = lambda d: max(1, -(-d.count() // BLOCK))
    n, m = blocks(source), blocks(reference)
    part = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    left = source.select(F.col("vec_id").alias("src"), F.col("label").alias("a"), F.col("embedding").alias("u"), part(n).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = reference.select(F.col("vec_id").alias("ref"), F.col("label").alias("b"), F.col("embedding").alias("w"), part(m).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        rows = []
        if x.num_rows and y.num_rows:
            vectors = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
            y = y.sort_by("ref")
            u, w = vectors(x, "u"), vectors(y, "w").T
            src, a = x.column("src").to_pylist(), x.column("a").to_pylist()
            ref, b = y.column("ref").to_pylist(), y.column("b").to_pylist()
            for at in range(0, len(u), CHUNK):
                cosines = np.round(u[at : at + CHUNK] @ w, 12)  # equal vectors tie wherever they stand in a block
                top = best_two(-cosines)
                rows += [(src[at + k], ref[t], float(cosines[k, t]), a[at + k] == b[t]) for k in range(len(top)) for t in top[k].tolist()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["src", "ref", "cosine", "correct"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "src long, ref long, cosine double, correct boolean")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), "ref"))).filter("place <= 2")
    pick = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    two = ranked.groupBy("src").agg(pick("ref", 1).alias("ref"), pick("cosine", 1).alias("cosine"), pick("cosine", 2).alias("second"), pick("correct", 1).alias("correct"))
    return two.filter((1 - F.col("cosine")) < ratio * F.greatest(1 - F.col("second"), F.lit(1e-9))).drop("second")


def pair_matches(source: DataFrame, reference: DataFrame, ratio: float, shifts: int = 1, block: int = 2048) -> DataFrame:
    """pair, src, ref, cosine of the source descriptors whose best match within their image pair is clearly better than the second.

    Both sides: pair, key, vector (of length 1). With shifts, a vector is a row of histograms of so many bins, and a source descriptor counts at the best of the
    cyclic shifts of its bins, which a turned image has. (1 - best) has to be below ratio * (1 - second), but no less than 1e-10; with a single
    candidate there is no second one to fail against. Ties go to the smaller key.

    Only descriptors of one pair meet: the join is keyed by pair and by blocks of either side, as many as its own numbers ask for.
    """
    counts = [d.groupBy("pair").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for d, n in ((source, "n"), (reference, "m"))]
    blocks = counts[0].join(counts[1], "pair")
    part = lambda k: F.pmod(F.xxhash64("key"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = source.join(blocks, "pair").select("pair", F.col("key").alias("src"), F.col("vector").alias("u"), part("n").alias("i"), every("m").alias("j"))
    right = reference.join(blocks, "pair").select("pair", F.col("key").alias("ref"), F.col("vector").alias("w"), part("m").alias("j"), every("n").alias("i"))
    types = [source.schema[c].dataType.simpleString() for c in ("pair", "key")] + [reference.schema["key"].dataType.simpleString()]

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        pair, src, ref, cosine = [], [], [], []
        if x.num_rows and y.num_rows:
            vectors = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            y = y.sort_by("ref")
            u, w = vectors(x, "u"), vectors(y, "w")
            cosines = np.full((len(u), len(w)), -np.inf)
            for s in range(shifts):
                turned = np.roll(u.reshape(len(u), -1, shifts), s, axis=2).reshape(len(u), -1) if s else u
                np.maximum(cosines, turned @ w.T, out=cosines)
            top = best_two(-np.round(cosines, 12))
            src, ref = np.repeat(x.column("src").to_numpy(zero_copy_only=False), top.shape[1]), y.column("ref").to_numpy(zero_copy_only=False)[top.ravel()]
            cosine, pair = np.take_along_axis(cosines, top, 1).ravel(), [x.column("pair")[0].as_py()] * len(src)
        return pa.table([pa.array(pair, x.schema.field("pair").type), pa.array(src, x.schema.field("src").type), pa.array(ref, y.schema.field("ref").type), pa.array(cosine, pa.float64())], names=["pair", "src", "ref", "cosine"])

    found = left.groupBy("pair", "i", "j").cogroup(right.groupBy("pair", "i", "j")).applyInArrow(best, f"pair {types[0]}, src {types[1]}, ref {types[2]}, cosine double")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("pair", "src").orderBy(F.desc(F.round("cosine", 12)), "ref"))).filter("place <= 2")
    pick = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    two = ranked.groupBy("pair", "src").agg(pick("ref", 1).alias("ref"), pick("cosine", 1).alias("cosine"), pick("cosine", 2).alias("second"))
    clear = F.col("second").isNull() | ((1 - F.col("cosine")) < ratio * F.greatest(1 - F.col("second"), F.lit(1e-10)))
    return two.filter(clear).drop("second")
