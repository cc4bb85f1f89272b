"""Exact top-k by inner product: a KD-tree for each shard, searched best first.

The vectors are split by medians into shards with tight boxes, whose trees are built once and kept as rows. A query is
searched in its own shard first; its k-th score is the floor that the box of any other shard has to reach.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tielace.operators.nearest import numbered, split

from .base import Scratch, pick

SHARD_ROWS = 8192
#: The splits into shards are medians of at most so many vectors, those with the smallest hash of their id.
SPLIT_ROWS = 20_000
#: Neighbouring shards that a task searches one after the other, with the floors so far.
BUNDLE = 8
QUERY_ROWS = 16384
LEAF_ROWS = 128
LONG = 2**63 - 1


class KDTree:
    """Median splits along the widest side; every node has the tight box of its points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids, self.wide = points, ids, points.dtype == object
        order = np.lexsort((ids,))
        self.points, self.ids = points[order], ids[order]
        self.low, self.high, self.span, self.children = [], [], [], []
        place = np.arange(len(ids))
        self._grow(place, 0, len(ids))
        self.points, self.ids = self.points[place], self.ids[place]
        self.low, self.high = np.array(self.low, dtype=points.dtype), np.array(self.high, dtype=points.dtype)

    def _grow(self, place: np.ndarray, start: int, end: int) -> int:
        node, own = len(self.span), self.points[place[start:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((start, end))
        self.children.append(None)
        if end - start > LEAF_ROWS and (high > low).any():
            side, half = int(np.argmax(high - low)), (end - start) // 2
            cut = np.argsort(own[:, side], kind="stable") if self.wide else np.argpartition(own[:, side], half)
            place[start:end] = place[start:end][cut]
            self.children[node] = (self._grow(place, start, start + half), self._grow(place, start + half, end))
        return node

    def packed(self) -> bytes:
        """The tree as a row keeps it, in the narrowest numbers that hold its points."""
        most = float(np.abs(self.points).max(initial=0))
        kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
        return pickle.dumps((self.points.astype(kind), self.ids, self.low.astype(kind), self.high.astype(kind), self.span, self.children))

    @classmethod
    def unpacked(cls, data: bytes) -> KDTree:
        tree = cls.__new__(cls)
        tree.points, tree.ids, tree.low, tree.high, tree.span, tree.children = pickle.loads(data)
        tree.points, tree.low, tree.high = (x.astype(np.float64) for x in (tree.points, tree.low, tree.high))
        tree.wide = False
        return tree

    def widened(self, queries: np.ndarray) -> np.ndarray:
        """The queries; they and the tree in whole numbers of any size where inner products may not be exact in doubles."""
        most = float(np.abs(self.points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        if most < 2**53:
            return queries
        whole = np.vectorize(int, otypes=[object])
        self.points, self.low, self.high, self.wide = whole(self.points), whole(self.low), whole(self.high), True
        return whole(queries)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, node]: no point in the node's box has a larger inner product."""
        zero = queries.dtype.type(0) if not self.wide else 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: float) -> list[tuple]:
        """(score, -id) of the best k points but own, of those that score at least floor; each id once."""
        best: list[tuple] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            start, end = self.span[node]
            scores = self.points[start:end] @ query
            for at in np.flatnonzero(scores >= floor).tolist():
                found = (int(scores[at]), -int(self.ids[start + at]))
                if -found[1] != own and found not in best:
                    same = next((i for i, b in enumerate(best) if b[1] == found[1]), None)
                    if same is not None:
                        if best[same] < found:
                            best[same] = found
                            heapq.heapify(best)
                    elif len(best) < k:
                        heapq.heappush(best, found)
                    else:
                        heapq.heappushpop(best, found)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def scaled(embedding: pa.Array) -> np.ndarray:
    """floor(256 * x) of vectors of one length: doubles where inner products are exact in them, else integers."""
    x = np.floor(embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256.0).reshape(len(embedding), -1)
    return x


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), dim of the vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0)
    return pick(vectors, "vec_id", "embedding").select("vec_id", x.alias("embedding"), F.size(x).alias("dim")).filter(good)


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products with other vectors.

    Components count as floor(256 * x). Queries (the rows for which is_query holds) are compared with every row
    but those of their own vec_id, ties to the smaller vec_id; a repeated vec_id counts once, by its best row.
    Vectors of another length than the query's are no candidates. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows with a null vec_id. Scores beyond a long stay at its end.

    Shards are the leaves of median splits, of about SHARD_ROWS; a leaf with more (equal vectors can't be split) is dealt
    into several. Queries that a box may concern go to it in blocks of about QUERY_ROWS; all others never meet it.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.save(usable(vectors))
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(1, -(-m // QUERY_ROWS))
    splits = {}
    for r in rows.groupBy("dim").count().filter(F.col("count") > SHARD_ROWS).collect():  # n / SHARD_ROWS at most
        few = min(SPLIT_ROWS, max(1, 4_000_000 // r["dim"]))
        some = rows.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(few).select("embedding").toArrow()
        splits[r["dim"]] = split(scaled(some.column("embedding").combine_chunks()), min(-(-r["count"] // SHARD_ROWS), few // 8 + 1), [])

    def place(batches):
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                if d in splits:
                    at = np.flatnonzero(dims == d)
                    cell[at] = numbered(splits[d], scaled(batch.column("embedding").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = rows.mapInArrow(place, "vec_id long, embedding array<double>, dim int, cell int")
    sizes = placed.groupBy(F.col("dim").alias("_dim"), F.col("cell").alias("_cell")).agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("vec_id", "embedding"), F.col("_parts")).cast("int")
    data = scratch.save(placed.join(scratch.save(sizes), (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))).withColumn("part", part).select("vec_id", "embedding", "dim", "cell", "part"))
    shard = ("dim", "cell", "part")

    def build(table: pa.Table) -> pa.Table:
        tree = KDTree(scaled(table.column("embedding").combine_chunks()), table.column("vec_id").to_numpy())
        columns = [table.column(c).slice(0, 1) for c in shard]
        box = pa.array([np.concatenate([tree.low[0], tree.high[0]]).astype("<f8").tobytes()])
        return pa.table([*columns, box, pa.array([tree.packed()])], names=[*shard, "box", "tree"])

    trees = scratch.save(data.groupBy(*shard).applyInArrow(build, "dim int, cell int, part int, box binary, tree binary"))
    home = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = data.filter(is_query).dropDuplicates(["vec_id", "embedding"]).withColumn("block", home)
    out = "query_id long, vec_id long, score long"

    def search(trees_: pa.Table, asks: pa.Table, elsewhere: bool) -> pa.Table:
        """Elsewhere: not in a query's own shard, which is done."""
        found: list[tuple] = []
        if trees_.num_rows and asks.num_rows:
            queries, ids = scaled(asks.column("embedding").combine_chunks()), asks.column("vec_id").to_pylist()
            floors = [-np.inf if f is None else f for f in asks.column("floor").to_pylist()]
            own = list(zip(asks.column("cell").to_pylist(), asks.column("part").to_pylist(), strict=True))
            for cell, part_, data_ in zip(*(trees_.column(c).to_pylist() for c in ("cell", "part", "tree")), strict=True):
                tree = KDTree.unpacked(data_)
                wide = tree.widened(queries)
                bounds = tree.bounds(wide)
                for q in range(len(ids)):
                    if bounds[q, 0] < floors[q] or (elsewhere and own[q] == (cell, part_)):
                        continue
                    best = tree.search(wide[q], bounds[q], ids[q], k, floors[q])
                    found += [(ids[q], -i, max(-LONG - 1, min(LONG, s))) for s, i in best]
                    if len(best) == k:
                        floors[q] = max(floors[q], best[0][0])
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    first = scratch.save(trees.groupBy(*shard).cogroup(asked.withColumn("floor", F.lit(None).cast("long")).groupBy(*shard)).applyInArrow(lambda t, a: search(t, a, False), out))
    found = first
    if trees.limit(2).count() > 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        floors = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("floor"))
        asks = scratch.save(asked.join(floors, F.col("vec_id") == F.col("_q"), "left").select("vec_id", "embedding", *shard, "block", "floor"))

        def concerned(asks_: pa.Table, boxes: pa.Table) -> pa.Table:
            """The boxes that any query of a block may have a better point in."""
            hits = []
            if asks_.num_rows and boxes.num_rows:
                queries = scaled(asks_.column("embedding").combine_chunks())
                floor = np.array([-np.inf if f is None else f for f in asks_.column("floor").to_pylist()])
                up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
                for at, box in enumerate(boxes.column("box").to_pylist()):
                    low, high = np.frombuffer(box, "<f8").reshape(2, -1)
                    bound = up @ high + down @ low
                    if (bound + np.abs(bound) * 1e-12 >= floor).any():  # (a bound beyond 2**53 is rounded)
                        hits.append(at)
            return boxes.take(pa.array(hits, pa.int64())).select([*shard, "block"])

        every = trees.select(*shard, "box", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        salted = lambda d, each: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))) if each else F.pmod(F.xxhash64(*shard), F.lit(16)).cast("int"))
        met = salted(asks, True).groupBy("dim", "block", "salt").cogroup(salted(every, False).groupBy("dim", "block", "salt")).applyInArrow(concerned, "dim int, cell int, part int, block int")
        bundle = F.floor(F.col("cell") / BUNDLE).cast("int").alias("bundle")
        met = scratch.save(met.select(*shard, "block", bundle))
        has = trees.drop("box").join(met, [*shard])
        wanted = met.select(*[F.col(c).alias(f"w_{c}") for c in ("dim", "bundle", "part", "block")]).distinct()
        sent = asks.join(wanted, (F.col("dim") == F.col("w_dim")) & (F.col("block") == F.col("w_block")))
        left, right = has.groupBy("dim", "bundle", "part", "block"), sent.groupBy("w_dim", "w_bundle", "w_part", "w_block")
        second = left.cogroup(right).applyInArrow(lambda t, a: search(t, a, True), out)
        found = first.unionByName(second)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_kdtree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
