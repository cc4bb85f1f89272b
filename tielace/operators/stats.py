"""Evaluation aggregates: errors, success, calibration, bootstrap, summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rmse(dx: Column, dy: Column) -> Column:
    return F.sqrt(F.avg(dx * dx + dy * dy))


def ce90(residual: Column) -> Column:
    return F.percentile(residual, F.lit(0.9))


def success_rate(value: Column, limit: float) -> Column:
    """The share of known values within the limit."""
    return F.avg(F.when(value.isNotNull(), (value <= limit).cast("int")))


def adaptive_threshold(sigma: Column, scale: float = 3.0, low: float = 0.75, high: float = 8.0) -> Column:
    """Three times the median of the positive sigmas, within bounds; 2 with fewer than five of them."""
    usable = F.when(sigma > 0, sigma)
    raw = F.when(F.count(usable) < 5, F.lit(2.0)).otherwise(F.median(usable) * scale)
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def truth_rmse(estimated: list[Column], true: list[float] | list[Column], width: float, height: float, n: int = 24) -> Column:
    """RMS distance of two transforms over an n x n grid of the image's inner nine tenths; infinite for an unknown one."""
    from tielace.functions.expr import apply_homography

    steps = F.sequence(F.lit(0), F.lit(n * n - 1))

    def squared(k: Column) -> Column:
        x, y = (0.05 + 0.9 * F.floor(k / n) / (n - 1)) * width, (0.05 + 0.9 * (k % n) / (n - 1)) * height
        ex, ey = apply_homography(estimated, x, y)
        tx, ty = apply_homography(true, x, y)
        return (ex - tx) * (ex - tx) + (ey - ty) * (ey - ty)

    total = F.aggregate(steps, F.lit(0.0), lambda s, k: s + squared(k))
    return F.coalesce(F.sqrt(total / (n * n)), F.lit(math.inf))


def cross_consistency(there: list[Column], back: list[Column]) -> Column:
    """Frobenius distance from the identity of the product of two transforms, scaled to a last element of 1."""
    both = [sum((there[3 * i + k] * back[3 * k + j] for k in range(1, 3)), there[3 * i] * back[j]) for i in range(3) for j in range(3)]
    parts = [both[k] / both[8] - (1 if k % 4 == 0 else 0) for k in range(9)]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], slack: float = 0.01) -> DataFrame:
    """keys, n, q: exact linearly interpolated quantiles of a column's known values, as an array.

    A sketch brackets each quantile; only what lies in a bracket is ranked, distinct value by distinct value, and the rest is
    counted. So no group, not even that of a whole table, is sorted or held in one task.
    """
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = [e for s in shares for e in (max(0.0, s - slack), min(1.0, s + slack))]
    sketch = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, int(10 / slack)).alias("_e"))
    few = F.col("n") <= 4 / slack  # all of a small group is ranked
    low = lambda i: F.when(few, F.lit(-math.inf)).otherwise(F.get("_e", F.lit(2 * i)))
    high = lambda i: F.when(few, F.lit(math.inf)).otherwise(F.get("_e", F.lit(2 * i + 1)))
    both = known.join(sketch, keys) if keys else known.join(F.broadcast(sketch))
    below = F.array(*[F.count_if(F.col("_v") < low(i)) for i in range(len(shares))]).alias("_below")
    counted = both.groupBy(*keys).agg(F.first("n").alias("n"), below)
    inside = F.filter(F.array(*[F.when((F.col("_v") >= low(i)) & (F.col("_v") <= high(i)), F.lit(i)) for i in range(len(shares))]), lambda i: i.isNotNull())
    near = both.select(*keys, "_v", F.explode(inside).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_k"))
    placed = near.join(counted, keys) if keys else near.join(F.broadcast(counted))
    last = F.sum("_k").over(Window.partitionBy(*keys, "_i").orderBy("_v")) + F.get("_below", F.col("_i"))
    placed = placed.withColumn("_last", last).withColumn("_rank", F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("_i")) * (F.col("n") - 1) + 1)
    at = lambda r: F.min(F.when(F.col("_last") >= r, F.col("_v")))  # noqa: E731  the first value whose last place is as far
    ranks = F.floor("_rank"), F.ceil("_rank")
    found = placed.groupBy(*keys, "_i").agg(F.first("n").alias("n"), F.first("_rank").alias("_rank"), at(ranks[0]).alias("_a"), at(ranks[1]).alias("_b"))
    each = F.col("_a") + (F.col("_rank") - F.floor("_rank")) * (F.col("_b") - F.col("_a"))
    return found.groupBy(*keys).agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_i", each.alias("q")))), lambda z: z["q"]).alias("q"))


def variance_factor(rows: DataFrame, keys: list[str], sigma: str, residual: str, trim: float = 0.2) -> DataFrame:
    """keys, n, factor: RMS of residual / sigma, a share trimmed at either end if eight remain; 1 below twelve.

    The rows at which trimming begins and ends are found as in quantiles, so no group is sorted whole; equal ratios count alike.
    """
    usable = rows.filter((F.col(sigma) > 1e-9) & F.col(residual).isNotNull()).select(*keys, (F.col(residual) / F.col(sigma)).alias("_r"))
    n = usable.groupBy(*keys).agg(F.count("*").alias("n"))
    cut = F.when(F.col("n") - 2 * F.floor(F.col("n") * trim) < 8, F.lit(0)).otherwise(F.floor(F.col("n") * trim))
    # Around the cuts, ratios are counted one by one; those between the brackets are all inside.
    ends = [max(0.0, trim - 0.01), trim + 0.01, 1 - trim - 0.01, min(1.0, 1 - trim + 0.01)]
    sketch = usable.groupBy(*keys).agg(F.percentile_approx("_r", ends, 1000).alias("_e"))
    e = lambda i: F.get("_e", F.lit(i))
    zone = F.when(F.col("_cut") == 0, 2).when(F.col("n") <= 400, F.when(F.col("_r") <= e(1), 1).otherwise(3)).when(F.col("_r") < e(0), 0).when(F.col("_r") <= e(1), 1).when(F.col("_r") < e(2), 2).when(F.col("_r") <= e(3), 3).otherwise(4)
    marked = usable.join(n.withColumn("_cut", cut), keys).join(sketch, keys).withColumn("_z", zone)
    square = F.col("_r") * F.col("_r")
    sums = marked.groupBy(*keys).agg(F.first("n").alias("n"), F.first("_cut").alias("_cut"), F.sum(F.when(F.col("_z") == 2, square)).alias("_mid"), F.count_if(F.col("_z") == 0).alias("_c0"), F.count_if(F.col("_z") < 3).alias("_c3"))
    edges = marked.filter(F.col("_z").isin(1, 3)).groupBy(*keys, "_z", "_r").agg(F.count("*").alias("_k")).join(sums.select(*keys, "n", "_cut", "_c0", "_c3"), keys)
    last = F.sum("_k").over(Window.partitionBy(*keys, "_z").orderBy("_r")) + F.when(F.col("_z") == 1, F.col("_c0")).otherwise(F.col("_c3"))
    kept = F.greatest(F.lit(0), F.least(last, F.col("n") - F.col("_cut")) - F.greatest(last - F.col("_k"), F.col("_cut")))
    part = edges.withColumn("_kept", kept).groupBy(*keys).agg(F.sum(F.col("_kept") * square).alias("_edge"))
    mean = (F.coalesce("_mid", F.lit(0.0)) + F.coalesce("_edge", F.lit(0.0))) / (F.col("n") - 2 * F.col("_cut"))
    factor = F.greatest(F.lit(0.2), F.least(F.lit(50.0), F.sqrt(mean)))
    return sums.join(part, keys, "left").select(*keys, "n", F.when(F.col("n") < 12, F.lit(1.0)).otherwise(factor).alias("factor"))


def calibration(rows: DataFrame, sigma: str, residual: str, bins: int = 8) -> DataFrame:
    """bin, sigma_pred, residual_rms, n over quantile bins of sigma, closed at both ends, with at least three rows.

    The edges are one row (distinct quantiles), which is joined to all rows; the groups are as many as bins.
    """
    usable = rows.filter(F.col(sigma) > 0)
    edges = quantiles(usable, [], sigma, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("e"))
    edges = edges.select(F.posexplode(F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("lo"), F.slice("e", 2, F.size("e") - 1).alias("hi"))).alias("bin", "z")).select("bin", "z.lo", "z.hi")
    inside = usable.join(F.broadcast(edges), F.col(sigma).between(F.col("lo"), F.col("hi")))
    found = inside.groupBy("bin").agg(F.avg(sigma).alias("sigma_pred"), F.sqrt(F.avg(F.col(residual) * F.col(residual))).alias("residual_rms"), F.count("*").alias("n"))
    return found.filter("n >= 3")


def bootstrap(rows: DataFrame, key: str, value: str, order: str, replicates: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """key, n, mean, lo, hi: percentile interval of the mean over resamples of as many values with replacement.

    Every row counts how often each replicate draws it: a Poisson count of mean 1 at a hash of the row's number (order) and
    the replicate's, with the replicate's mean taken over its own number of draws. So a replicate needs no numbering of the
    rows, no join and no gathering: each task sums its rows into one pair of sums a key and replicate. With one value the
    interval is that value.
    """
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).cast("double").alias("_v"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("_o"))

    def sums(batches):
        held: dict[object, list] = {}
        for batch in batches:
            names, values = batch.column(key).to_pylist(), batch.column("_v").to_numpy()
            codes = batch.column("_o").to_numpy()
            where = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            for w in np.unique(where):
                at = np.flatnonzero(where == w)
                own = held.setdefault(names[at[0]], [np.zeros(replicates), np.zeros(replicates)])
                for part in np.array_split(at, -(-len(at) // 2048)):
                    n = drawn(codes[part], replicates)
                    own[0] += n.sum(axis=0)
                    own[1] += values[part] @ n
        if held:
            reps = np.tile(np.arange(replicates, dtype=np.int32), len(held))
            made = [pa.array([k for k in held for _ in range(replicates)], batch.schema.field(key).type), pa.array(reps), *(pa.array(np.concatenate([h[i] for h in held.values()])) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(made, names=[key, "rep", "n", "s"])

    kind = known.schema[key].dataType.simpleString()
    means = known.mapInArrow(sums, f"`{key}` {kind}, rep int, n double, s double").groupBy(key, "rep").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("_mean"))
    ends = means.groupBy(key).agg(F.percentile("_mean", F.lit(low)).alias("lo"), F.percentile("_mean", F.lit(high)).alias("hi"))
    own = known.groupBy(key).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    alone = F.col("n") == 1
    return own.join(ends, key).select(key, "n", "mean", F.when(alone, F.col("mean")).otherwise(F.col("lo")).alias("lo"), F.when(alone, F.col("mean")).otherwise(F.col("hi")).alias("hi"))


#: Fixed values of the draws: a prime modulus and multipliers, and the distribution function of a Poisson count of mean 1.
PRIME, MULTIPLIERS = 2**31 - 1, (1_000_003, 48_271, 69_621, 16_807)
EDGES = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10))


def drawn(codes: np.ndarray, replicates: int) -> np.ndarray:
    """[row, replicate]: how often each replicate draws a row."""
    rep = np.arange(1, replicates + 1, dtype=np.int64)
    a, b, c, d = MULTIPLIERS
    x = (codes[:, None] % PRIME + rep * a) % PRIME * b % PRIME
    x = (x * x + d) % PRIME
    unit = (x * c + rep * d) % PRIME / float(PRIME)
    return np.searchsorted(np.array(EDGES), unit, "right").astype(np.float64)


def drawn_sql(code: str, rep: str) -> str:
    """The same count in SQL, for integers code >= 0 and rep from 1."""
    a, b, c, d = MULTIPLIERS
    x = f"((({code}) % {PRIME} + {rep} * {a}) % {PRIME} * {b} % {PRIME})"
    unit = f"((({x} * {x} + {d}) % {PRIME} * {c} + {rep} * {d}) % {PRIME} / {float(PRIME)!r})"
    return f"len(list_filter({list(EDGES)!r}::DOUBLE[], lambda e: e <= {unit}))"


def bootstrap_all(rows: DataFrame, key: str, values: list[str], order: str, replicates: int = 1000) -> DataFrame:
    """bootstrap of several columns at once: key, metric, n, mean, lo, hi."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    long = rows.select(key, order, pairs.alias("_p")).select(F.to_json(F.struct(F.col(key).alias("k"), F.col("_p.metric").alias("m"))).alias("_key"), order, F.col("_p.value").alias("_value"))
    found = bootstrap(long, "_key", "_value", order, replicates)
    return found.select(F.get_json_object("_key", "$.k").alias(key), F.get_json_object("_key", "$.m").alias("metric"), "n", "mean", "lo", "hi")


def method_summary(pairs: DataFrame, limits: tuple[float, ...] = (50.0, 100.0, 200.0)) -> DataFrame:
    """One row a method: counts, mean and median error, success rates over known and over all, first three errors."""
    rates = [c for t in limits for c in (success_rate(F.col("rmse"), t).alias(f"sr_ok_{t:g}"), F.avg(F.coalesce((F.col("rmse") <= t).cast("int"), F.lit(0))).alias(f"sr_all_{t:g}"))]
    first = F.array_join(F.slice(F.sort_array(F.collect_set("error")), 1, 3), "; ").alias("errors")
    return pairs.groupBy("method").agg(F.count("*").alias("n_pairs"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.avg("rmse").alias("rmse_mean"), F.median("rmse").alias("rmse_median"), *rates, first)
