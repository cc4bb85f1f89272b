"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hashed_unit, tidy

#: Up to so many sources, their table of rates is broadcast; it is joined by shuffle beyond that.
BROADCAST_SOURCES = 2_000
#: A mean above this is the sum of several independent Poisson draws of at most this mean.
LARGEST_MEAN = 64.0
#: With means up to LARGEST_MEAN, the distribution's tail beyond so many counts is below 2**-52.
LARGEST_COUNT = 190
#: Copies of a document that one row is exploded into at once.
COPIES = 1000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, size (characters), share (target), rate (mean repetitions of each of its documents).

    rate = share * epochs * (size of all) / size. Shares are the weights over their sum, or, without weights,
    size**power over its sum. A source without text or weight gets rate 0. One row per source; null is a source.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(power)))
    else:
        pairs = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(float(w)))]
        known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0))
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    total = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    share = F.try_divide(F.col("weight"), F.col("all_weight"))
    rate = F.coalesce(F.try_divide(share * F.lit(float(epochs)) * F.col("all_size").cast("double"), F.col("size").cast("double")), F.lit(0.0))
    return sizes.join(F.broadcast(total)).select("source", "size", F.coalesce(share, F.lit(0.0)).alias("share"), rate.alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """rates with draws (independent Poisson draws a document takes) and cdf (the distribution function of one)."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(LARGEST_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(LARGEST_COUNT)), start, step, lambda acc: acc["cdf"])
    return rates.withColumn("draws", draws).withColumn("cdf", cdf)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """The training mix: every document as often as its Poisson draw says, in a global random order.

    A document's count inverts the Poisson distribution of its source's rate at a number hashed from seed, doc_id and
    text, so it is the same in every run and on any cluster; only rows with one doc_id and one text get one count. Adds
    copy (int, from 1) and shuffle_key (string). Rows are dealt to partitions by a hash of shuffle_key and of their place
    in the input (which parts even equal rows) and sorted by shuffle_key in them. Places are fixed for an input that is read from
    files; save one that comes from a shuffle first.
    Null and empty texts have size 0: they don't add to their source's size and are repeated like its others.
    Extra columns are kept; those called copy or shuffle_key are renamed (see base.tidy). No rows: no rows.
    """
    own = ("_source", "_draws", "_cdf", "_text", "_unit", "_count", "_block", "_place")
    docs = tidy(docs, ("doc_id", "text", "source"), ("copy", "shuffle_key", *own))
    table = poisson_table(source_rates(docs, weights, power, epochs)).select(F.col("source").alias("_source"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf"))
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # Numbered where they are read, before any shuffle whose order a repeated task might not meet again.
    known = docs.withColumn("_text", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("_place", F.monotonically_increasing_id())
    drawn = known.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("_source")))
    drawn_at = lambda draw: hashed_unit(F.lit(seed), F.col("doc_id"), F.col("_text"), draw)
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_draws")),
        F.lit(0),
        lambda n, draw: n + F.size(F.filter(F.col("_cdf"), lambda c: c <= drawn_at(draw))),
    )
    # A document's draw is hashed once where it takes a single one, as all rates up to LARGEST_MEAN do.
    unit = F.when(F.col("_draws") == 1, drawn_at(F.lit(1)))
    once = F.size(F.filter(F.col("_cdf"), lambda c: c <= F.col("_unit")))
    counted = drawn.withColumn("_unit", unit).withColumn("_count", F.when(F.col("_draws") == 1, once).otherwise(count)).drop("_source", "_draws", "_cdf", "_unit").filter("_count > 0")
    # In two steps, so that no row holds more than COPIES numbers however high its source's rate is.
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / COPIES).cast("int"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("_block") * COPIES + 1, F.least("_count", (F.col("_block") + 1) * COPIES)))).drop("_count", "_block")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text"), F.col("copy").cast("string")).cast("binary"))
    dealt = copies.withColumn("shuffle_key", key).drop("_text")
    return dealt.repartition(F.xxhash64("shuffle_key", "_place")).drop("_place").sortWithinPartitions("shuffle_key")


def op2_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to shares that follow the square root of each source's size."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in SQL; rates above LARGEST_MEAN don't occur with square-root shares of so few sources.
OP2_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source
), weighted AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), 0.5) ELSE 0.0 END AS weight FROM sizes
), rates AS (
  SELECT source, coalesce(weight / nullif((SELECT sum(weight) FROM weighted), 0) * 1.0 * CAST((SELECT sum(size) FROM weighted) AS DOUBLE) / nullif(CAST(size AS DOUBLE), 0), 0.0) AS rate FROM weighted
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < {LARGEST_COUNT}
), lists AS (
  SELECT source, list(c) AS cs FROM cdf GROUP BY source
), drawn AS (
  SELECT d.*, len(list_filter(l.cs, lambda c: c <= CAST(('0x' || substr(md5('7|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(coalesce(d.text, '')) || '|1'), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
), copies AS (
  SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
  md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM copies
"""
