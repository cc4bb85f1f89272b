"""Connected components: a distributed loop, and a NumPy form for the links of one batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (a, b: long).

    Every round a node takes the least label around it, then the label of that label, so that labels travel
    twice as far each time. Links and labels are tables in the shared folder; both sides of each join are
    plain shuffles of such tables, which adaptive execution can split where one node has very many links.
    """
    pairs = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "ba", "aa", "bb")]))
    edges = scratch.save(pairs.select(ends.alias("e")).select("e.u", "e.v").distinct())
    labels = scratch.save(edges.groupBy("u").agg(F.min("v").alias("label")))
    while True:
        far = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.u")).select(F.col("x.u").alias("node"), F.col("y.label").alias("far"))
        own = F.min(F.when(F.col("u") == F.col("v"), F.col("far")))
        around = edges.join(far, F.col("v") == F.col("node")).groupBy("u").agg(F.min("far").alias("label"), own.alias("before"))
        found = scratch.save(around)
        done = found.filter("label < before").isEmpty()
        scratch.drop(labels)
        labels = found
        if done:
            # Where no node has a smaller label beside it, all labels of a component are equal; labels are members.
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link a node, from it to the smallest node it reaches, with the same components as the links."""
    if not len(a):
        return a, b
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        later = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(later, at, least)
        later = later[later]
        if (later == label).all():
            break
        label = later
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]
