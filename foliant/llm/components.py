"""Connected components of a link graph by alternating large-star and small-star rounds.

Only DataFrame joins and aggregates; each round's links are checkpointed.  A hub is met through its
smallest neighbour alone, so no group is gathered.  Up to SMALL links, counted first, are settled in
one task instead: rounds over a few links cost more in tasks than in work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, map_arrow

SMALL = 100_000


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after the links between positions i and j, and those links that tied components together."""
    parent, used = np.arange(len(label)), []
    a, b = label[i], label[j]
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            break
        a, b, i, j = a[apart], b[apart], i[apart], j[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        parent[high[first]] = low[first]
        used.append(np.stack([i[first], j[first]], 1))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    return parent[label], np.concatenate(used) if used else np.empty((0, 2), np.int64)


def least_of_few(links: DataFrame) -> DataFrame:
    """The same as `least_members`, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parts = [[b.column(k).to_numpy() for b in batches] for batches in [list(batches)] for k in (0, 1)]
        if parts[0]:
            a, b = (np.concatenate(p) for p in parts)
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            label, _ = united(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
            root = nodes[label]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root != nodes]), pa.array(root[root != nodes])], ["node", "root"])

    return map_arrow(links.select("v", "u").repartition(1), "node long, root long", run)


def least_members(links: DataFrame, small: int = SMALL) -> DataFrame:
    """For links (a, b) of longs: each node that has a smaller one in its component (node), and the least (root)."""
    spark = links.sparkSession
    now = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    now, state = checkpoint(spark, now), None
    if now.count() <= small:
        return checkpoint(spark, least_of_few(now))
    while True:
        # Large star: larger neighbours of a node are tied to the least of it and its neighbours.
        least = now.groupBy("v").agg(F.min("u").alias("m"))
        larger = now.join(least.withColumnRenamed("v", "u"), "u", "left").select("v", F.coalesce("m", "u").alias("u"))
        # Small star: a node and its smaller neighbours are tied to the least of them.
        tied = larger.join(larger.groupBy("v").agg(F.min("u").alias("m")), "v")
        small_star = tied.select(F.col("v"), F.col("m").alias("u")).union(tied.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")))
        now = checkpoint(spark, small_star.distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = seen
