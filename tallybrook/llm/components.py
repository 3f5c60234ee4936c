"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each half round is one aggregation by node and one join back, so a hub's links are pre-aggregated before the shuffle and
its join side can be split at run time. Each round is written to the shared folder; the loop ends when a round changes
nothing. A table of few links is contracted by one task, without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_arrow, materialize, over, tidy

#: Links that one task contracts, at most; bounds its memory.
AT_ONCE = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each node and the least one of its component."""
    node, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(node))
    while len(apart := np.flatnonzero(label[a] != label[b])):
        x, y = label[a[apart]], label[b[apart]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # roots meet
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    other = np.flatnonzero(label != np.arange(len(node)))
    return node[other], node[label[other]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)]) for b in batches]
    if ends:
        yield pa.RecordBatch.from_arrays([*map(pa.array, stars(*np.concatenate(ends, axis=1)))], names=["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v. Large: every larger neighbour of u is linked to u's least neighbour. Small: u and its
    smaller neighbours are linked to the least of these."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link between two different nodes; root is the component's least node. Loops,
    repeated links and links with a null end don't matter; an empty table gives no rows."""
    links = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v and u is not null and v is not null").distinct(), "links")
    few = links.count() <= AT_ONCE
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    before = None if few else state(links)
    while True:
        last, links = links, materialize(links.repartition(1).transform(in_arrow, _contracted, "u long, v long") if few else _star(_star(links, True), False), "links")
        forget(last)
        if few or (after := state(links)) == before:
            break
        tidy(links.sparkSession)
        before = after
    return over(links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), links)
