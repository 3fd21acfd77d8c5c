"""Connected components of an edge table, as rounds of joins (large star, small star), or in one task if there are few edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.session import staged


FEW_EDGES = 100_000


def _print(stars: DataFrame) -> tuple:
    """Count and hash of the edges: equal if nothing changed."""
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of the few edges of one task."""
    edges = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")]) for b in batches]
    pairs = np.concatenate([np.zeros((2, 0), np.int64), *edges], axis=1)
    nodes, ends = np.unique(pairs, return_inverse=True)
    (u, v), root = ends.reshape(pairs.shape), np.arange(len(nodes))  # nodes ascend, so the smallest number is the smallest node
    while True:
        least = root.copy()
        np.minimum.at(least, root[u], root[v])
        np.minimum.at(least, root[v], root[u])
        least = least[least[root]]
        if (least == root).all():
            break
        root = least
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that can be reached, for all nodes of ``edges`` (a, b).

    Up to ``FEW_EDGES`` different edges go to one task, which saves a dozen rounds over next to nothing; the result is the same.
    Each round hangs the neighbours of a node below the smallest of them; the number of rounds grows with
    the logarithm of the largest component. A node's neighbours are only ever aggregated to their minimum
    and joined, so a node with very many edges is no large group in one task.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before = staged(stars, "edges"), None
    if stars.count() <= FEW_EDGES:
        return staged(stars.coalesce(1).mapInArrow(_joined, "node bigint, root bigint"), "components")
    while (now := _print(stars)) != before:
        before = now
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # neighbours above a node go below the smallest neighbour of the node, or below itself
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # and so do those below it
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        stars = staged(small, "small")
    roots = stars.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return staged(roots.unionAll(tops), "components")
