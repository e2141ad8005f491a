"""Connected components of an edge table.

Up to FEW edges are 2 MB, which one task joins in memory. More are joined by alternating star contractions: each round
links every node's larger neighbours to its smallest one, then the smaller ones, until nothing moves. The edge count
never grows, and rounds grow with the logarithm of the longest path. Hubs are pre-aggregated by the minimum and joined
with salts. Tables are written between rounds. Both ways give the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, many_to_one

FEW = 1 << 17


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the edges between a and b."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def components(ws: Workspace, edges: DataFrame, name: str, few: int = FEW) -> DataFrame:
    """(node, comp) for every node of edges(a, b), a written table: comp is the smallest node reachable."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if edges.count() <= few:

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*(np.concatenate(c) for c in zip(*parts, strict=True)))], ["node", "comp"])

        return ws.table(now.coalesce(1).mapInArrow(join, "node long, comp long"), name)
    now = ws.table(now.distinct(), f"{name}0")
    k, last = 0, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = ws.table(many_to_one(both, least, ["u"]).where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}down{k}")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = many_to_one(down, low, ["u"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = ws.table(small.distinct(), f"{name}{k + 1}")
        ws.drop(f"{name}{k}")
        ws.drop(f"{name}down{k}")
        mark = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        now, k = after, k + 1
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
