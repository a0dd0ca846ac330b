"""Connected components of an edge table; nothing is collected.

Each task first reduces its edges to a forest. One task joins the forests where they are few; else large-star and
small-star steps do, to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import forget, stored

#: Edges that a task turns into a forest at a time, and those that one task joins (16 bytes each); beyond them the star steps take over.
FOREST_EDGES, ONE_TASK = 1 << 20, 1 << 21


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """u, v of edges that join what the given ones (u, v) join: one for each node that isn't the least of its component among `most` edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        node, least = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return node[node != least], least[node != least]

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= most:
            u, v = reduced()
            held, n = [(u, v)], len(u)
            if n > most // 2:  # hardly any edge was one too many
                yield out(u, v)
                held, n = [], 0
    if held:
        yield out(*reduced())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all edges."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, least = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component: for each node of the edges (a, b) the least node that it reaches.

    Each star step is an aggregate and a join, which split over a hub's neighbours; every round is stored in
    the shared folder, so lineage stays short. Goes on until a round changes no edge, however many that takes:
    each round but the last lowers a label, so there is an end.
    """
    most = FOREST_EDGES
    loose = edges.select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v")).filter("u <> v")
    cur = stored(loose.mapInArrow(lambda batches: _forest(batches, most), "u bigint, v bigint"), "edges")
    if cur.count() <= ONE_TASK:
        return cur.coalesce(1).mapInArrow(_joined, "node bigint, component bigint")
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        old, cur = cur, stored(small, "edges")
        forget(old)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
