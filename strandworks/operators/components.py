"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.scratch import cut, free

#: Edges that one task labels alone: 16 MB.
SMALL = 1 << 20


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each can reach; roots are hooked to smaller ones and paths are halved."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, comps = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comps)], ["node", "comp"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``(node, comp)``: the smallest node reachable, for every node of an edge ``(a, b)`` of longs with a <> b.

    Above ``small`` edges, every round links each node to its smallest
    neighbour, follows the links twice and contracts, so the rounds are
    logarithmic in number and made of aggregations and equi-joins over the
    edges that are left. What remains below ``small`` is labelled in one task.
    The labels do not depend on ``small``. Loops and null ends are left out.
    """
    live = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while True:
        done = live.count() <= small
        if done:
            parent = cut(live.coalesce(1).mapInArrow(_label, "node long, comp long"))
        else:
            ends = live.select("a", "b").union(live.select("b", "a"))
            link = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("p"))
            parent = cut(link.join(link.toDF("p", "comp"), "p").select("node", "comp"))
        if labels is None:
            new = parent
        else:
            new = cut(labels.toDF("node", "was").join(parent.toDF("was", "now"), "was", "left").select("node", F.coalesce("now", "was").alias("comp")))
        if done:
            free(live)
            return new
        left = live.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b").where("pa <> pb")
        left = cut(left.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
        free(live, *[t for t in (labels, parent) if t is not None and t is not new])
        live, labels = left, new
