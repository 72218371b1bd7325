"""Grouping reads by molecular identifiers within an edit distance."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from strandworks.functions import sequences as S
from strandworks.operators.components import components
from strandworks.scratch import cut


def masked_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance of each pair, in which any pairing with N costs one half, N with N included.

    One row of the table of all pairs at a time, in half units; gaps along the
    row are a running minimum.
    """
    la, lb = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    x, y = (np.array([list(t.ljust(n)) for t in side], "U1").reshape(len(side), n) for side, n in ((a, la.max(initial=0)), (b, lb.max(initial=0))))
    step = 2 * np.arange(y.shape[1] + 1)
    row = np.repeat(step[None], len(a), axis=0)
    out = row[np.arange(len(a)), lb].astype(float)
    for i in range(x.shape[1]):
        seen = x[:, i : i + 1]
        cost = np.where((seen == "N") | (y == "N"), 1, 2 * (seen != y))
        new = row + 2
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + cost)
        row = np.minimum.accumulate(new - step, axis=1) + step
        ended = la == i + 1
        out[ended] = row[ended, lb[ended]]
    return out / 2


def masked_distance(a: str, b: str) -> float:
    """The distance of one pair."""
    return float(masked_distances([a], [b])[0])


def distance(a: Column, b: Column) -> Column:
    """Built-in where neither side has an N."""

    @F.pandas_udf("double")
    def _masked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(masked_distances(x.tolist(), y.tolist()), dtype=float)

    return F.when(~a.contains("N") & ~b.contains("N"), F.levenshtein(a, b).cast("double")).otherwise(_masked(a, b))


def near_texts(texts: DataFrame, limits: dict[str, int], payload: list[str]) -> DataFrame:
    """Pairs of distinct identifiers of a ``pre_group`` within the limits, each pair once, one with itself included.

    Lengths that differ by more than the limit can not be near, so pairs meet
    on their length. Only pairs with an N leave the JVM. ``payload`` columns
    come back as ``<name>_a`` and ``<name>_b``.
    """
    k1 = limits["umi1"]
    side = lambda s: [F.col(n).alias(f"{n}_{s}") for n in [*limits, *payload]]
    left = texts.withColumn("_len", F.explode(F.sequence(F.char_length("umi1") - k1, F.char_length("umi1") + k1)))
    left = left.select("pre_group", "_len", *side("a"))
    right = texts.select("pre_group", F.char_length("umi1").alias("_len"), *side("b"))
    order = lambda s: F.struct(*[F.col(f"{n}_{s}") for n in limits])
    pairs = left.join(right, ["pre_group", "_len"]).where(order("a") <= order("b"))
    for n, k in limits.items():
        a, b = F.col(f"{n}_a"), F.col(f"{n}_b")
        plain = ~a.contains("N") & ~b.contains("N")
        # the bounded built-in gives -1 beyond the limit
        pairs = pairs.where(~plain | (F.levenshtein(a, b, k) >= 0))
    for n, k in limits.items():
        a, b = F.col(f"{n}_a"), F.col(f"{n}_b")
        pairs = pairs.where(distance(a, b) <= k)
    return pairs


def _limits(threshold1: float, threshold2: float | None) -> dict[str, int]:
    return {"umi1": math.floor(threshold1)} | ({"umi2": math.floor(threshold2)} if threshold2 is not None else {})


def neighbours(umis: DataFrame, threshold1: float = 3, threshold2: float | None = None) -> DataFrame:
    """Pairs ``(pre_group, a, b)`` of read_idx within the thresholds, both orders and a read with itself included.

    ``umis`` has ``read_idx, pre_group, umi1[, umi2]``. Equal identifiers are
    compared once, and joined to their reads afterwards. Lengths that differ
    by more than the threshold can not be near, so pairs meet on their length.
    Thresholds are floored. A read is its own neighbour unless its Ns put it
    beyond the threshold.
    """
    limits = _limits(threshold1, threshold2)
    texts = umis.groupBy("pre_group", *limits).agg(F.collect_list("read_idx").alias("reads"))
    pairs = near_texts(texts, limits, ["reads"])
    flat = pairs.select("pre_group", F.explode("reads_a").alias("a"), "reads_b").select("pre_group", "a", F.explode("reads_b").alias("b"))
    return flat.unionByName(flat.select("pre_group", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def greedy_clusters(links: dict[int, set[int]], weight: dict[int, int] | None = None, last: dict[int, int] | None = None) -> list[list[int]]:
    """Star clusters: lone nodes first, then again and again the node with the most free neighbours, the largest of equals.

    A node may stand for ``weight`` equal reads, of which ``last`` is the
    largest: they have the same neighbours and are always taken together.
    """
    weight, last = weight or dict.fromkeys(links, 1), last or {n: n for n in links}
    out = [[n] for n, near in sorted(links.items()) if near <= {n}]
    free = {n for n, near in links.items() if not near <= {n}}
    count = {n: sum(weight[m] for m in links[n] & free) for n in free}
    # entries with an outdated count are skipped when they come up; counts only fall
    heap = [(-c, -last[n], n) for n, c in count.items()]
    heapq.heapify(heap)
    while free:
        c, _, centre = heapq.heappop(heap)
        if centre not in free:
            continue
        if -c != count[centre]:
            heapq.heappush(heap, (-count[centre], -last[centre], centre))
            continue
        members = (links[centre] & free) | {centre}
        out.append(sorted(members))
        free -= members
        for m in members:
            for other in links[m] & free:
                count[other] -= weight[m]
    return out


def cluster_texts(pairs: DataFrame) -> DataFrame:
    """``node, cluster_id``: greedy star clusters of the pairs ``node_a, node_b`` with ``weight_``, ``last_`` of each end.

    Nodes stand for the reads of one identifier and are named after the
    smallest. Connected components do not touch, so they are clustered on
    their own; a node that is paired with itself alone needs no Python.
    """
    pairs = cut(pairs)
    labels = components(pairs.where("node_a <> node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    rows = pairs.join(labels.toDF("node_a", "comp"), "node_a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        weight: dict[int, int] = {}
        last: dict[int, int] = {}
        for a, b, wa, wb, ta, tb in zip(*(pdf[f"{n}_{s}"].tolist() for n in ("node", "weight", "last") for s in "ab"), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            weight |= {a: wa, b: wb}
            last |= {a: ta, b: tb}
        return pd.DataFrame([(n, c[0]) for c in greedy_clusters(near, weight, last) for n in c], columns=["node", "cluster_id"])

    many = rows.groupBy("comp").applyInPandas(run, "node long, cluster_id long")
    alone = pairs.where("node_a = node_b").select(F.col("node_a").alias("node")).join(labels, "node", "left_anti")
    return many.unionByName(alone.select("node", F.col("node").alias("cluster_id")))


def umi_group(reads: DataFrame, threshold1: float = 3, threshold2: float | None = None, max_error: float | None = None, kind: str = "phred") -> DataFrame:
    """Clusters reads within their ``pre_group`` (all in one where the column is absent).

    With ``max_error``, ``umi1`` (and ``umi2``) are masked by ``qual1`` (``qual2``) first.
    Equal identifiers are one node with a weight, so m equal reads make one
    row and not m * m. A read whose identifier is null is a cluster of its
    own; null groups are one group.
    """
    df = reads if "pre_group" in reads.columns else reads.withColumn("pre_group", F.lit(""))
    limits = _limits(threshold1, threshold2)
    if max_error is not None:
        df = df.withColumns({n: S.quality_mask(F.col(n), F.col(n.replace("umi", "qual")), max_error, kind) for n in limits})
    group = F.coalesce(F.concat(F.lit("="), F.col("pre_group")), F.lit(""))
    df = cut(df.select(F.col("read_idx").cast("long").alias("read_idx"), group.alias("pre_group"), *limits))
    # an N costs one half even against itself, so many of them put a read beyond the limit from all, itself included
    masks = {n: (F.char_length(n) - F.char_length(F.replace(F.col(n), F.lit("N"), F.lit("")))) / 2 for n in limits}
    beyond = functools.reduce(lambda x, y: x | y, [masks[n].isNull() | (masks[n] > k) for n, k in limits.items()])
    texts = df.where(~beyond).groupBy("pre_group", *limits)
    texts = cut(texts.agg(F.min("read_idx").alias("node"), F.max("read_idx").alias("last"), F.count("*").alias("weight")))
    clusters = cluster_texts(near_texts(texts, limits, ["node", "last", "weight"]))
    named = texts.join(clusters, "node").select("pre_group", *limits, "cluster_id")
    grouped = df.where(~beyond).join(named, ["pre_group", *limits]).select("cluster_id", "read_idx")
    return grouped.unionByName(df.where(beyond).select(F.col("read_idx").alias("cluster_id"), "read_idx"))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one row of equal width for each, and the texts' lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.array(texts, f"U{max(size.max(initial=0), 1)}").view(np.uint32).reshape(len(texts), -1), size


def distance_tiles(a: list[str], b: list[str], room: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray]]:
    """Masked edit distances of every text of ``a`` with every one of ``b``: tiles with the places of their first texts.

    The table of all pairs of a tile goes a cell at a time, in half units of the
    smallest type that holds them; a row of it fills about ``room`` bytes.
    """
    (x, la), (y, lb) = _letters(a), _letters(b)
    seen, code = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    x, y = code[: x.size].reshape(x.shape), code[x.size :].reshape(y.shape)
    most = 2 * int(max(la.max(initial=0), lb.max(initial=0))) + 2
    kind = np.min_scalar_type(most)
    cost = np.where(np.eye(len(seen), dtype=bool), 0, 2).astype(kind)
    cost[seen == ord("N")] = cost[:, seen == ord("N")] = 1
    wide = max(1, room // (kind.itemsize * (int(lb.max(initial=0)) + 1)))
    for q in range(0, len(b), wide):
        n = lb[q : q + wide]
        costs = [cost[:, letter] for letter in y[q : q + wide, : n.max()].T]
        high = max(1, wide // len(n))
        for p in range(0, len(a), high):
            m = la[p : p + high]
            out = np.empty((len(m), len(n)), kind)
            row = [np.full(out.shape, 2 * j, kind) for j in range(n.max() + 1)]
            step = np.empty_like(out)
            for i in range(m.max() + 1):
                if i:
                    letter, before = x[p : p + high, i - 1], row[0].copy()
                    row[0] += kind.type(2)
                    for j, c in enumerate(costs, 1):
                        np.take(c, letter, axis=0, out=step, mode="clip")
                        step += before
                        before, row[j] = row[j], before
                        np.minimum(before, row[j - 1], out=row[j])
                        row[j] += kind.type(2)
                        np.minimum(row[j], step, out=row[j])
                if (ended := np.flatnonzero(m == i)).size:
                    for j in np.unique(n):
                        at = np.ix_(ended, np.flatnonzero(n == j))
                        out[at] = row[j][at]
            yield p, q, out


#: Rows of a block of texts, and pairs of blocks that one task takes.
BLOCK, BLOCK_PAIRS = 1024, 4


def _block_pairs(kind: pa.DataType):
    """For mapInArrow over (whether a block meets itself, its ids and texts, the other's ids and texts): ``i, j, dist``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py()
                ids, other = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 3))
                a, b = (batch.column(c)[k].values.to_pylist() for c in (2, 4))
                if same:
                    b, other = a, ids
                lost, lost_b = (np.array([t is None for t in side], bool) for side in (a, b))
                for p, q, half in distance_tiles([t or "" for t in a], [t or "" for t in b]):
                    i, j = ids[p : p + len(half), None], other[None, q : q + half.shape[1]]
                    wanted = i != j
                    if same:
                        wanted &= np.arange(p, p + half.shape[0])[:, None] < np.arange(q, q + half.shape[1])
                    none = lost[p : p + half.shape[0], None] | lost_b[q : q + half.shape[1]]
                    pick = (lambda z: z.ravel()) if wanted.all() else (lambda z, w=wanted: z[w])
                    dist = pa.array(pick(half / 2), mask=pick(none) if none.any() else None)
                    yield pa.RecordBatch.from_arrays([*(pa.array(pick(f(i, j)), kind) for f in (np.minimum, np.maximum)), dist], ["i", "j", "dist"])

    return run


def expected_distances(seqs: DataFrame, max_error: float | None = None, kind: str = "phred") -> DataFrame:
    """Masked edit distances of all pairs ``i < j`` of a small set (quadratic by definition): ``i, j, dist``.

    Rows are dealt to blocks, and every pair of blocks is worked out at once
    in numpy, spread over the cluster. A row whose ``read_idx`` is null has no
    pairs; the distance from a null sequence is null.
    """
    df = seqs if max_error is None else seqs.withColumn("seq", S.quality_mask(F.col("seq"), F.col("qual"), max_error, kind))
    df = cut(df.where("read_idx is not null").select("read_idx", "seq", F.monotonically_increasing_id().alias("_row")))
    n = max(1, math.ceil(df.count() / BLOCK))
    blocks = df.groupBy((F.col("_row") % n).alias("at")).agg(F.collect_list(F.struct("read_idx", "seq")).alias("r"))
    side = lambda s: blocks.select(F.col("at").alias(f"at_{s}"), F.col("r.read_idx").alias(f"id_{s}"), F.col("r.seq").alias(f"seq_{s}"))
    met = side("a").join(side("b"), F.col("at_a") <= F.col("at_b"))
    met = met.select((F.col("at_a") == F.col("at_b")).alias("same"), "id_a", "seq_a", "id_b", "seq_b").repartition(math.ceil(n * (n + 1) / 2 / BLOCK_PAIRS))
    idx = df.schema["read_idx"].dataType
    return met.mapInArrow(_block_pairs(to_arrow_type(idx)), StructType([StructField("i", idx), StructField("j", idx), StructField("dist", DoubleType())]))
