"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a candidate block and of a query block: a task holds one of each.
BLOCK_ROWS, QUERY_ROWS = 4096, 2048
#: Candidates with the largest norms whose products give every query its first lower bound; broadcast, about 2 MB.
SEED_ROWS = 1024
#: Buckets per doubling of the norm, and coordinates looked at by coordinate pruning.
PER_DOUBLING, FOCUS = 8, 3
#: Coordinate pruning is chosen from this local cosine threshold on; below it its bounds are too wide to pay.
COORDINATE_FROM = 0.7


def integer_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``_sw_v``: floor(scale * x) of every component, in doubles; rows without a full finite vector go."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return df.where(F.col(vector).isNotNull() & whole).withColumn("_sw_v", scaled)


def norm_bucket(norm2: Column) -> Column:
    return F.when(norm2 > 0, F.floor(F.log2(norm2) * (PER_DOUBLING / 2))).otherwise(-1).cast("int")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_block(cand: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
    """Yields (query, ids, scores) of each query's best candidates in one block that may reach its top k.

    ``floor`` holds a score that the query's k-th best is known to reach. The
    block's local cosine threshold for a query is floor / (norm of the query *
    largest norm of the block). Above 1 the block can't matter. From
    COORDINATE_FROM on, the few largest coordinates of the query bound those
    of any vector within the angle, and only vectors inside all bounds are
    multiplied out. Otherwise those whose length alone allows the score are.
    """
    norms = np.sqrt((cand * cand).sum(1))
    order = np.argsort(-norms, kind="stable")
    cand, ids, norms = cand[order], ids[order], norms[order]
    unit = cand / np.maximum(norms, 1e-300)[:, None]
    top = norms[0] if len(norms) else 0.0
    for q, qid, least in zip(queries, query_ids, floor, strict=True):
        length = float(np.sqrt((q * q).sum()))
        if len(norms) == 0 or least > 0 and length * top < least * (1 - 1e-9):
            continue
        if least > 0 and length > 0:
            reach = int(np.searchsorted(-norms, -least * (1 - 1e-9) / length, "right"))
            local = min(1.0, least * (1 - 1e-9) / (length * top))
            if local >= COORDINATE_FROM:
                direction = q / length
                inside = np.ones(reach, bool)
                for f in np.argsort(-np.abs(direction))[:FOCUS]:
                    mid, half = direction[f] * local, np.sqrt(max(0.0, (1 - local * local) * (1 - direction[f] ** 2)))
                    # a wider angle moves both bounds outwards, but never past the sphere
                    lo = -1.0 if direction[f] < 0 and -direction[f] >= local else mid - half
                    hi = 1.0 if direction[f] >= local else mid + half
                    inside &= (unit[:reach, f] >= lo - 1e-9) & (unit[:reach, f] <= hi + 1e-9)
                at = np.flatnonzero(inside)
            else:
                at = np.arange(reach)
        else:
            at = np.arange(len(ids))
        at = at[ids[at] != qid]
        scores = cand[at] @ q
        if least > -np.inf:
            fit = scores >= least
            at, scores = at[fit], scores[fit]
        if len(at):
            best = best_of(scores, ids[at], k)
            yield qid, ids[at[best]], scores[best]


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 20, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k highest integer inner products of each query row with every other row.

    Queries are the rows whose id is divisible by ``every``; candidates all
    rows but the query's own id. Returns ``query_id, rank, vec_id, score``,
    ties to the smaller vec_id.

    Candidates are grouped by length into geometric buckets, each cut into
    blocks of about BLOCK_ROWS. A bounded seed of the longest vectors gives
    every query a floor under its k-th score, and so a length below which no
    candidate can matter: blocks of about QUERY_ROWS queries are filled in the
    order of that length. Query blocks and buckets meet only where the bucket
    is long enough, which is known before any vector is copied. Each pair of blocks is one task
    (:func:`search_block`); each yields at most k rows a query, and the last
    step ranks those.

    Defined cases: rows with a null id, or a null vector or one with null or
    non-finite components, take no part; vectors of another dimension than a
    query's are compared over none (they take part only among their own);
    repeated ids are candidates each, never for a query of the same id; fewer
    than k candidates give all; empty vectors score 0; an empty table gives an
    empty result; other columns are left out.
    """
    spark = vectors.sparkSession
    base = integer_vectors(vectors.select(F.col(vec_id).cast("long").alias("_sw_id"), F.col(vector).alias("_sw_x")), "_sw_x", scale)
    base = base.where("_sw_id is not null").select("_sw_id", "_sw_v", F.size("_sw_v").alias("_sw_dim"))
    norm2 = F.aggregate("_sw_v", F.lit(0.0), lambda a, x: a + x * x)
    base = cut(base.withColumn("_sw_n2", norm2).withColumn("_sw_bucket", norm_bucket(F.col("_sw_n2"))))
    seed = base.orderBy(F.desc("_sw_n2"), "_sw_id").limit(SEED_ROWS).select("_sw_id", "_sw_v", "_sw_dim").toPandas()
    held = {d: (np.stack(g["_sw_v"].to_numpy()), g["_sw_id"].to_numpy()) for d, g in seed.groupby("_sw_dim") if d}
    shared = spark.sparkContext.broadcast(held)

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = np.full(len(pdf), -np.inf)
            for i, (qid, v, dim) in enumerate(zip(pdf["_sw_id"], pdf["_sw_v"], pdf["_sw_dim"], strict=True)):
                if dim in shared.value:
                    m, ids = shared.value[dim]
                    s = (m @ v)[ids != qid]
                    if len(s) >= k:
                        low[i] = np.partition(s, len(s) - k)[len(s) - k]
            yield pdf.assign(_sw_floor=low)

    queries_in = base.where(F.col("_sw_id") % every == 0).select("_sw_id", "_sw_v", "_sw_dim", "_sw_n2")
    queries = queries_in.mapInPandas(floors, "_sw_id long, _sw_v array<double>, _sw_dim int, _sw_n2 double, _sw_floor double")
    # the square of the least length that matters, a little lower for rounding
    least = F.col("_sw_floor") * F.col("_sw_floor") / F.col("_sw_n2") * (1 - 1e-6)
    queries = cut(queries.withColumn("_sw_from", F.when((F.col("_sw_floor") > 0) & (F.col("_sw_n2") > 0), norm_bucket(least)).otherwise(-1)))

    # query blocks are filled in the order of that length, so that few of them reach down to short vectors
    by_length = Window.partitionBy("_sw_dim").orderBy("_sw_from").rowsBetween(Window.unboundedPreceding, -1)
    groups = queries.groupBy("_sw_dim", "_sw_from").agg(F.count("*").alias("_sw_n"))
    groups = groups.withColumn("_sw_before", F.coalesce(F.sum("_sw_n").over(by_length), F.lit(0)))  # a row per bucket
    place = F.col("_sw_before") + F.pmod(F.xxhash64("_sw_id", "_sw_v"), F.col("_sw_n"))
    queries = queries.drop("_sw_n2").join(groups, ["_sw_dim", "_sw_from"]).withColumn("_sw_q", F.floor(place / QUERY_ROWS)).drop("_sw_n", "_sw_before")
    reach = queries.groupBy("_sw_dim", "_sw_q").agg(F.min("_sw_from").alias("_sw_from"))
    sizes = base.groupBy("_sw_dim", "_sw_bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_sw_blocks"))
    # a row per bucket and block of queries
    meet = cut(sizes.join(reach, "_sw_dim").where("_sw_bucket >= _sw_from").drop("_sw_from"))
    cand = base.select("_sw_id", "_sw_v", "_sw_dim", "_sw_bucket").join(meet, ["_sw_dim", "_sw_bucket"])
    cand = cand.withColumn("_sw_block", F.pmod(F.xxhash64("_sw_id", "_sw_v"), "_sw_blocks").cast("int")).drop("_sw_blocks")
    queries = queries.drop("_sw_from").join(meet, ["_sw_dim", "_sw_q"])
    queries = queries.withColumn("_sw_block", F.explode(F.sequence(F.lit(0), F.col("_sw_blocks") - 1))).drop("_sw_blocks")
    key = ["_sw_dim", "_sw_bucket", "_sw_block", "_sw_q"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            m, qs = np.stack(left["_sw_v"].to_numpy()), np.stack(right["_sw_v"].to_numpy())
            floor = right["_sw_floor"].to_numpy(float)
            found = search_block(m, left["_sw_id"].to_numpy(), qs, right["_sw_id"].to_numpy(), floor, k)
            out = [(int(q), int(i), int(s)) for q, ids, scores in found for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    local = cand.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
