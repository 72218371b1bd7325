"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of, with_row_key

#: Documents a shard holds about, and shards a source has at most: at 1e10 documents of one source, a shard has 1e7.
SHARD_DOCS, MAX_SHARDS = 4096, 1024
#: Rows of the plan, about 100 bytes each, that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
RESULT = ["size", "source_size", "target", "taken", "copies"]


def n_words(text: Column) -> Column:
    """Words of a text: its runs of non-blanks."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """Targets of ``(_sw_source, source_size)`` rows, one per source.

    Sources sorted by code point, null last, take ``weights`` in turn. The
    level at which ``weight * level`` spends ``share`` of all sizes while no
    source exceeds ``max_repeats`` times its size is found in one pass over
    the sources sorted by cap / weight.
    """
    by_name = Window.orderBy(F.col("_sw_source").asc_nulls_last())
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    t = sizes.withColumn("_sw_w", w).withColumn("_sw_cap", F.col("source_size") * float(max_repeats))
    by_level = Window.orderBy((F.col("_sw_cap") / F.col("_sw_w")), F.col("_sw_source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("_sw_cap").over(before), F.lit(0.0))
    open_w = F.sum("_sw_w").over(everything) - F.coalesce(F.sum("_sw_w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * float(share) - capped) / open_w
    t = t.withColumn("_sw_level", level)
    fits = F.col("_sw_cap") >= F.col("_sw_level") * F.col("_sw_w")
    t = t.withColumn("_sw_fit", F.when(fits, F.struct(F.col("_sw_cap") / F.col("_sw_w"), F.col("_sw_level").alias("at"))))
    t = t.withColumn("_sw_found", F.min("_sw_fit").over(everything)["at"])
    target = F.least(F.col("_sw_cap"), F.coalesce(F.col("_sw_found") * F.col("_sw_w"), F.col("_sw_cap")))
    return t.select(*sizes.columns, target.alias("target"))


def sainte_lague(parties: DataFrame, votes: Column, seats: Column, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``_sw_quota``: seats by highest quotients votes / (2k + 1).

    Within each group ``by``, all seats that surely win (quotients above a
    divisor that yields too few) are given at once; only the seats between
    that divisor and one that yields too many, two per party at most, are
    ranked by their quotients, ties by ``order``. So the rows ranked depend on
    the number of parties and not of seats.
    """
    g = Window.partitionBy(*by)
    p = parties.withColumns({"_sw_v": votes.cast("double"), "_sw_s": seats.cast("double")})
    p = p.withColumns({"_sw_n": F.count("*").over(g), "_sw_t": F.sum("_sw_v").over(g)})
    few = F.greatest(F.col("_sw_s") - F.col("_sw_n") / 2 - 1, F.lit(0.0)) / F.col("_sw_t")
    many = (F.col("_sw_s") + F.col("_sw_n") / 2 + 1) / F.col("_sw_t")
    live = F.col("_sw_t") > 0
    p = p.withColumns(
        {
            "_sw_lo": F.when(live, F.floor(F.col("_sw_v") * few + 0.5)).otherwise(0).cast("long"),
            "_sw_hi": F.when(live, F.floor(F.col("_sw_v") * many + 0.5)).otherwise(0).cast("long"),
        }
    )
    p = p.withColumn("_sw_rest", F.col("_sw_s") - F.sum("_sw_lo").over(g))
    k = F.explode_outer(F.when(F.col("_sw_hi") > F.col("_sw_lo"), F.sequence(F.col("_sw_lo"), F.col("_sw_hi") - 1)))
    keys = [*by, *order]
    ranked = p.select("*", k.alias("_sw_k")).withColumn(
        "_sw_q", F.when(F.col("_sw_k").isNotNull(), F.col("_sw_v") / (F.col("_sw_k") * 2 + 1))
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_sw_q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order], "_sw_k"))
    won = F.sum(F.when(F.col("_sw_q").isNotNull() & (F.col("_sw_place") <= F.col("_sw_rest")), 1).otherwise(0))
    kept = [c for c in parties.columns if c not in keys]
    return (
        ranked.withColumn("_sw_place", place)
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in kept], (F.first("_sw_lo") + won).cast("long").alias("_sw_quota"))
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    max_block: int = 1024,
    seed: str = "mix",
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """How many words of each document a mix with the target weights takes.

    1. Targets per source (:func:`source_targets`).
    2. Every source is dealt by a seeded hash into shards of about 4,096
       documents (at most 1,024 shards). A shard's documents, in seeded
       order, form a line of words that is cut into blocks of ``B`` words, its
       last one shorter. ``B`` is the smallest positive target / 256, between
       1 and ``max_block``, so that rounding stays small for every source.
    3. Sainte-Lague apportions round(sum of targets / B) blocks to the sources,
       votes being targets, then each source's quota to its shards, votes
       being shard sizes.
    4. A shard of n blocks and quota q takes block k as often as
       floor(((k + 1) q + u) / n) - floor((k q + u) / n), u in [0, n) seeded: a
       systematic sample of exactly q blocks in the seeded order. The words
       of a document in taken blocks follow in closed form from its place on
       the line; blocks are never rows.

    Returns the input columns plus ``size, source_size, target, taken`` and
    ``copies``. ``taken`` never exceeds ``max_repeats`` times size. ``copies``
    is the whole-document form of the decision: how often the block at the
    document's middle word is taken (0 for documents without words).

    Defined cases: null text has size 0 and is taken 0 times; null is a source
    of its own, sorted last; repeated rows are neighbours on the line, each with
    its own part; an empty table gives an
    empty result; clashing input columns are replaced.
    """
    base = with_row_key(docs, doc_id, text).withColumns(
        {"_sw_source": F.col(source).cast("string"), "size": n_words(text_of(text))}
    )
    salt = F.pmod(F.xxhash64(F.lit(seed), "_sw_k1", "_sw_k2"), F.lit(MAX_SHARDS)).cast("int")
    base = base.withColumn("_sw_salt", salt).drop("source_size", "target", "taken", "copies")
    cells = base.groupBy("_sw_source", "_sw_salt").agg(F.sum("size").alias("_sw_cell"), F.count("*").alias("_sw_docs"))
    plan = cut(shard_plan(cells, weights, share, max_repeats, max_block, seed))
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    line = base.join(plan, F.col("_sw_source").eqNullSafe(F.col("_sw_name")) & (F.col("_sw_salt") == F.col("_sw_at")))
    spread = F.xxhash64(F.lit(seed), F.lit("order"), "_sw_k1", "_sw_k2")
    upto = (
        Window.partitionBy("_sw_source", "_sw_shard")
        .orderBy(spread, "_sw_k1", "_sw_k2")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    line = line.withColumn("_sw_end", F.sum("size").over(upto)).withColumn("_sw_start", F.expr("_sw_end - size"))
    blocks_before = "(({x} div _sw_b) * _sw_quota + _sw_u) div _sw_blocks"
    times = f"({blocks_before.format(x='({x} + _sw_b)')} - {blocks_before})"
    words_before = f"(_sw_b * ({blocks_before}) + {times} * ({{x}} % _sw_b))"
    taken = f"{words_before.format(x='_sw_end')} - {words_before.format(x='_sw_start')}"
    middle = times.format(x="(_sw_start + size div 2)")
    return line.withColumns(
        {"taken": F.expr(taken).cast("long"), "copies": F.when(F.col("size") > 0, F.expr(middle)).otherwise(0).cast("int")}
    ).select(*[c for c in docs.columns if c not in RESULT], *RESULT)


def shard_plan(cells: DataFrame, weights: Sequence[float], share: float, max_repeats: int, max_block: int, seed: str) -> DataFrame:
    """Targets, block size and quotas: one row for each source and salt ``_sw_at``."""
    everything = Window.partitionBy()
    sizes = cells.groupBy("_sw_source").agg(F.sum("_sw_cell").alias("source_size"), F.sum("_sw_docs").alias("_sw_docs"))
    targets = source_targets(sizes, weights, share, max_repeats)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    targets = targets.withColumns(
        {
            "_sw_b": F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(F.coalesce(least, F.lit(0.0)) / 256))).cast("long"),
            "_sw_shards": F.least(F.lit(MAX_SHARDS), F.ceil(F.col("_sw_docs") / SHARD_DOCS)).cast("int"),
            "_sw_all": F.lit(1),
        }
    )
    targets = targets.withColumn("_sw_seats", F.round(F.sum("target").over(everything) / F.col("_sw_b")))
    quotas = sainte_lague(targets, F.col("target"), F.col("_sw_seats"), ["_sw_all"], ["_sw_source"])
    quotas = quotas.drop("_sw_all", "_sw_seats", "_sw_docs").withColumnsRenamed({"_sw_source": "_sw_name", "_sw_quota": "_sw_of_source"})
    shards = (
        cells.join(quotas, F.col("_sw_source").eqNullSafe(F.col("_sw_name")))
        .withColumn("_sw_shard", F.pmod("_sw_salt", "_sw_shards"))
        .groupBy("_sw_name", "_sw_shard", "source_size", "target", "_sw_b", "_sw_of_source", "_sw_shards")
        .agg(F.sum("_sw_cell").alias("_sw_t"))
    )
    dealt = sainte_lague(shards, F.col("_sw_t"), F.col("_sw_of_source"), ["_sw_name"], ["_sw_shard"])
    n = F.greatest(F.ceil(F.col("_sw_t") / F.col("_sw_b")), F.lit(1)).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed), "_sw_name", "_sw_shard"), F.col("_sw_blocks"))
    salts = F.sequence(F.col("_sw_shard"), F.lit(MAX_SHARDS - 1), F.col("_sw_shards"))
    return (
        dealt.withColumn("_sw_blocks", n)
        .withColumn("_sw_quota", F.least(F.col("_sw_quota"), F.col("_sw_blocks") * max_repeats))
        .withColumns({"_sw_u": start, "_sw_at": F.explode(salts)})
        .select("_sw_name", "_sw_at", "_sw_shard", "source_size", "target", "_sw_b", "_sw_quota", "_sw_blocks", "_sw_u")
    )
