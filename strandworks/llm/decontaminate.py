"""Benchmark decontamination: SimHash over item-sized windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, semi_join, text_of, with_row_key

#: Bits of a fingerprint and the Hamming radius. At similarity 0.8 two bags agree in 8/9 of their shingles, the
#: distance has mean 9.7 and deviation 2.9, and the radius lies more than four and a half deviations above.
BITS, RADIUS = 64, 23


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words by position; fewer words give an empty array."""
    n = F.size(words) - size + 1
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), run)).otherwise(F.array().cast("array<long>"))


def with_shingles(df: DataFrame, size: int, name: str) -> DataFrame:
    """Replaces ``_sw_text`` by the hashes of its shingles. Words and hashes are projections of their own."""
    words = F.regexp_extract_all(ascii_lower(text_of("_sw_text")), F.lit(WORD), F.lit(0))
    return df.withColumn("_sw_text", words).withColumn(name, shingle_hashes(F.col("_sw_text"), size)).drop("_sw_text")


def simhash(hashes: Column) -> Column:
    """Bit i is set if more of the shingles, counted with repeats, have it set than not."""
    bits = []
    for i in range(BITS):
        vote = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)  # noqa: B023
        bits.append(F.shiftleft(F.when(vote > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i))
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def blocks() -> list[tuple[int, int]]:
    """(first bit, width) of RADIUS + 1 blocks that tile the bits: fingerprints within RADIUS agree in one at least."""
    n = RADIUS + 1
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def block_keys(fingerprint: Column, length: Column) -> Column:
    """One key for each block: its number, its bits and the length of the item."""
    bits = lambda at, width: F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), F.xxhash64(F.lit(i), length, bits(*b)).alias("key")) for i, b in enumerate(blocks())])


def first_equal_block(xor: Column) -> Column:
    """The first block in which two fingerprints agree, given their exclusive or; null if none."""
    mask = lambda at, width: F.lit((((1 << width) - 1) << at) - ((1 << BITS) if at + width == BITS else 0))
    return F.coalesce(*[F.when(xor.bitwiseAND(mask(*b)) == 0, F.lit(i)) for i, b in enumerate(blocks())])


def with_bag(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds a set that stands for the bag: each hash with the number of its earlier repeats."""
    df = df.withColumn(name, F.array_sort(hashes))
    ranked = F.transform(name, lambda h, i: F.xxhash64(h, i - F.array_position(F.col(name), h)))
    return df.withColumn(name, F.when(F.size(F.array_distinct(name)) == F.size(name), F.transform(name, lambda h: F.xxhash64(h, F.lit(-1).cast("long")))).otherwise(ranked))


def shared_needed(both: Column, percent: int) -> Column:
    """The least intersection of two bags of ``both`` shingles together whose weighted Jaccard reaches ``percent`` / 100."""
    return F.ceil(both * percent / F.lit(100 + percent) - F.lit(1e-9)).cast("int")


def window_starts(at: Column, need: Column, width: Column, n: Column) -> Column:
    """Starts of the windows of ``width`` of ``n`` places that hold ``need`` of the ascending places ``at``; each once.

    The windows that hold places i to i + need - 1 but not place i - 1 start in one range.
    """

    def starts(i: Column) -> Column:
        first = F.greatest(F.lit(0), F.get(at, i + need - 1) - width + 1, F.coalesce(F.get(at, i - 1) + 1, F.lit(0)))
        last = F.least(F.get(at, i), n - width)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), starts))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Passages of documents that repeat benchmark items.

    1. A window can be similar to an item only if enough of its shingles of
       ``size`` words are the item's. Documents and items meet by shingle, and
       of the windows as long as the item those get a fingerprint, at any
       start, that hold as many places with a shingle of the item as
       ``percent`` asks for. Which item it was is not kept.
    2. Windows and items get a 64-bit SimHash. The fingerprints are cut into
       RADIUS + 1 blocks, and windows meet the items of their length by an
       equi-join on a block's bits, which finds all pairs within the radius. A
       pair is taken in its first equal block.
    3. Pairs within the radius are verified: weighted Jaccard of the two bags
       of shingles (sum of minima / sum of maxima of the counts).

    Returns one row per distinct row (doc_id and text) of ``docs`` and item
    whose similarity reaches ``percent`` / 100: the best window's
    ``similarity``, ``start_word``, ``n_words`` and ``hamming``, with
    ``doc_id, item_id`` and the document's row key ``_sw_k1, _sw_k2``. Words
    are runs of non-blanks, A-Z lower-cased.

    Defined cases: null and short texts match nothing; an item under ``size``
    words has no shingle and matches nothing; repeated items each match; rows
    that repeat a document match once; a document shorter than an item is one
    window; empty tables give an empty result; other columns are left out.

    The items' shingles are broadcast up to a checked number and joined above
    it by a shuffle whose large partitions AQE splits, and so are the items.
    Only shared shingles, the starts of proposed windows, their block keys and
    documents that have some are shuffled otherwise.
    """
    base = with_row_key(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), "_sw_k1", "_sw_k2", F.col(text).alias("_sw_text"))
    items = with_shingles(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_sw_text")), size, "_sw_ih")
    items = items.distinct().where(F.size("_sw_ih") > 0)
    items = items.withColumn("_sw_fp", simhash(F.col("_sw_ih"))).withColumn("_sw_item", F.xxhash64("item_id", "_sw_ih"))
    items = cut(items.withColumn("_sw_l", F.size("_sw_ih")))
    grams = items.select("_sw_item", "_sw_l", F.explode(F.array_distinct("_sw_ih")).alias("_sw_g"))
    few = (items.agg(F.sum("_sw_l")).first()[0] or 0) <= GRAMS
    held = F.broadcast if few else lambda df: df
    places = with_shingles(base, size, "_sw_h").select(
        "_sw_k1", "_sw_k2", F.size("_sw_h").alias("_sw_n"), F.posexplode_outer("_sw_h").alias("_sw_pos", "_sw_g")
    )
    hits = places.join(held(grams), "_sw_g")
    hits = hits.groupBy("_sw_k1", "_sw_k2", "_sw_item", "_sw_l", "_sw_n").agg(F.sort_array(F.collect_set("_sw_pos")).alias("_sw_at"))
    hits = hits.withColumn("_sw_w", F.least("_sw_n", "_sw_l")).withColumn("_sw_need", shared_needed(F.col("_sw_w") + F.col("_sw_l"), percent))
    hits = cut(hits.where(F.size("_sw_at") >= F.col("_sw_need")))
    starts = hits.withColumn("_sw_start", F.explode(window_starts(F.col("_sw_at"), F.col("_sw_need"), F.col("_sw_w"), F.col("_sw_n"))))
    starts = starts.select("_sw_k1", "_sw_k2", "_sw_l", "_sw_w", "_sw_start").distinct()
    touched = cut(hits.select("_sw_k1", "_sw_k2").distinct())
    bodies = semi_join(base, touched, ["_sw_k1", "_sw_k2"]).dropDuplicates(["_sw_k1", "_sw_k2"])
    windows = starts.join(with_shingles(bodies, size, "_sw_h"), ["_sw_k1", "_sw_k2"])
    window = ["_sw_k1", "_sw_k2", "_sw_l", "_sw_start"]
    windows = windows.select("doc_id", *window, F.slice("_sw_h", F.col("_sw_start") + 1, F.col("_sw_w")).alias("_sw_wh"))
    windows = cut(windows.withColumn("_sw_wfp", simhash(F.col("_sw_wh"))))
    keys = lambda fp: F.inline(block_keys(F.col(fp), F.col("_sw_l")))
    probes = windows.select(*window, "_sw_wfp", keys("_sw_wfp"))
    index = items.select("item_id", "_sw_item", "_sw_fp", keys("_sw_fp"))
    xor = F.col("_sw_wfp").bitwiseXOR(F.col("_sw_fp"))
    met = probes.join(held(index), ["block", "key"])
    met = met.where((F.bit_count(xor) <= RADIUS) & (first_equal_block(xor) == F.col("block")))
    met = met.select(*window, "_sw_item", F.bit_count(xor).alias("hamming"))
    met = met.join(windows.drop("_sw_wfp"), window).join(held(items.select("item_id", "_sw_item", "_sw_ih")), "_sw_item")
    met = with_bag(with_bag(met, "_sw_wh", "_sw_x"), "_sw_ih", "_sw_y")
    met = met.withColumn("_sw_i", F.size(F.array_intersect("_sw_x", "_sw_y")))
    met = met.withColumn("_sw_u", F.size("_sw_x") + F.size("_sw_y") - F.col("_sw_i")).where(F.col("_sw_i") * 100 >= F.col("_sw_u") * percent)
    best = F.max(
        F.struct(
            (F.col("_sw_i") / F.col("_sw_u")).alias("similarity"),
            (-F.col("_sw_start")).alias("at"),
            (F.size("_sw_wh") + size - 1).alias("n_words"),
            "hamming",
        )
    ).alias("_sw_best")
    out = met.groupBy("_sw_k1", "_sw_k2", "doc_id", "item_id").agg(best)
    b = F.col("_sw_best")
    return out.select(
        "_sw_k1", "_sw_k2", "doc_id", "item_id", b["similarity"].alias("similarity"), (-b["at"]).alias("start_word"), b["n_words"].alias("n_words"), b["hamming"].alias("hamming")
    )


#: Shingles of items that are broadcast at most: about 64 MB.
GRAMS = 1_000_000


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that repeat a benchmark item; columns and null cases as in :func:`contaminated`."""
    bad = cut(contaminated(docs, benchmark, text, doc_id, **options).select("_sw_k1", "_sw_k2").distinct())
    return semi_join(with_row_key(docs, doc_id, text), bad, ["_sw_k1", "_sw_k2"], "left_anti").drop("_sw_k1", "_sw_k2")
