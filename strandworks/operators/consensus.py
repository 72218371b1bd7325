"""Consensus of multiple alignments, Catalyst only. Input: ``group_id, aln array<string>[, quals array<string>]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions import sequences as S

BASES = "ACGT"
#: Errors are clipped to this distance from 0 and 1.
CLIP = 1e-8


def columns_of(msa: DataFrame, with_quality: bool, kind: str = "phred") -> DataFrame:
    """One row per group, row and column: ``group_id, n_rows, row, pos, base[, e]``."""
    widths = F.array_distinct(F.transform("aln", F.char_length))
    bad = F.size(widths) > 1
    aln = F.when(bad, F.raise_error(F.lit("alignment rows of unequal width"))).otherwise(F.col("aln"))
    df = msa.withColumn("aln", aln).select("group_id", F.size("aln").alias("n_rows"), F.posexplode_outer("aln").alias("row", "s"), *["quals"] * with_quality)
    df = df.where("s is not null")
    letters = F.transform(S.bases(F.col("s")), lambda x, i: F.struct(i.alias("pos"), x.alias("base")))
    if not with_quality:
        df = df.select("group_id", "n_rows", "row", F.inline(letters))
        known = F.col("base").isin(*BASES, "N", "-")
        return df.withColumn("base", F.when(known, F.col("base")).otherwise(F.raise_error(F.concat(F.lit("unknown character in alignment: "), "base"))))
    df = df.withColumn("q", F.get("quals", "row"))
    short = F.coalesce(F.char_length(F.regexp_replace("s", "-", "")) != F.char_length("q"), F.lit(True))
    q = F.when(short, F.raise_error(F.lit("quality and alignment differ in length"))).otherwise(F.col("q"))
    cell = lambda x, q: F.struct(x["pos"].alias("pos"), x["base"].alias("base"), q.alias("q"))
    seen = F.zip_with(F.filter(letters, lambda x: x["base"] != "-"), S.bases(q), cell)
    gaps = F.transform(F.filter(letters, lambda x: x["base"] == "-"), lambda x: cell(x, F.lit(None).cast("string")))
    df = df.select("group_id", "n_rows", "row", F.inline(F.concat(seen, gaps)))
    e = F.when(F.col("base") != "-", F.greatest(F.least(S.error_of(F.col("q"), kind), F.lit(1 - CLIP)), F.lit(CLIP)))
    return df.withColumn("e", e).drop("q")


def assembled(picked: DataFrame, groups: DataFrame) -> DataFrame:
    """Strings from kept columns ``group_id, pos, base, log_error``; groups without any get empty ones."""
    order = F.sort_array(F.collect_list(F.struct("pos", "base", "log_error")))
    out = picked.groupBy("group_id").agg(order.alias("c"))
    out = groups.select("group_id").join(out, "group_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<pos:int,base:string,log_error:double>>")))
    logs = F.transform("c", lambda x: x["log_error"])
    return out.select("group_id", F.array_join(F.transform("c", lambda x: x["base"]), "").alias("seq"), S.phred_string(logs).alias("qual"), logs.alias("log_error"))


def basic_consensus(msa: DataFrame, min_coverage: float = 0.6, pseudo_count: float = 1) -> DataFrame:
    """Most frequent base (the first of A, C, G, T on ties) of every column covered by enough rows.

    N counts as coverage and not as evidence. A kept column without evidence
    and without pseudo count has error 1.
    """
    c = columns_of(msa, False)
    counts = {b: F.count_if(F.col("base") == b) for b in BASES}
    g = c.groupBy("group_id", "pos").agg(F.first("n_rows").alias("n"), F.count_if(F.col("base") != "-").alias("seen"), *[x.alias(b) for b, x in counts.items()])
    g = g.where(F.col("seen") >= F.col("n") * min_coverage)
    top, total = F.greatest(*BASES), sum((F.col(b) for b in BASES), F.lit(0))
    g = g.withColumns({"_top": top, "_total": total})
    right = (F.col("_top") + pseudo_count / 4) / (F.col("_total") + float(pseudo_count))
    log_error = F.when(F.col("_total") + float(pseudo_count) > 0, F.when(right < 1, F.log1p(-right)).otherwise(F.lit(float("-inf")))).otherwise(0.0)
    return assembled(g.select("group_id", "pos", _first_max().alias("base"), log_error.alias("log_error")), msa)


def _first_max():
    out = F.lit("T")
    for b in reversed(BASES[:-1]):
        out = F.when(F.col(b) == F.col("_top"), F.lit(b)).otherwise(out)
    return out


def quality_consensus(msa: DataFrame, min_coverage: float = 0.6, kind: str = "phred") -> DataFrame:
    """Most probable base of every covered column, weighing each base by its error.

    Sums are compared to nine decimals, as the order of a distributed sum is not fixed.
    """
    c = columns_of(msa, True, kind)
    right, wrong = F.log1p(-F.col("e")), F.log(F.col("e") / 3)
    sums = {b: F.sum(F.when(F.col("base").isin(*BASES), F.when(F.col("base") == b, right).otherwise(wrong)).otherwise(0.0)) for b in BASES}
    g = c.groupBy("group_id", "pos").agg(F.first("n_rows").alias("n"), F.count_if(F.col("base") != "-").alias("seen"), *[x.alias(b) for b, x in sums.items()])
    g = g.where(F.col("seen") >= F.col("n") * min_coverage).withColumns({b: F.round(b, 9) for b in BASES})
    g = g.withColumn("_top", F.greatest(*BASES))
    g = g.withColumn("_sorted", F.sort_array(F.array(*BASES)))
    # probabilities relative to the largest; the best one is left out of the error
    rel = F.transform("_sorted", lambda x: F.exp(x - F.col("_top")))
    g = g.withColumn("_rel", rel).withColumn("_second", F.get("_sorted", F.lit(2)))
    others = F.log(F.aggregate(F.slice("_sorted", 1, 3), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_second")))) + F.col("_second")
    everything = F.log(F.aggregate("_rel", F.lit(0.0), lambda a, x: a + x)) + F.col("_top")
    return assembled(g.select("group_id", "pos", _first_max().alias("base"), (others - everything).alias("log_error")), msa)


def consensus_reads(msa: DataFrame, min_coverage: float = 0.6, pseudo_count: float = 1, kind: str = "phred") -> DataFrame:
    """With qualities the quality consensus, without the basic one."""
    if "quals" in msa.columns:
        return quality_consensus(msa, min_coverage, kind)
    return basic_consensus(msa, min_coverage, pseudo_count)
