"""Thresholds and rank statistics, Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.scratch import cut


def running(counts: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds ``<column>_below`` and ``<column>_all``: sums over the rows of a ``by`` with a smaller ``order``, and over all of them.

    ``order`` is distinct within ``by``. Rows are spread by ranges, summed per
    range, and only the ranges of one ``by`` meet in a window; rows meet the
    rows of their own range.
    """
    ranged = cut(counts.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in columns])
    before, whole = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sums = sums.select(*by, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns], *[F.sum(c).over(whole).alias(f"{c}_all") for c in columns])
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("x._range") == F.col("y._range")
    for c in by:
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    rows = ranged.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).alias("x").join(sums.alias("y"), same)
    kept = [F.col(f"x.{c}") for c in counts.columns]
    return rows.select(*kept, *[(F.col(f"x.{c}_below") + F.col(f"y._{c}")).alias(f"{c}_below") for c in columns], *[F.col(f"y.{c}_all") for c in columns])


def _real_and_fake(scores: DataFrame, by: list[str]) -> DataFrame:
    counts = scores.groupBy(*by, "score").agg(F.count_if(~F.col("fake")).alias("real"), F.count_if("fake").alias("fakes"))
    return running(counts, by, "score", ["real", "fakes"])


def fdr_threshold(scores: DataFrame, error: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """Smallest real score at which the scrambled share above it is ``error`` at most.

    ``scores`` has ``fake`` and ``score``, which are first counted per value.
    No scores at all give a null, or no row where there is a ``by``.
    """
    by = by or []
    t = _real_and_fake(scores, by)
    # of equal real scores the first has the most others at or above it, and so the lowest share
    rest = F.col("real_all") - F.col("real_below") - 1
    fakes_above = F.col("fakes_all") - F.col("fakes_below") - F.col("fakes")
    hit = (F.col("real") > 0) & (rest > 0) & (fakes_above <= F.lit(error) * rest)
    return t.groupBy(*by).agg(F.min(F.when(hit, F.col("score"))).alias("threshold"))


def tied_overlap(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of (real, fake) pairs in which the real score is higher; ties count half."""
    by = by or []
    t = _real_and_fake(scores, by).withColumn("_won", F.col("real") * (F.col("fakes_below") + F.col("fakes") / 2))
    pairs = F.sum("real") * F.sum("fakes")
    return t.groupBy(*by).agg(F.when(pairs > 0, F.sum("_won") / pairs).alias("overlap"))


def exact_median(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: the middle value, or the mean of the two in the middle; nulls are left out."""
    counts = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    t, last = running(counts, [], "v", ["n"]), F.col("n_all") - 1
    at = lambda k: F.max(F.when((F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n")), F.col("v")))
    return t.agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias(name))


def barcode_thresholds(barcoded: DataFrame, nmads: float = 3) -> DataFrame:
    """Median less ``nmads`` scaled median deviations, of score and gap."""
    level = lambda m, d: F.col(m) - F.lit(1.4826 * nmads) * F.col(d)
    out = []
    for c in ("score", "gap"):
        mid = cut(exact_median(barcoded, F.col(c), "_m"))
        away = barcoded.crossJoin(F.broadcast(mid))  # one row on the right
        spread = exact_median(away, F.abs(F.col(c) - F.col("_m")), "_d")
        out.append(mid.crossJoin(spread).select(level("_m", "_d").alias(c)))
    return out[0].crossJoin(out[1])


def adaptor_scores(reads: DataFrame, p, seed: int = 0, aligned: DataFrame | None = None) -> DataFrame:
    """Real and scrambled scores of both adaptors on the strand found: ``adaptor, fake, score``.

    With ``aligned`` the strand and the real scores are taken from there; a
    read that it does not name is an error. The windows are written down once,
    on their strand.
    """
    from .alignment import score_only, scrambled, strand_scores, windows

    ends = windows(reads, p.tolerance)
    if aligned is None:
        ends = strand_scores(ends, p)
        pick = lambda a, b: F.when(F.col("reversed"), F.col(b)).otherwise(F.col(a))
        ends = ends.withColumns({"_real1": pick("_fs", "_rs"), "_real2": pick("_fe", "_re")})
    else:
        known = aligned.select("read_name", "reversed", F.col("adaptor1.score").alias("_real1"), F.col("adaptor2.score").alias("_real2"))
        ends = ends.drop("reversed").join(known, "read_name", "left")
        missing = F.raise_error(F.concat(F.lit("read not aligned: "), F.col("read_name")))
        ends = ends.withColumn("reversed", F.when(F.col("reversed").isNull(), missing).otherwise(F.col("reversed")))
    side = lambda c: F.when(F.col("reversed"), F.col("_back" + c)).otherwise(F.col("_front" + c))
    other = lambda c: F.when(F.col("reversed"), F.col("_front" + c)).otherwise(F.col("_back" + c))
    ends = cut(ends.select("read_idx", "_real1", "_real2", side("").alias("_s1"), side("_q").alias("_q1"), other("").alias("_s2"), other("_q").alias("_q2")))
    out = None
    for n, adaptor in ((1, p.adaptor1), (2, p.adaptor2)):
        rows = scrambled(ends, seed + n, (f"_s{n}", f"_q{n}")).select(score_only(adaptor, F.col(f"_s{n}"), F.col(f"_q{n}"), p.settings).alias("score"))
        for fake, scores in ((False, ends.select(F.col(f"_real{n}").alias("score"))), (True, rows)):
            scores = scores.select(F.lit(n).alias("adaptor"), F.lit(fake).alias("fake"), "score")
            out = scores if out is None else out.unionByName(scores)
    return out


def adaptor_thresholds(reads: DataFrame, p, error: float = 0.01, seed: int = 0, aligned: DataFrame | None = None) -> DataFrame:
    """``adaptor, threshold``; :func:`adaptor_scores` gives the scores behind them."""
    return fdr_threshold(adaptor_scores(reads, p, seed, aligned), error, ["adaptor"])
