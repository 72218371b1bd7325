"""Error and homopolymer profiles of pairwise alignments, Catalyst only. Input: ``read_idx, ref_aln, read_aln``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions import sequences as S

BASES = "ACGT"


def _aligned(pairs: DataFrame, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the letters of both strings; strings of unequal length are an error."""
    equal = F.char_length("ref_aln") == F.char_length("read_aln")
    ref = F.when(equal, F.col("ref_aln")).otherwise(F.raise_error(F.lit("aligned strings of unequal length")))
    return S.let(S.bases(ref), lambda a: S.let(S.bases(F.col("read_aln")), lambda b: body(a, b)))


def error_profile(pairs: DataFrame) -> DataFrame:
    """Per reference position (and one past the end) what was read, and the lengths inserted before it.

    ``insertion`` lists (length, reads), length 0 for the reads without one.
    Each row is taken apart on its own: what was read at each reference base,
    and the run of reference gaps before it. Counts are combined before they
    are shuffled. References that differ are an error; rows with a null string
    are left out.
    """
    spots = _aligned(pairs, lambda a, b: F.zip_with(
        F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("ref"), y.alias("obs"))), lambda x: x["ref"] != "-"),
        F.transform(F.split("ref_aln", "[^-]"), F.char_length),
        lambda x, n: F.struct(x["ref"].alias("ref"), x["obs"].alias("obs"), n.alias("len")),
    ))
    c = pairs.where("ref_aln is not null and read_aln is not null").select(F.posexplode(spots).alias("at", "x"))
    c = c.select((F.col("at") + 1).alias("pos"), "x.ref", "x.obs", "x.len")
    fine = F.col("obs").isNull() | F.col("obs").isin(*BASES, "-")
    c = c.withColumn("obs", F.when(fine, F.col("obs")).otherwise(F.raise_error(F.concat(F.lit("unknown character in alignment: "), "obs"))))
    read = {**{b: b for b in BASES}, "deletion": "-"}
    c = c.groupBy("pos", "len").agg(
        *[F.count_if(F.col("obs") == b).alias(n) for n, b in read.items()], F.count("ref").alias("_bases"), F.count("*").alias("freq"), F.min("ref").alias("_low"), F.max("ref").alias("_high")
    )
    c = c.groupBy("pos").agg(
        *[F.sum(n).alias(n) for n in read], F.sum("_bases").alias("_bases"), F.sum("freq").alias("_all"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
        F.sort_array(F.collect_list(F.struct("len", "freq"))).alias("insertion"),
    )
    unlike = (F.col("_low") != F.col("_high")) | ((F.col("_bases") > 0) & (F.col("_bases") < F.col("_all")))
    base = F.when(unlike, F.raise_error(F.lit("reference sequence should be the same for all alignments"))).otherwise(F.col("_low"))
    return c.select("pos", base.alias("base"), *[F.when(F.col("_bases") > 0, F.col(n)).alias(n) for n in read], "insertion")


def transitions(profile: DataFrame) -> DataFrame:
    """Sums of what was read for each reference base A, C, G, T."""
    return profile.where(F.col("base").isin(*BASES)).groupBy("base").agg(*[F.sum(b).alias(b) for b in BASES])


def homopolymers(seqs: DataFrame, key: str = "read_idx", seq: str = "seq") -> DataFrame:
    """Runs of two or more equal letters after gaps are taken out: ``key, start, width, base``. No shuffle."""
    runs = S.let(S.bases(F.regexp_replace(seq, "-", "")), lambda b: S.runs(b, lambda x: x))
    return seqs.select(key, F.inline(F.filter(runs, lambda r: r["width"] > 1)))


def match_homopolymers(pairs: DataFrame) -> DataFrame:
    """For each reference run the longest read run of its base that meets the run's own columns: ``read_idx, start, width, base, observed``.

    A read run is looked for in the columns of the reference run and the gap
    columns at both sides; gaps inside a read run do not break it. 0 if none.
    Rows with a null string give nothing. No shuffle.
    """

    def of_row(a: Column, b: Column) -> Column:
        bases = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("at"), x.alias("base"))), lambda x: x["base"] != "-")
        return S.let(bases, lambda c: F.transform(F.filter(S.runs(c, lambda x: x["base"]), lambda r: r["width"] > 1), lambda r: around(c, b, r)))

    def around(c: Column, b: Column, r: Column) -> Column:
        column = lambda k: F.get(c, k)["at"]
        first, after = r["start"] - 1, r["start"] - 1 + r["width"]
        left, right = column(first), column(after - 1)
        far_left = F.when(first > 0, column(first - 1) + 1).otherwise(0)
        far_right = F.coalesce(column(after), F.size(b)) - 1
        text = lambda x, y: F.array_join(F.slice(b, x + 1, y - x + 1), "")
        return F.struct(r["start"].alias("start"), r["width"].alias("width"), r["base"].alias("base"), text(far_left, left - 1).alias("pre"), text(left, right).alias("own"), text(right + 1, far_right).alias("post"))

    runs = pairs.where("ref_aln is not null and read_aln is not null").select("read_idx", F.inline(_aligned(pairs, of_row)))
    # + stands for the run's base; the read run may reach from its own columns into the gaps beside them
    marked = {n: F.replace(F.col(n), F.col("base"), F.lit("+")) for n in ("pre", "own", "post")}
    size = lambda x: F.char_length(F.replace(x, F.lit("-"), F.lit("")))
    runs = runs.withColumns({
        "_tail": size(F.regexp_extract(marked["pre"], r"[+-]*$", 0)),
        "_head": size(F.regexp_extract(marked["post"], r"^[+-]*", 0)),
        "_own": F.transform(F.split(marked["own"], r"[^+-]"), size),
    })
    tail, head, own = F.col("_tail"), F.col("_head"), F.col("_own")
    first, last = F.element_at(own, 1), F.element_at(own, -1)
    whole = F.when((first > 0) | ((tail > 0) & (head > 0)), tail + first + head).otherwise(0)
    some = F.greatest(F.when(first > 0, tail + first).otherwise(0), F.when(last > 0, last + head).otherwise(0), F.array_max(own))
    return runs.select("read_idx", "start", "width", "base", F.when(F.size(own) == 1, whole).otherwise(some).alias("observed"))


def outside_homopolymers(profile: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of an error profile whose position no run (``start, width``) covers."""
    covered = runs.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("pos")).distinct()
    return profile.join(covered, "pos", "left_anti")


def homopolymer_profile(pairs: DataFrame) -> DataFrame:
    """Histogram of observed lengths for every run of the reference."""
    seen = match_homopolymers(pairs).groupBy("start", "width", "base", "observed").agg(F.count("*").alias("freq"))
    hist = F.sort_array(F.collect_list(F.struct(F.col("observed").alias("len"), "freq")))
    return seen.groupBy("start", "width", "base").agg(hist.alias("observed"))
