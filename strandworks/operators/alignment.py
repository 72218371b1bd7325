"""Alignment operators as Arrow-batched UDFs, and the read pipeline that stands on them."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions import sequences as S
from strandworks.scratch import cut

from . import kernel as K


def score_only(adaptor: str, seq: Column, qual: Column, settings: K.Settings) -> Column:
    """Score of a read window against the adaptor; no traceback is kept."""
    ref = adaptor.upper()

    @F.pandas_udf("double")
    def run(s: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(K.scores(ref, s.tolist(), q.tolist(), settings))

    return run(seq, qual)


def adaptor_struct(adaptor: str, seq: Column, qual: Column, settings: K.Settings) -> Column:
    """``score, start, end, subseq``: where the adaptor lies, and the read bases under its ambiguous runs."""
    ref, runs = adaptor.upper(), S.ambiguous_runs(adaptor)
    subs = ", ".join(f"Sub{n + 1}: struct<seq: string, qual: string>" for n in range(len(runs)))
    schema = "score double, start int, end int" + (f", subseq struct<{subs}>" if runs else "")

    @F.pandas_udf(schema)
    def run(s: pd.Series, q: pd.Series) -> pd.DataFrame:
        seqs, quals, out = s.tolist(), q.tolist(), []
        for text, marks, (score, spans) in zip(seqs, quals, K.traced(ref, seqs, quals, settings), strict=True):
            row = {"score": score, **dict(zip(("start", "end"), spans.whole(), strict=True))}
            if runs:
                row["subseq"] = {}
                for n, (first, last) in enumerate(runs):
                    start, width = spans.section(first, last, len(text))
                    row["subseq"][f"Sub{n + 1}"] = {"seq": text[start - 1 : start - 1 + width], "qual": marks[start - 1 : start - 1 + width]}
            out.append(row)
        return pd.DataFrame(out, columns=["score", "start", "end", *["subseq"] * bool(runs)])

    return run(seq, qual)


def quality_align(df: DataFrame, reference: str, opening: float = 5, extension: float = 1, edit_only: bool = False, seq: str = "seq", qual: str = "qual", kind: str = "phred", iupac: str = "compat") -> DataFrame:
    """Global alignment of each read: adds ``score, edit`` and, unless ``edit_only``, ``reference, query``."""
    ref = reference.upper()
    settings = K.Settings(opening, extension, False, kind, iupac)

    @F.pandas_udf("score double, edit int, reference string, query string")
    def run(s: pd.Series, q: pd.Series) -> pd.DataFrame:
        seqs, out = s.tolist(), []
        for text, (score, spans) in zip(seqs, K.traced(ref, seqs, q.tolist(), settings), strict=True):
            a, b = spans.gapped(ref, text)
            out.append((score, sum(x != y for x, y in zip(a, b, strict=True)), a, b))
        return pd.DataFrame(out, columns=["score", "edit", "reference", "query"])

    out = df.withColumn("_aln", run(F.col(seq), F.col(qual)))
    names = ["score", "edit"] if edit_only else ["score", "edit", "reference", "query"]
    return out.select(*df.columns, *[F.col(f"_aln.{n}").alias(n) for n in names])


@dataclass(frozen=True)
class AlignParams:
    """What a later step must know about how reads were aligned; it travels beside the rows."""

    adaptor1: str
    adaptor2: str
    tolerance: int = 250
    opening: float = 5
    extension: float = 1
    kind: str = "phred"
    iupac: str = "compat"

    @property
    def settings(self) -> K.Settings:
        return K.Settings(self.opening, self.extension, True, self.kind, self.iupac)


def windows(reads: DataFrame, tolerance: int) -> DataFrame:
    """Cuts the ends off before any Python sees the reads; back windows are reverse-complemented."""
    seq, qual = F.col("seq"), F.col("qual")
    return reads.withColumns(
        {
            "_front": S.front_window(seq, tolerance),
            "_front_q": S.front_window(qual, tolerance),
            "_back": S.back_window(seq, tolerance),
            "_back_q": S.back_quality(qual, tolerance),
        }
    )


def strand_scores(ends: DataFrame, p: AlignParams) -> DataFrame:
    """Scores of both adaptors against both ends, and the strand they speak for."""
    df = ends.withColumns(
        {
            f"_{name}": score_only(adaptor, F.col(f"_{side}"), F.col(f"_{side}_q"), p.settings)
            for name, adaptor, side in (("fs", p.adaptor1, "front"), ("fe", p.adaptor2, "back"), ("rs", p.adaptor1, "back"), ("re", p.adaptor2, "front"))
        }
    )
    return df.withColumn("reversed", S.is_reversed(F.col("_fs"), F.col("_fe"), F.col("_rs"), F.col("_re")))


def adaptor_align(reads: DataFrame, p: AlignParams) -> DataFrame:
    """``read_idx, read_name, read_width, reversed, adaptor1, adaptor2`` for each read.

    Four score-only passes settle the strand; only the two winning windows are
    traced back. Adaptor 2 is counted from the read's start, so its start
    exceeds its end.
    """
    df = strand_scores(windows(reads, p.tolerance), p)
    pick = lambda a, b: F.when(F.col("reversed"), F.col(b)).otherwise(F.col(a))
    df = df.withColumns({"_s1": pick("_front", "_back"), "_q1": pick("_front_q", "_back_q"), "_s2": pick("_back", "_front"), "_q2": pick("_back_q", "_front_q")})
    df = df.withColumns({f"_a{n}": adaptor_struct(a, F.col(f"_s{n}"), F.col(f"_q{n}"), p.settings) for n, a in ((1, p.adaptor1), (2, p.adaptor2))})
    width = F.char_length("seq")
    a2 = F.col("_a2").withField("start", width - F.col("_a2.start") + 1).withField("end", width - F.col("_a2.end") + 1)
    return df.select("read_idx", "read_name", width.alias("read_width"), "reversed", F.col("_a1").alias("adaptor1"), a2.alias("adaptor2"))


def filter_reads(aligned: DataFrame, score1: float, score2: float, essential1: bool = True, essential2: bool = True) -> DataFrame:
    """Keeps reads whose essential adaptors reach their scores and that have over one base left; adds the trim range."""
    ok = lambda n, t: F.col(f"adaptor{n}.score") >= float(t)
    df = aligned
    if essential1:
        df = df.where(ok(1, score1))
    if essential2:
        df = df.where(ok(2, score2))
    start = F.when(ok(1, score1), F.col("adaptor1.end") + 1).otherwise(1)
    end = F.when(ok(2, score2), F.col("adaptor2.end") - 1).otherwise(F.col("read_width"))
    return df.withColumns({"trim_start": start, "trim_end": end}).where("trim_start < trim_end")


def barcode_align(
    reads: DataFrame, barcodes: list[str], opening: float = 5, extension: float = 1, kind: str = "phred", iupac: str = "compat"
) -> DataFrame:
    """Best barcode (1-based, the first of equals), its global score and its lead over the second best.

    The barcodes are part of the query, so every read meets all of them in
    one pass without a join.
    """
    refs, settings = [b.upper() for b in barcodes], K.Settings(opening, extension, False, kind, iupac)

    @F.pandas_udf("barcode int, score double, gap double")
    def run(s: pd.Series, q: pd.Series) -> pd.DataFrame:
        seqs, quals = s.tolist(), q.tolist()
        table = [K.scores(r, seqs, quals, settings) for r in refs]
        out = []
        for i in range(len(seqs)):
            order = sorted((-t[i], k) for k, t in enumerate(table))
            best = -order[0][0] if order else float("-inf")
            second = -order[1][0] if len(order) > 1 else float("-inf")
            out.append((order[0][1] + 1 if order else None, best, best - second))
        return pd.DataFrame(out, columns=["barcode", "score", "gap"]).astype({"barcode": "Int32"})

    return reads.withColumn("_b", run("seq", "qual")).select("read_idx", "_b.barcode", "_b.score", "_b.gap")


def demultiplex(barcoded: DataFrame, score: float, gap: float) -> DataFrame:
    """Reads assigned clearly; write them with ``partitionBy("barcode")`` to split them."""
    return barcoded.where((F.col("score") > score) & (F.col("gap") > gap))


def realize_reads(aligned: DataFrame, reads: DataFrame, trim: bool = True) -> DataFrame:
    """The reads of ``aligned``, on the strand and cut to the range found. A name without a read is an error."""
    first = F.row_number().over(Window.partitionBy("read_name").orderBy("read_idx"))
    source = reads.withColumn("_n", first).where("_n = 1").select("read_name", "seq", "qual")
    missing = F.raise_error(F.concat(F.lit("read not found: "), F.col("read_name")))
    df = aligned.join(source, "read_name", "left")
    df = df.withColumn("seq", F.when(F.col("seq").isNull(), missing).otherwise(F.col("seq")))
    df = df.withColumns(
        {
            "seq": F.when(F.col("reversed"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")),
            "qual": F.when(F.col("reversed"), F.reverse("qual")).otherwise(F.col("qual")),
        }
    )
    if trim:
        cut = lambda c: S.trim(F.col(c), F.col("trim_start"), F.col("trim_end"))
        df = df.withColumns({"seq": cut("seq"), "qual": cut("qual")})
    return df.select("read_idx", "read_name", "seq", "qual")


def extract_subseq(aligned: DataFrame, reads: DataFrame, p: AlignParams, sections1: list[tuple[int, int]], sections2: list[tuple[int, int]]) -> DataFrame:
    """Read bases under any sections of the adaptors, by aligning again on the strand already known.

    Of reads that share a name the first is taken.
    """
    known = aligned.select("read_name", "reversed", F.col("adaptor1.score").alias("_k1"), F.col("adaptor2.score").alias("_k2"))
    first = F.row_number().over(Window.partitionBy("read_name").orderBy("read_idx"))
    source = reads.withColumn("_n", first).where("_n = 1").drop("_n")
    df = windows(source.join(known, "read_name"), p.tolerance)
    out = []
    for n, adaptor, sections in ((1, p.adaptor1, sections1), (2, p.adaptor2, sections2)):
        if not sections:
            continue
        here, there = ("_front", "_back") if n == 1 else ("_back", "_front")
        pick = lambda s: F.when(F.col("reversed"), F.col(there + s)).otherwise(F.col(here + s))  # noqa: B023, E731
        df = df.withColumn(f"_x{n}", _sections(adaptor, sections, pick(""), pick("_q"), p.settings))
        same = F.abs(F.col(f"_x{n}.score") - F.col(f"_k{n}")) < 1e-6
        found = F.when(same, F.col(f"_x{n}.parts")).otherwise(F.raise_error(F.lit("realigned score differs from the stored one")))
        out.append(found.alias(f"subseq{n}"))
    return df.select("read_idx", "read_name", *out)


def _sections(adaptor: str, sections: list[tuple[int, int]], seq: Column, qual: Column, settings: K.Settings) -> Column:
    ref = adaptor.upper()

    @F.pandas_udf("score double, parts array<string>")
    def run(s: pd.Series, q: pd.Series) -> pd.DataFrame:
        seqs, out = s.tolist(), []
        for text, (score, spans) in zip(seqs, K.traced(ref, seqs, q.tolist(), settings), strict=True):
            spots = [spans.section(a, b, len(text)) for a, b in sections]
            out.append((score, [text[i - 1 : i - 1 + w] for i, w in spots]))
        return pd.DataFrame(out, columns=["score", "parts"])

    return run(seq, qual)


def scrambled(reads: DataFrame, seed: int = 0, columns: tuple[str, str] = ("seq", "qual")) -> DataFrame:
    """Each read's bases in random order, qualities moved along; the same on every retry."""
    seq, qual = columns
    return reads.withColumns({c: S.scrambled(F.col(c), F.col("read_idx"), seed) for c in (seq, qual)})


def tune_scores(reads: DataFrame, p: AlignParams, openings: range, extensions: range, seed: int = 0) -> DataFrame:
    """Scores of the reads and of their scrambled ends for every pair of gap costs: ``go, ge, fake, score``.

    The better strand of each read counts, negative scores as 0. Every read
    goes through the whole grid in one pass.
    """
    ends = windows(reads, p.tolerance).select("read_idx", "_front", "_front_q", "_back", "_back_q")
    fake = scrambled(scrambled(ends, seed, ("_front", "_front_q")), seed + 1, ("_back", "_back_q"))
    both = ends.withColumn("fake", F.lit(False)).unionByName(fake.withColumn("fake", F.lit(True)))
    grid = [replace(p, opening=go, extension=ge) for go in openings for ge in extensions]
    first, second = p.adaptor1.upper(), p.adaptor2.upper()

    @F.pandas_udf("array<double>")
    def run(f: pd.Series, fq: pd.Series, b: pd.Series, bq: pd.Series) -> pd.Series:
        front, back = (f.tolist(), fq.tolist()), (b.tolist(), bq.tolist())
        table = []
        for g in grid:
            one = lambda ref, side: np.maximum(K.scores(ref, *side, g.settings), 0)  # noqa: B023, E731
            table.append(np.maximum(one(first, front) + one(second, back), one(first, back) + one(second, front)))
        return pd.Series(list(np.array(table).reshape(len(grid), len(f)).T))

    # a sample may lie in one partition, and one read stands for a whole grid
    spread = both.repartition(max(1, len(grid)), "read_idx", "fake")
    costs = F.array(*[F.struct(F.lit(g.opening).alias("go"), F.lit(g.extension).alias("ge")) for g in grid])
    rows = spread.select("fake", F.explode(F.arrays_zip(costs.alias("g"), run("_front", "_front_q", "_back", "_back_q").alias("s"))).alias("x"))
    return rows.select("x.g.go", "x.g.ge", "fake", F.col("x.s").alias("score"))


def tuned(reads: DataFrame, p: AlignParams, openings: range = range(4, 11), extensions: range = range(1, 6), number: int = 10000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """:func:`tune_alignment` and the scores ``fake, score`` at the gap costs chosen."""
    from .statistics import tied_overlap

    sample = reads.orderBy(F.xxhash64("read_name", F.lit(seed)), "read_idx").limit(number)
    scores = cut(tune_scores(sample, p, openings, extensions, seed))
    table = tied_overlap(scores, ["go", "ge"])
    best = F.max(F.struct("overlap", (-F.col("go")).alias("g"), (-F.col("ge")).alias("e")))
    found = cut(table.where("overlap > 0").agg(best.alias("b")).select((-F.col("b.g")).alias("go"), (-F.col("b.e")).alias("ge"), F.col("b.overlap").alias("overlap")))
    chosen = scores.join(F.broadcast(found.select("go", "ge")), ["go", "ge"])  # one row on the right
    return found, chosen.select("fake", "score")


def tune_alignment(reads: DataFrame, p: AlignParams, openings: range = range(4, 11), extensions: range = range(1, 6), number: int = 10000, seed: int = 0) -> DataFrame:
    """The gap costs that separate reads from scrambled reads best; the first of equals. No reads give nulls."""
    return tuned(reads, p, openings, extensions, number, seed)[0]
