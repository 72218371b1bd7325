"""SAM source: genomic ranges of aligned reads, Catalyst only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import sequences as S


def sam_header(lines: DataFrame) -> DataFrame:
    """``rname, length`` of the @SQ lines, and '*' of length 0."""
    sq = lines.where(F.col("value").startswith("@SQ"))
    refs = sq.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("rname"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    return refs.unionByName(refs.sparkSession.range(1).select(F.lit("*").alias("rname"), F.lit(0).cast("long").alias("length")))


def sam_records(lines: DataFrame) -> DataFrame:
    """The first six fields of every record; header lines are told by their '@' and two letters."""
    body = lines.where(~F.col("value").rlike(r"^@[A-Z]{2}(\t|$)") & (F.col("value") != ""))
    f = F.split("value", "\t")
    number = lambda i: F.get(f, F.lit(i)).try_cast("int")
    return body.select(F.get(f, F.lit(0)).alias("qname"), number(1).alias("flag"), F.get(f, F.lit(2)).alias("rname"), number(3).alias("pos"), number(4).alias("mapq"), F.get(f, F.lit(5)).alias("cigar"))


def ranges_of(records: DataFrame, minq: int | None = 10, restricted: list[str] | None = None) -> DataFrame:
    """Mapped records of enough quality as ranges: ``qname, rname, start, width, strand, left_clip, right_clip``."""
    df = records.where(~S.is_unmapped(F.col("flag")))
    if minq is not None:
        df = df.where(F.col("mapq") >= minq)
    if restricted is not None:
        df = df.where(F.col("rname").isin(*restricted))
    cigar = F.col("cigar")
    strand = F.when(S.is_reverse(F.col("flag")), "-").otherwise("+")
    return df.select("qname", "rname", F.col("pos").alias("start"), S.cigar_width(cigar).alias("width"), strand.alias("strand"), S.left_clip(cigar).alias("left_clip"), S.right_clip(cigar).alias("right_clip"))


def sam_ranges(spark: SparkSession, path: str, minq: int | None = 10, restricted: list[str] | None = None, drop_first: bool = False) -> DataFrame:
    """Ranges of a SAM file. ``drop_first`` leaves its first record out, as some older pipelines did."""
    lines = spark.read.text(path)
    records = sam_records(lines)
    if drop_first:
        at = records.withColumn("_at", F.monotonically_increasing_id())
        first = at.agg(F.min("_at").alias("_first"))
        records = at.join(F.broadcast(first), F.col("_at") == F.col("_first"), "left_anti").drop("_at")  # one row on the right
    return ranges_of(records, minq, restricted)
