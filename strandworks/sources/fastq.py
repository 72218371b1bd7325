"""FASTQ source and sink."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``read_idx, read_name, seq, qual`` of FASTQ files; gzip is read by its suffix.

    Spark's own text reader finds and reads the files, so any store and glob
    it knows will do. Records are four lines; '@' is a legal quality, so lines
    are numbered within each file and never guessed: lines are counted per
    split of a file, the counts of the splits are added up, and each line adds
    its place in its split. The rows of one split lie in one task, in order.
    The file's number is in the upper bits of read_idx.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    splits = splits.withColumn("_f", (F.dense_rank().over(Window.orderBy("file")) - 1).cast("long"))  # a row per split
    n = F.col("_before") + F.col("_at") - F.col("_first")
    rows = lines.join(splits, ["file", "block"]).select("_f", "value", F.floor(n / 4).alias("_rec"), (n % 4).alias("_part"))
    part = lambda k: F.max(F.when(F.col("_part") == k, F.col("value")))
    recs = rows.groupBy("_f", "_rec").agg(part(0).alias("h"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
    recs = recs.where(~((F.col("h") == "") & F.col("seq").isNull()))
    fine = F.col("h").startswith("@") & F.col("plus").startswith("+") & (F.char_length("seq") == F.char_length("qual"))
    name = F.when(fine, F.substring("h", 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("malformed FASTQ record: "), F.coalesce("h", F.lit("")))))
    return recs.select(F.shiftleft(F.col("_f"), 40).bitwiseOR(F.col("_rec")).alias("read_idx"), name.alias("read_name"), "seq", "qual")


def sample_fastq(reads: DataFrame, number: int, seed: int = 0) -> DataFrame:
    """A random sample of fixed size, the same for the same seed: the smallest digests of name, number and seed."""
    return reads.orderBy(F.md5(F.concat_ws(":", "read_name", "read_idx", F.lit(seed))), "read_idx").limit(number)


def write_fastq(reads: DataFrame, path: str, mode: str = "append") -> None:
    lines = F.concat_ws("\n", F.concat(F.lit("@"), "read_name"), "seq", F.lit("+"), "qual")
    reads.select(lines.alias("value")).write.mode(mode).text(path)


def mock_reads(
    spark: SparkSession, molecules: int = 10, reads: int = 20, length: int = 500, adaptor1: str = "", adaptor2: str = "", error: float = 0.05, seed: int = 0,
    barcodes: list[str] | None = None, barcode_position: tuple[int, int] | None = None,
) -> DataFrame:
    """Invented reads of invented molecules, with substitutions, insertions, deletions and half of them reversed.

    Each molecule has its own bases for the Ns of the adaptors, and one of the
    ``barcodes`` at the place ``barcode_position`` (1-based, closed) of adaptor 1.
    """
    first, last = barcode_position or (1, 0)
    if barcodes and any(len(b) != last - first + 1 for b in barcodes):
        raise ValueError("the width of the barcodes must be that of their position")

    def run(batches: Iterator) -> Iterator:
        import random

        import pandas as pd

        table = str.maketrans("ACGTN", "TGCAN")
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                m = random.Random(f"{seed}:{i // reads}")
                body = "".join(m.choices("ACGT", k=length))
                front = adaptor1[: first - 1] + m.choice(barcodes) + adaptor1[last:] if barcodes else adaptor1
                source = "".join(m.choice("ACGT") if c == "N" else c for c in front + body + adaptor2)
                r = random.Random(f"{seed}:{i}:read")
                text = []
                for c in source:
                    k = r.random() / error if error else 2
                    if k < 0.5:
                        text.append(r.choice("ACGT"))
                    elif k < 0.75:
                        text.append(c + r.choice("ACGT"))
                    elif k >= 1:
                        text.append(c)
                seq = "".join(text)
                if r.random() < 0.5:
                    seq = seq.translate(table)[::-1]
                qual = "".join(chr(33 + r.randint(8, 25)) for _ in seq)
                out.append((int(i), f"MOLECULE_{i // reads + 1}:READ_{i % reads + 1}", seq, qual))
            yield pd.DataFrame(out, columns=["read_idx", "read_name", "seq", "qual"])

    return spark.range(molecules * reads).mapInPandas(run, "read_idx long, read_name string, seq string, qual string")
