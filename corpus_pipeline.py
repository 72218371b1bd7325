"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import cut, semi_join
from strandworks.llm.decontaminate import decontaminate
from strandworks.llm.mixing import mix_sources
from strandworks.llm.near_dedup import near_dedup
from strandworks.llm.quality import quality_scores
from strandworks.llm.sharding import shard_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose probability of the best grade is one half or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, filter_rows=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group linked by five-word shingles."""
    groups = near_dedup(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = cut(groups.where("not kept").select("doc_id").distinct())
    return semi_join(docs, gone, ["doc_id"], "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes the block of its middle word: 0, 1 or 2 times."""
    mixed = mix_sources(docs, weights=(5, 2, 1), share=1.5, max_repeats=2)
    times = F.explode_outer(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where("copies > 0").select(*docs.columns, times.alias("_sw_copy")).drop("_sw_copy")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows to 24 shards whose counts differ by one at most."""
    return shard_rows(docs.select("doc_id", "text"), n_shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot"
    )


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first stage fits a model, so no SQL gives the rows; tests compare the run with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
