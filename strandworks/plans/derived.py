"""Reads, alignments and scores derived from keys of ordinary tables, so that SQL can derive the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
#: What each hexadecimal digit of a digest stands for.
DNA, QUALITY, GAPPED, EDITED = "ACGTACGTACGTACGT", "(*,.02468:<>@BDF", "ACGTACGTACGTAC-N", "ACGTACGTACGTACG-"
ADAPTOR1, ADAPTOR2 = "ACGTNNNNACGT", "TTGACCAGTC"
BARCODES = ["ACGTACGTAC", "GGTTCCAAGT", "TTTTACGGCA", "CATGCATGAA"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(key: Column, salt: str, alphabet: str) -> Column:
    """32 letters that depend on the key and salt."""
    return F.translate(F.md5(F.concat(key.cast("string"), F.lit(salt))), HEX, alphabet)


def letters_sql(key: str, salt: str, alphabet: str) -> str:
    return f"translate(md5({key}::VARCHAR || '{salt}'), '{HEX}', '{alphabet}')"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read of 64 bases per document."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("read_idx"),
        F.concat(F.lit("read"), k.cast("string")).alias("read_name"),
        F.concat(letters(k, "s0", DNA), letters(k, "s1", DNA)).alias("seq"),
        F.concat(letters(k, "q0", QUALITY), letters(k, "q1", QUALITY)).alias("qual"),
    )


READS_SQL = f"""reads AS (SELECT doc_id AS read_idx, 'read' || doc_id AS read_name,
  {letters_sql("doc_id", "s0", DNA)} || {letters_sql("doc_id", "s1", DNA)} AS seq,
  {letters_sql("doc_id", "q0", QUALITY)} || {letters_sql("doc_id", "q1", QUALITY)} AS qual FROM documents)"""


def tagged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that carry both adaptors, every third one reversed."""
    from strandworks.functions.sequences import reverse_complement

    r = reads(spark, sf_dir)
    first = F.concat(F.lit(ADAPTOR1[:4]), F.substring("seq", 1, 4), F.lit(ADAPTOR1[8:]))
    seq = F.concat(first, "seq", reverse_complement(F.lit(ADAPTOR2)))
    qual = F.concat(F.substring("qual", 1, 12), "qual", F.substring("qual", 1, 10))
    flip = F.col("read_idx") % 3 == 0
    r = r.withColumns({"seq": seq, "qual": qual})
    return r.withColumns({"seq": F.when(flip, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "qual": F.when(flip, F.reverse("qual")).otherwise(F.col("qual"))})


TAGGED_SQL = f"""t0 AS (SELECT read_idx, '{ADAPTOR1[:4]}' || substr(seq, 1, 4) || '{ADAPTOR1[8:]}' || seq || translate(reverse('{ADAPTOR2}'), 'ACGT', 'TGCA') AS seq,
  substr(qual, 1, 12) || qual || substr(qual, 1, 10) AS qual FROM reads),
tagged AS (SELECT read_idx, CASE WHEN read_idx % 3 = 0 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS seq, CASE WHEN read_idx % 3 = 0 THEN reverse(qual) ELSE qual END AS qual FROM t0)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise alignments of reads to one reference: gaps of the read by key, of the reference by key as an insertion."""
    k = F.col("doc_id")
    ref = letters(F.lit("ref"), "", DNA)
    at = (k % 30).cast("int")
    ref_aln = F.concat(F.substring(ref, F.lit(1), at), F.repeat(F.lit("-"), (k % 4).cast("int")), F.substring(ref, at + 1, F.lit(32)))
    obs = F.concat(letters(k, "e", EDITED), F.lit("ACG"))
    return table(spark, sf_dir, "documents").select(
        k.alias("read_idx"), ref_aln.alias("ref_aln"), F.substring(F.regexp_replace(F.concat(F.substring(ref, F.lit(1), at), obs), "^$", ""), F.lit(1), F.char_length(ref_aln)).alias("read_aln")
    )


REF_SQL = f"(translate(md5('ref'), '{HEX}', '{DNA}'))"
PAIRS_SQL = f"""p0 AS (SELECT doc_id AS read_idx, (doc_id % 30)::INT AS gap_at, (doc_id % 4)::INT AS ins, {REF_SQL} AS ref, {letters_sql("doc_id", "e", EDITED)} || 'ACG' AS obs FROM documents),
p1 AS (SELECT read_idx, substr(ref, 1, gap_at) || repeat('-', ins) || substr(ref, gap_at + 1, 32) AS ref_aln, substr(ref, 1, gap_at) || obs AS obs2 FROM p0),
pairs AS (SELECT read_idx, ref_aln, substr(obs2, 1, length(ref_aln)) AS read_aln FROM p1)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multiple alignment per customer: a row of 32 columns for each order."""
    o = table(spark, sf_dir, "orders")
    row = letters(F.col("o_custkey"), "m", GAPPED)
    cut = (F.col("o_orderkey") % 31 + 1).cast("int")
    aln = F.concat(F.substring(row, F.lit(1), cut), F.substring(letters(F.col("o_orderkey"), "m", GAPPED), cut + 1, F.lit(32)))
    rows = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey"), aln.alias("aln"))))
    return o.groupBy(F.col("o_custkey").alias("group_id")).agg(F.transform(rows, lambda x: x["aln"]).alias("aln"))


def alignments_with_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a quality of as many characters as the row has letters."""
    q = F.transform("aln", lambda s: F.substring(F.translate(F.md5(s), HEX, QUALITY), F.lit(1), F.char_length(F.regexp_replace(s, "-", ""))))
    return alignments(spark, sf_dir).withColumn("quals", q)


MSA_SQL = f"""msa AS (SELECT o_custkey AS group_id, o_orderkey AS row_id,
  substr({letters_sql("o_custkey", "m", GAPPED)}, 1, (o_orderkey % 31 + 1)::INT) || substr({letters_sql("o_orderkey", "m", GAPPED)}, (o_orderkey % 31 + 2)::INT, 32) AS aln FROM orders),
cells AS (SELECT group_id, row_id, aln, pos, substr(aln, pos, 1) AS base FROM msa, range(1, 33) t(pos))"""


def umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of 10 bases: one of few templates with one base changed, in groups by user."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    at = (k % 10 + 1).cast("int")
    base = F.translate((k % 5).cast("string"), "01234", "ACGTN")

    def mutated(salt: str) -> Column:
        template = F.substring(letters((k * 7) % 11, salt, DNA), 1, 10)
        return F.concat(F.substring(template, F.lit(1), at - 1), base, F.substring(template, at + 1, F.lit(10)))

    return e.select(k.alias("read_idx"), F.col("user_id").cast("string").alias("pre_group"), mutated("u1").alias("umi1"), mutated("u2").alias("umi2"))


def _umi_sql(salt: str) -> str:
    template = letters_sql("((event_id * 7) % 11)", salt, DNA)
    return f"substr({template}, 1, (event_id % 10)::INT) || translate((event_id % 5)::VARCHAR, '01234', 'ACGTN') || substr(substr({template}, 1, 10), (event_id % 10 + 2)::INT, 10)"


UMIS_SQL = f"umis AS (SELECT event_id AS read_idx, user_id::VARCHAR AS pre_group, {_umi_sql('u1')} AS umi1, {_umi_sql('u2')} AS umi2 FROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and fake scores per order priority."""
    o = table(spark, sf_dir, "orders")
    score = F.col("o_orderkey") % 97 + F.col("o_custkey") % 13
    return o.select(F.col("o_orderpriority").alias("part"), (F.col("o_orderkey") % 5 == 0).alias("fake"), (score - F.when(F.col("o_orderkey") % 5 == 0, 20).otherwise(0)).cast("double").alias("score"))


SCORED_SQL = """scored AS (SELECT o_orderpriority AS part, o_orderkey % 5 = 0 AS fake,
  (o_orderkey % 97 + o_custkey % 13 - CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 0 END)::DOUBLE AS score FROM orders)"""


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SAM record for every line item, with headers."""
    li = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    s = lambda c: c.cast("string")
    cigar = F.concat(s(n), F.lit("H"), s(k % 7 + 1), F.lit("S"), s(k % 90 + 1), F.lit("M"), s(n), F.lit("I"), s(k % 3 + 1), F.lit("D"), s(k % 11 + 1), F.lit("="), s(n + 1), F.lit("S"))
    flag = F.when(k % 9 == 0, 4).when(k % 2 == 0, 16).otherwise(0)
    fields = [s(k), s(flag), F.concat(F.lit("chr"), s(n)), s(F.col("l_partkey")), s(k % 40), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("NM:i:0")]
    heads = spark.range(1, 8).select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:chr"), s(F.col("id"))), F.concat(F.lit("LN:"), s(F.col("id") * 1000))).alias("value"))
    return heads.unionByName(li.select(F.concat_ws("\t", *fields).alias("value")))
