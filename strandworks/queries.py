"""Queries over every operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions import sequences as S
from strandworks.operators import alignment as A
from strandworks.operators import consensus as C
from strandworks.operators import errors as E
from strandworks.operators import msa as M
from strandworks.operators import statistics as T
from strandworks.operators import umi as U
from strandworks.plans import derived as D
from strandworks.scratch import scratch_path
from strandworks.sources import fastq, sam

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PARAMS = A.AlignParams(D.ADAPTOR1, D.ADAPTOR2, tolerance=40)
READS = f"WITH {D.READS_SQL} "
COMP = "translate(reverse({}), 'ACGT', 'TGCA')"


@query(READS + "SELECT read_idx, read_name, seq, qual FROM reads")
def o01_fastq_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fastq")
    fastq.write_fastq(D.reads(spark, sf_dir), path)
    back = fastq.read_fastq(spark, path)
    return back.select(F.substring("read_name", 5, 20).cast("long").alias("read_idx"), "read_name", "seq", "qual")


@query(READS + "SELECT read_idx, read_name, seq, qual FROM reads ORDER BY md5(read_name || ':' || read_idx || ':1'), read_idx LIMIT 100")
def o03_fastq_sample(spark, sf_dir):
    return fastq.sample_fastq(D.reads(spark, sf_dir), 100, 1)


@query("SELECT 'chr' || i AS rname, (i * 1000)::BIGINT AS length FROM range(1, 8) t(i) UNION ALL SELECT '*', 0")
def o04_sam_header(spark, sf_dir):
    return sam.sam_header(D.sam_lines(spark, sf_dir))


@query()
def o07_mock_reads(spark, sf_dir):
    return fastq.mock_reads(spark, 10, 20, 300, D.ADAPTOR1, D.ADAPTOR2)


@query(READS + f"SELECT read_idx, substr(seq, 1, 20) AS front, {COMP.format('right(seq, 20)')} AS back, reverse(right(qual, 20)) AS back_qual FROM reads")
def o08_windows(spark, sf_dir):
    seq, qual = F.col("seq"), F.col("qual")
    return D.reads(spark, sf_dir).select("read_idx", S.front_window(seq, 20).alias("front"), S.back_window(seq, 20).alias("back"), S.back_quality(qual, 20).alias("back_qual"))


@query(READS + f"SELECT read_idx, {COMP.format('seq')} AS seq, reverse(qual) AS qual, upper(lower(seq)) AS upper_seq FROM reads")
def o09_reverse_complement(spark, sf_dir):
    r = D.reads(spark, sf_dir)
    return r.select("read_idx", S.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"), F.upper(F.lower("seq")).alias("upper_seq"))


@query("SELECT 5 AS first, 8 AS last")
def o11_ambiguous_runs(spark, sf_dir):
    runs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in S.ambiguous_runs(D.ADAPTOR1)]
    return spark.range(1).select(F.inline(F.array(*runs)))


@query(READS + "SELECT read_idx, round(list_sum(list_transform(range(1, 65), lambda i: pow(10, -(ascii(substr(qual, i, 1)) - 33) / 10.0))), 6) AS expected_errors FROM reads")
def o12_error_table(spark, sf_dir):
    errors = F.transform(S.bases(F.col("qual")), lambda c: S.error_of(c))
    return D.reads(spark, sf_dir).select("read_idx", F.round(F.aggregate(errors, F.lit(0.0), lambda a, x: a + x), 6).alias("expected_errors"))


MASKED = "list_aggregate(list_transform(range(1, 65), lambda i: CASE WHEN pow(10, -(ascii(substr(qual, i, 1)) - 33) / 10.0) > 0.02 THEN 'N' ELSE substr(seq, i, 1) END), 'string_agg', '')"


@query(READS + f"SELECT read_idx, {MASKED} AS masked FROM reads")
def o13_quality_mask(spark, sf_dir):
    return D.reads(spark, sf_dir).select("read_idx", S.quality_mask(F.col("seq"), F.col("qual"), 0.02).alias("masked"))


@query(READS + "SELECT read_idx, substr(seq, 1, 30) || '-' || substr(seq, 31, 34) AS unmasked FROM reads")
def o14_unmask(spark, sf_dir):
    r = D.reads(spark, sf_dir).withColumn("masked", S.quality_mask(F.col("seq"), F.col("qual"), 0.02))
    gapped = F.concat(F.substring("masked", 1, 30), F.lit("-"), F.substring("masked", 31, 34))
    return r.select("read_idx", S.unmask(gapped, F.col("seq")).alias("unmasked"))


@query(READS + "SELECT read_idx, substr(seq, (read_idx % 20 + 1)::INT, (read_idx % 9 + 11)::INT) AS trimmed FROM reads")
def o15_trim(spark, sf_dir):
    start = (F.col("read_idx") % 20 + 1).cast("int")
    end = (start + F.col("read_idx") % 9 + 10).cast("int")
    return D.reads(spark, sf_dir).select("read_idx", S.trim(F.col("seq"), start, end).alias("trimmed"))


@query(READS + "SELECT read_idx, list_aggregate(list_sort(string_split(seq, '')), 'string_agg', '') AS letters, 64::BIGINT AS n FROM reads")
def o16_scramble(spark, sf_dir):
    r = A.scrambled(D.reads(spark, sf_dir), 3)
    return r.select("read_idx", F.array_join(F.array_sort(S.bases(F.col("seq"))), "").alias("letters"), F.char_length("qual").cast("long").alias("n"))


SAM_SQL = """SELECT l_orderkey::VARCHAR AS qname, 'chr' || l_linenumber AS rname, l_partkey::INT AS start,
 (l_orderkey % 90 + 1 + l_orderkey % 3 + 1 + l_orderkey % 11 + 1)::INT AS width, CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand,
 (l_linenumber + l_orderkey % 7 + 1)::INT AS left_clip, (l_linenumber + 1)::INT AS right_clip
 FROM lineitem WHERE l_orderkey % 9 <> 0 AND l_orderkey % 40 >= 10"""


@query(SAM_SQL)
def o59_sam_ranges(spark, sf_dir):
    return sam.ranges_of(sam.sam_records(D.sam_lines(spark, sf_dir)), 10)


@query("SELECT o_orderkey AS read_idx, greatest(o_orderkey % 11 - 5, 0) + greatest(o_custkey % 7 - 3, 0) < greatest(o_custkey % 11 - 5, 0) + greatest(o_orderkey % 7 - 3, 0) AS reversed FROM orders")
def o20_strand(spark, sf_dir):
    d = lambda c, m, k: (F.col(c) % m - k).cast("double")
    o, c = "o_orderkey", "o_custkey"
    return D.table(spark, sf_dir, "orders").select(F.col(o).alias("read_idx"), S.is_reversed(d(o, 11, 5), d(c, 7, 3), d(c, 11, 5), d(o, 7, 3)).alias("reversed"))


@query("SELECT o_orderkey AS read_idx, chr((least(round(o_orderkey % 1000 / 10.0 + 0.03), 93) + 33)::INT) AS phred FROM orders")
def o21_phred(spark, sf_dir):
    log_error = ((F.col("o_orderkey") % 1000) / 10.0 + 0.03) * F.lit(-2.302585092994046 / 10)
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_idx"), S.phred_char(log_error).alias("phred"))


def _scores_sql(source: str, local: bool, opening: float = 5, extension: float = 1) -> str:
    """``best(read_idx, ref, score)`` of ``source(read_idx, ref, seq, qual)``, one read base at a time.

    Lists hold a value per reference base and one before them. A gap along the
    reference is the best of all its starts.
    """
    last = f"CASE WHEN j = length(ref) + 1 THEN 0.0 ELSE {{}} END" if local else "{}"
    error = "pow(10, -(ascii(substr(qual, i + 1, 1)) - 33) / 10.0)"
    gain = f"CASE substr(ref, (j - 1)::INT, 1) WHEN 'N' THEN 0.0 WHEN substr(seq, i + 1, 1) THEN log2(4 * (1 - {error})) ELSE log2({error} * 4 / 3) END"
    edge = "0.0" if local else f"-({opening} + {extension} * (i + 1))"
    places = "range(1, length(ref) + 2)"
    return f"""dp AS (SELECT read_idx, ref, seq, qual, 0 AS i, list_transform({places}, lambda j: CASE WHEN j = 1 THEN 0.0 ELSE -({opening} + {extension} * (j - 1)) END::DOUBLE) AS h, list_transform({places}, lambda j: -1e18::DOUBLE) AS up FROM {source}
UNION ALL SELECT read_idx, ref, seq, qual, i + 1, list_transform({places}, lambda j: list_max(list_transform(range(1, j + 1), lambda k: base[k] - CASE WHEN k = j THEN 0.0 ELSE {opening} + {extension} * (j - k) END))), gap
FROM (SELECT *, list_transform({places}, lambda j: CASE WHEN j = 1 THEN {edge} ELSE greatest(gap[j], h[j - 1] + {gain}) END::DOUBLE) AS base
FROM (SELECT *, list_transform({places}, lambda j: greatest(h[j] - {last.format(opening + extension)}, up[j] - {last.format(extension)})::DOUBLE) AS gap FROM dp WHERE i < length(seq)))),
best AS (SELECT read_idx, ref, h[length(ref) + 1] AS score FROM dp WHERE i = length(seq))"""


RECURSIVE = f"WITH RECURSIVE {D.READS_SQL}, "


@query()
def o28_adaptor_align_sections(spark, sf_dir):
    r = D.tagged_reads(spark, sf_dir)
    a = A.adaptor_struct(D.ADAPTOR1, F.col("seq"), F.col("qual"), PARAMS.settings)
    return r.withColumn("a", a).select("read_idx", F.round("a.score", 6).alias("score"), "a.start", "a.end", F.col("a.subseq.Sub1.seq").alias("sub1"))


@query(RECURSIVE + f"{D.TAGGED_SQL}, jobs AS (SELECT *, '{D.ADAPTOR1}' AS ref FROM tagged), {_scores_sql('jobs', True)} SELECT read_idx, round(score, 6) AS score FROM best")
def o29_adaptor_score(spark, sf_dir):
    r = D.tagged_reads(spark, sf_dir)
    return r.select("read_idx", F.round(A.score_only(D.ADAPTOR1, F.col("seq"), F.col("qual"), PARAMS.settings), 6).alias("score"))


@query()
def o31_quality_align(spark, sf_dir):
    return A.quality_align(D.reads(spark, sf_dir), "ACGTTGCA" * 8).select("read_idx", F.round("score", 6).alias("score"), "edit", "reference", "query")


@query()
def o32_adaptor_align(spark, sf_dir):
    a = A.adaptor_align(D.tagged_reads(spark, sf_dir), PARAMS)
    return a.select("read_idx", "read_name", "read_width", "reversed", F.round("adaptor1.score", 6).alias("score1"), F.col("adaptor1.start").alias("start1"), F.col("adaptor1.end").alias("end1"), F.round("adaptor2.score", 6).alias("score2"), F.col("adaptor2.start").alias("start2"), F.col("adaptor2.end").alias("end2"))


FILTER_SQL = """WITH a AS (SELECT o_orderkey AS read_idx, (o_custkey % 100)::INT AS w, (o_orderkey % 23)::DOUBLE AS s1, (o_custkey % 19)::DOUBLE AS s2,
 (o_orderkey % 13)::INT AS e1, (o_custkey % 100 - o_orderkey % 17)::INT AS e2 FROM orders)
SELECT read_idx, e1 + 1 AS trim_start, CASE WHEN s2 >= 8 THEN e2 - 1 ELSE w END AS trim_end FROM a WHERE s1 >= 10 AND e1 + 1 < CASE WHEN s2 >= 8 THEN e2 - 1 ELSE w END"""


@query(FILTER_SQL)
def o33_filter_reads(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda s, e: F.struct(s.cast("double").alias("score"), e.cast("int").alias("end"))
    a = D.table(spark, sf_dir, "orders").select(o.alias("read_idx"), (c % 100).cast("int").alias("read_width"), part(o % 23, o % 13).alias("adaptor1"), part(c % 19, c % 100 - o % 17).alias("adaptor2"))
    return A.filter_reads(a, 10, 8, True, False).select("read_idx", "trim_start", "trim_end")


BARCODE_SQL = f"""jobs AS (SELECT read_idx, substr(seq, 1, 12) AS seq, substr(qual, 1, 12) AS qual, unnest({D.BARCODES}) AS ref FROM reads), {_scores_sql("jobs", False)},
ranked AS (SELECT read_idx, list_position({D.BARCODES}, ref)::INT AS barcode, score, row_number() OVER w AS r, score - lead(score) OVER w AS gap FROM best WINDOW w AS (PARTITION BY read_idx ORDER BY score DESC, list_position({D.BARCODES}, ref)))
SELECT read_idx, barcode, round(score, 6) AS score, round(gap, 6) AS gap FROM ranked WHERE r = 1"""


@query(RECURSIVE + BARCODE_SQL)
def o34_barcode_align(spark, sf_dir):
    r = D.reads(spark, sf_dir).withColumns({"seq": F.substring("seq", 1, 12), "qual": F.substring("qual", 1, 12)})
    return A.barcode_align(r, D.BARCODES).select("read_idx", "barcode", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


@query("SELECT (o_orderkey % 8 + 1)::INT AS barcode, count(*) AS reads FROM orders WHERE o_totalprice > 50000 AND o_custkey % 40 > 5 GROUP BY 1")
def o35_demultiplex(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    b = o.select((F.col("o_orderkey") % 8 + 1).cast("int").alias("barcode"), F.col("o_totalprice").alias("score"), (F.col("o_custkey") % 40).cast("double").alias("gap"))
    return A.demultiplex(b, 50000, 5).groupBy("barcode").agg(F.count("*").alias("reads"))


@query(READS + f"SELECT read_idx, read_name, substr(CASE WHEN read_idx % 2 = 0 THEN {COMP.format('seq')} ELSE seq END, 3, 48) AS seq, substr(CASE WHEN read_idx % 2 = 0 THEN reverse(qual) ELSE qual END, 3, 48) AS qual FROM reads")
def o36_realize_reads(spark, sf_dir):
    r = D.reads(spark, sf_dir)
    aligned = r.select("read_idx", "read_name", (F.col("read_idx") % 2 == 0).alias("reversed"), F.lit(3).alias("trim_start"), F.lit(50).alias("trim_end"))
    return A.realize_reads(aligned, r)


@query()
def o37_extract_subseq(spark, sf_dir):
    r = D.tagged_reads(spark, sf_dir)
    return A.extract_subseq(A.adaptor_align(r, PARAMS), r, PARAMS, [(5, 8)], [(1, 5)])


@query()
def o39_multi_read_align(spark, sf_dir):
    r = D.reads(spark, sf_dir).withColumn("group_id", F.floor(F.col("read_idx") / 4))
    return M.multi_read_align(r).select("group_id", F.array_join("aln", "|").alias("aln"), F.array_join("quals", " ").alias("quals"))


CONSENSUS_SQL = f"""WITH {D.MSA_SQL}, g AS (SELECT group_id, pos, count(*) AS n, count(*) FILTER (WHERE base <> '-') AS seen,
 count(*) FILTER (WHERE base = 'A') AS a, count(*) FILTER (WHERE base = 'C') AS c, count(*) FILTER (WHERE base = 'G') AS g, count(*) FILTER (WHERE base = 'T') AS t FROM cells GROUP BY ALL),
h AS (SELECT *, greatest(a, c, g, t) AS top, a + c + g + t AS total FROM g WHERE seen >= n * 0.6)
SELECT group_id, string_agg(CASE top WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END, '' ORDER BY pos) AS seq,
 round(sum(ln(1 - (top + 0.25) / (total + 1.0))), 6) AS log_error FROM h GROUP BY group_id"""


def _summed(df: DataFrame) -> DataFrame:
    total = F.aggregate("log_error", F.lit(0.0), lambda a, x: a + x)
    return df.where("seq <> ''").select("group_id", "seq", F.round(total, 6).alias("log_error"))


@query(CONSENSUS_SQL)
def o41_basic_consensus(spark, sf_dir):
    return _summed(C.consensus_reads(D.alignments(spark, sf_dir)))


QUALITY_SQL = f"""WITH {D.MSA_SQL}, k AS (SELECT *, sum((base <> '-')::INT) OVER (PARTITION BY row_id ORDER BY pos) AS nth FROM cells),
e AS (SELECT *, CASE WHEN base <> '-' THEN greatest(least(pow(10, -(ascii(substr(translate(md5(aln), '{D.HEX}', '{D.QUALITY}'), nth::INT, 1)) - 33) / 10.0), 1 - 1e-8), 1e-8) END AS e FROM k),
s AS (SELECT group_id, pos, count(*) AS n, count(*) FILTER (WHERE base <> '-') AS seen, {", ".join(f"sum(CASE WHEN base IN ('A','C','G','T') THEN CASE WHEN base = '{b}' THEN ln(1 - e) ELSE ln(e / 3) END ELSE 0 END) AS {b.lower()}" for b in "ACGT")} FROM e GROUP BY ALL),
h AS (SELECT group_id, pos, round(a, 9) AS a, round(c, 9) AS c, round(g, 9) AS g, round(t, 9) AS t, round(greatest(a, c, g, t), 9) AS top FROM s WHERE seen >= n * 0.6),
z AS (SELECT *, list_sort([a, c, g, t]) AS l FROM h)
SELECT group_id, string_agg(CASE top WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END, '' ORDER BY pos) AS seq,
 round(sum(ln(exp(l[1] - l[3]) + exp(l[2] - l[3]) + 1) + l[3] - ln(exp(l[1] - top) + exp(l[2] - top) + exp(l[3] - top) + 1) - top), 4) AS log_error FROM z GROUP BY group_id"""


@query(QUALITY_SQL)
def o42_quality_consensus(spark, sf_dir):
    out = C.consensus_reads(D.alignments_with_quality(spark, sf_dir)).where("seq <> ''")
    return out.select("group_id", "seq", F.round(F.aggregate("log_error", F.lit(0.0), lambda a, x: a + x), 4).alias("log_error"))


ERRORS_SQL = f"""WITH {D.PAIRS_SQL}, x AS (SELECT read_idx, i, substr(ref_aln, i, 1) AS ref, substr(read_aln, i, 1) AS obs FROM pairs, range(1, 40) t(i) WHERE i <= length(ref_aln)),
y AS (SELECT *, sum((ref <> '-')::INT) OVER (PARTITION BY read_idx ORDER BY i) AS seen FROM x),
"""
PROFILE_SQL = ERRORS_SQL + f"""s AS (SELECT seen::INT AS pos, count(*) FILTER (WHERE obs = 'A') AS "A", count(*) FILTER (WHERE obs = 'C') AS "C", count(*) FILTER (WHERE obs = 'G') AS "G", count(*) FILTER (WHERE obs = 'T') AS "T", count(*) FILTER (WHERE obs = '-') AS deletion FROM y WHERE ref <> '-' GROUP BY 1),
i AS (SELECT gap_at + 1 AS pos, count(*) AS reads, sum(ins) AS bases FROM p0 WHERE ins > 0 GROUP BY 1)
SELECT p.pos::INT AS pos, nullif(substr({D.REF_SQL}, p.pos::INT, 1), '') AS base, "A", "C", "G", "T", deletion, coalesce(reads, 0)::BIGINT AS inserted_reads, coalesce(bases, 0)::BIGINT AS inserted_bases
FROM range(1, 34) p(pos) LEFT JOIN s ON s.pos = p.pos LEFT JOIN i ON i.pos = p.pos"""


@query(PROFILE_SQL)
def o43_error_profile(spark, sf_dir):
    p = E.error_profile(D.pairs(spark, sf_dir))
    some = F.filter("insertion", lambda x: x["len"] > 0)
    add = lambda f: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return p.select("pos", "base", "A", "C", "G", "T", "deletion", add(lambda x: x["freq"]).alias("inserted_reads"), add(lambda x: x["freq"] * x["len"]).alias("inserted_bases"))


@query(ERRORS_SQL + """z AS (SELECT ref, obs FROM y WHERE ref <> '-')
SELECT ref AS base, count(*) FILTER (WHERE obs = 'A') AS "A", count(*) FILTER (WHERE obs = 'C') AS "C", count(*) FILTER (WHERE obs = 'G') AS "G", count(*) FILTER (WHERE obs = 'T') AS "T" FROM z GROUP BY 1""")
def o45_transitions(spark, sf_dir):
    return E.transitions(E.error_profile(D.pairs(spark, sf_dir)))


RUNS_SQL = """b AS (SELECT read_idx, i, substr(seq, i, 1) AS base FROM reads, range(1, 65) t(i)),
c AS (SELECT *, i - row_number() OVER (PARTITION BY read_idx, base ORDER BY i) AS island FROM b),
r AS (SELECT read_idx, min(i)::INT AS start, count(*)::INT AS width, base FROM c GROUP BY read_idx, base, island HAVING count(*) > 1)"""


@query(READS + f", {RUNS_SQL} SELECT * FROM r")
def o46_homopolymers(spark, sf_dir):
    return E.homopolymers(D.reads(spark, sf_dir))


@query(ERRORS_SQL + f"""z AS (SELECT DISTINCT seen AS pos, ref FROM y WHERE ref <> '-'), t AS (SELECT ref AS base, "A", "C", "G", "T" FROM (SELECT seen, ref, count(*) FILTER (WHERE obs = 'A') AS "A", count(*) FILTER (WHERE obs = 'C') AS "C", count(*) FILTER (WHERE obs = 'G') AS "G", count(*) FILTER (WHERE obs = 'T') AS "T" FROM y WHERE ref <> '-' GROUP BY ALL) p
 WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.ref = p.ref AND abs(z.pos - p.seen) = 1))
SELECT base, sum("A")::BIGINT AS "A", sum("C")::BIGINT AS "C", sum("G")::BIGINT AS "G", sum("T")::BIGINT AS "T" FROM t GROUP BY 1""")
def o62_transitions_outside_runs(spark, sf_dir):
    """Transitions of the bases that are not in a run: those whose neighbours differ."""
    p = E.error_profile(D.pairs(spark, sf_dir))
    ref = spark.range(1).select(F.lit(0).alias("read_idx"), D.letters(F.lit("ref"), "", D.DNA).alias("seq"))
    return E.transitions(E.outside_homopolymers(p, E.homopolymers(ref)))


MATCHES_SQL = ERRORS_SQL + """n AS (SELECT read_idx, i, ref, seen, (lag(ref) OVER w IS DISTINCT FROM ref)::INT AS new FROM y WHERE ref <> '-' WINDOW w AS (PARTITION BY read_idx ORDER BY i)),
m AS (SELECT *, sum(new) OVER (PARTITION BY read_idx ORDER BY i) AS run FROM n),
r AS (SELECT read_idx, run, min(i) AS a, max(i) AS b, min(seen)::INT AS start, count(*)::INT AS width, any_value(ref) AS base FROM m GROUP BY ALL),
q AS (SELECT *, coalesce(lag(b) OVER w, 0) AS after, coalesce(lead(a) OVER w, 1000) AS before FROM r WINDOW w AS (PARTITION BY read_idx ORDER BY run)),
o AS (SELECT q.*, y.i, y.obs, (lag(obs) OVER w IS DISTINCT FROM obs)::INT AS new FROM q JOIN y ON q.read_idx = y.read_idx AND y.i > after AND y.i < before AND obs <> '-' WHERE width > 1 WINDOW w AS (PARTITION BY q.read_idx, run ORDER BY y.i)),
u AS (SELECT *, sum(new) OVER (PARTITION BY read_idx, run ORDER BY i) AS part FROM o),
v AS (SELECT read_idx, run, part, count(*) AS n FROM u GROUP BY read_idx, run, part HAVING any_value(obs) = any_value(base) AND min(i) <= any_value(b) AND max(i) >= any_value(a)),
l AS (SELECT q.start, q.width, q.base, coalesce(max(n), 0) AS observed FROM q LEFT JOIN v USING (read_idx, run) WHERE width > 1 GROUP BY q.read_idx, run, q.start, q.width, q.base),
c AS (SELECT start, width, base, observed, count(*) AS freq FROM l GROUP BY ALL)
SELECT start, width, base, string_agg(observed || ':' || freq, ',' ORDER BY observed) AS observed FROM c GROUP BY ALL"""


@query(MATCHES_SQL)
def o47_homopolymer_matches(spark, sf_dir):
    p = E.homopolymer_profile(D.pairs(spark, sf_dir))
    return p.select("start", "width", "base", F.array_join(F.transform("observed", lambda x: F.concat_ws(":", x["len"], x["freq"])), ",").alias("observed"))


@query()
def o48_umi_group(spark, sf_dir):
    return U.umi_group(D.umis(spark, sf_dir), 2)


def _masked_sql(source: str) -> str:
    """``masked(a, b, dist)`` of ``source(a, b)``: edit distances in which a pairing with N costs one half."""
    places = "range(1, length(b) + 2)"
    cost = "CASE WHEN 'N' IN (substr(a, i + 1, 1), substr(b, (j - 1)::INT, 1)) THEN 0.5 WHEN substr(a, i + 1, 1) = substr(b, (j - 1)::INT, 1) THEN 0.0 ELSE 1.0 END"
    return f"""ed AS (SELECT a, b, 0 AS i, list_transform({places}, lambda j: (j - 1)::DOUBLE) AS h FROM {source}
UNION ALL SELECT a, b, i + 1, list_transform({places}, lambda j: list_min(list_transform(range(1, j + 1), lambda k: step[k] + j - k)))
FROM (SELECT *, list_transform({places}, lambda j: CASE WHEN j = 1 THEN h[1] + 1 ELSE least(h[j] + 1, h[j - 1] + {cost}) END::DOUBLE) AS step FROM ed WHERE i < length(a))),
masked AS (SELECT a, b, h[length(b) + 1] AS dist FROM ed WHERE i = length(a))"""


@query(f"WITH RECURSIVE {D.UMIS_SQL}, jobs AS (SELECT DISTINCT umi1 AS a, umi2 AS b FROM umis), {_masked_sql('jobs')} SELECT read_idx, dist FROM umis JOIN masked ON umi1 = a AND umi2 = b")
def o49_masked_distance(spark, sf_dir):
    return D.umis(spark, sf_dir).select("read_idx", U.distance(F.col("umi1"), F.col("umi2")).alias("dist"))


NEIGHBOURS_SQL = f"""WITH RECURSIVE {D.UMIS_SQL}, texts AS (SELECT pre_group, umi1, count(*) AS n FROM umis GROUP BY ALL),
met AS (SELECT pre_group, x.umi1 AS a, y.umi1 AS b, y.n FROM texts x JOIN texts y USING (pre_group)),
jobs AS (SELECT DISTINCT a, b FROM met WHERE contains(a || b, 'N')), {_masked_sql("jobs")},
near AS (SELECT pre_group, met.a, sum(n) AS near FROM met LEFT JOIN masked ON met.a = masked.a AND met.b = masked.b WHERE coalesce(dist, levenshtein(met.a, met.b)) <= 1 GROUP BY ALL)
SELECT read_idx, near::BIGINT AS near FROM umis JOIN near ON umis.pre_group = near.pre_group AND umi1 = a"""


@query(NEIGHBOURS_SQL)
def o50_umi_neighbours(spark, sf_dir):
    return U.neighbours(D.umis(spark, sf_dir), 1).groupBy("a").agg(F.count("*").alias("near")).withColumnRenamed("a", "read_idx")


@query()
def o52_two_umis(spark, sf_dir):
    return U.umi_group(D.umis(spark, sf_dir), 2, 1)


SUPPLIERS = f"SELECT s_suppkey AS read_idx, substr({D.letters_sql('s_suppkey', 'd', D.DNA)}, 1, 8) AS seq FROM supplier"


@query(f"WITH s AS ({SUPPLIERS}) SELECT a.read_idx AS i, b.read_idx AS j, levenshtein(a.seq, b.seq)::DOUBLE AS dist FROM s a JOIN s b ON a.read_idx < b.read_idx")
def o53_expected_distances(spark, sf_dir):
    k = F.col("s_suppkey")
    return U.expected_distances(D.table(spark, sf_dir, "supplier").select(k.alias("read_idx"), F.substring(D.letters(k, "d", D.DNA), 1, 8).alias("seq")))


@query()
def o54_adaptor_thresholds(spark, sf_dir):
    return T.adaptor_thresholds(D.tagged_reads(spark, sf_dir), PARAMS, 0.05)


FDR_SQL = f"""WITH {D.SCORED_SQL}, r AS (SELECT part, score, row_number() OVER (PARTITION BY part ORDER BY score) AS i, count(*) OVER (PARTITION BY part) AS n FROM scored WHERE NOT fake),
f AS (SELECT part, score, i, n, (SELECT count(*) FROM scored s WHERE s.fake AND s.part = r.part AND s.score > r.score) AS above FROM r)
SELECT part, min(score) FILTER (WHERE n > i AND above <= 0.05 * (n - i)) AS threshold FROM f GROUP BY part"""


@query(FDR_SQL)
def o55_fdr_threshold(spark, sf_dir):
    return T.fdr_threshold(D.scored(spark, sf_dir), 0.05, ["part"])


@query("""WITH m AS (SELECT median(o_totalprice) AS ms, median(o_custkey::DOUBLE) AS mg FROM orders)
SELECT round(any_value(ms) - 1.4826 * 3 * median(abs(o_totalprice - ms)), 4) AS score, round(any_value(mg) - 1.4826 * 3 * median(abs(o_custkey - mg)), 4) AS gap FROM orders, m""")
def o56_barcode_thresholds(spark, sf_dir):
    b = D.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score"), F.col("o_custkey").cast("double").alias("gap"))
    return T.barcode_thresholds(b).select(F.round("score", 4).alias("score"), F.round("gap", 4).alias("gap"))


@query()
def o57_tune_alignment(spark, sf_dir):
    return A.tune_alignment(D.tagged_reads(spark, sf_dir), PARAMS)


OVERLAP_SQL = f"""WITH {D.SCORED_SQL}, c AS (SELECT part, score, count(*) FILTER (WHERE NOT fake) AS r, count(*) FILTER (WHERE fake) AS f FROM scored GROUP BY ALL)
SELECT a.part, round(sum(a.r * b.f * CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0 END) / sum(a.r * b.f), 6)::DOUBLE AS overlap FROM c a JOIN c b ON a.part = b.part GROUP BY a.part"""


@query(OVERLAP_SQL)
def o58_tied_overlap(spark, sf_dir):
    return T.tied_overlap(D.scored(spark, sf_dir), ["part"]).withColumn("overlap", F.round("overlap", 6))


@query(READS + f", {RUNS_SQL} SELECT base, width, count(*) AS runs, quantile_cont(start, 0.5) AS mid_start FROM r GROUP BY base, width")
def o61_run_summary(spark, sf_dir):
    """The flagship: homopolymer runs of all reads by base and width."""
    runs = E.homopolymers(D.reads(spark, sf_dir))
    return runs.groupBy("base", "width").agg(F.count("*").alias("runs"), F.percentile("start", 0.5).alias("mid_start"))
