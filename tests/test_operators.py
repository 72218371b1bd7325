import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks import queries
from strandworks.functions import sequences as S
from strandworks.operators import alignment as A
from strandworks.operators import consensus as C
from strandworks.operators import errors as E
from strandworks.operators import msa as M
from strandworks.operators import statistics as T
from strandworks.operators import umi as U
from strandworks.operators.components import components
from strandworks.sources import fastq, sam


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_sequence_functions(spark):
    assert one(spark, S.reverse_complement(F.lit("ACGTMRWSYKVHDBN-"))) == "-NVHDBMRSWYKACGT"
    assert S.ambiguous_runs("AAAAGGNNNNCCTTTT") == [(7, 10)]
    assert S.ambiguous_runs("AAAAGGCCTTTTRRRR") == [(13, 16)]
    assert one(spark, S.left_clip(F.lit("4H5S10M3S"))) == 9
    assert one(spark, S.right_clip(F.lit("4H5S10M3S"))) == 3
    assert one(spark, S.cigar_width(F.lit("4H5S10M2I3D1N2=3S"))) == 16
    assert one(spark, S.quality_mask(F.lit("ACGT"), F.lit("!5I4"), 0.01)) == "NCGN"
    assert one(spark, S.phred_char(F.lit(math.log(0.01)))) == "5"
    assert one(spark, S.unmask(F.lit("AN-GT"), F.lit("ACGT"))) == "AC-GT"
    for aligned, original in (("AA-AA", "AAA"), ("NNNNN", "AAA")):
        with pytest.raises(Exception):
            one(spark, S.unmask(F.lit(aligned), F.lit(original)))
    first, table = S.error_table("solexa")
    assert first == 59 and math.isclose(table[5], 0.5)


def test_adaptor_align(spark):
    seq, qual = "AACGTAACGTACGTACGTGGGGGGG", "1234567890ABCDEFGHIJKLMNO"
    back = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = spark.createDataFrame([(0, "a", seq, qual), (1, "b", back, qual[::-1])], "read_idx long, read_name string, seq string, qual string")
    p = A.AlignParams("AANNNAA", "CCCCCCC")
    x, y = A.adaptor_align(reads, p).orderBy("read_idx").collect()
    assert (x.reversed, y.reversed) == (False, True)
    assert (x.adaptor1.start, x.adaptor1.end, x.adaptor2.start, x.adaptor2.end) == (1, 7, 25, 19)
    assert x.adaptor1 == y.adaptor1 and x.adaptor2.score == y.adaptor2.score
    assert x.adaptor1.subseq.Sub1.seq == "CGT"
    kept = A.filter_reads(A.adaptor_align(reads, p), 1, 1)
    real = A.realize_reads(kept, reads).collect()
    assert {r.seq for r in real} == {seq[7:18]}
    parts = A.extract_subseq(A.adaptor_align(reads, p), reads, p, [(3, 5)], []).collect()
    assert {tuple(r.subseq1) for r in parts} == {("CGT",)}
    assert A.adaptor_align(reads.limit(0), p).count() == 0
    with pytest.raises(Exception):
        A.realize_reads(kept.withColumn("read_name", F.lit("zz")), reads).collect()


def test_barcodes(spark):
    reads = spark.createDataFrame([(0, "ACGTACGT", "IIIIIIII"), (1, "TTTTCCCC", "IIIIIIII")], "read_idx long, seq string, qual string")
    got = {r.read_idx: r for r in A.barcode_align(reads, ["TTTTCCCC", "acgtacgt", "ACGTACGT"]).collect()}
    assert got[0].barcode == 2 and got[0].gap == 0 and got[1].barcode == 1 and got[1].gap > 10
    assert A.barcode_align(reads, ["ACGT"]).first().gap == float("inf")


def test_statistics(spark):
    rows = [(False, float(x)) for x in (1, 2, 3, 4)] + [(True, 1.5)]
    assert T.fdr_threshold(spark.createDataFrame(rows, "fake boolean, score double"), 0.01).first()[0] == 2
    for shift, want in ((-10, 1), (0, 0.5), (-0.5, 0.55), (0.5, 0.45), (10, 0)):
        both = [(False, float(i)) for i in range(1, 11)] + [(True, i + float(shift)) for i in range(1, 11)]
        assert math.isclose(T.tied_overlap(spark.createDataFrame(both, "fake boolean, score double")).first()[0], want)
    empty = spark.createDataFrame([], "read_idx long, read_name string, seq string, qual string")
    got = A.tune_alignment(empty, A.AlignParams("ACGT", "GGTT"), range(4, 5), range(1, 2)).first()
    assert got.go is None and got.ge is None


def test_tuning_query_is_whole(spark, monkeypatch):
    """The registered query has the operator's grid and sample."""
    seen, tune_scores = [], A.tune_scores
    monkeypatch.setattr(queries.A, "tune_scores", lambda reads, p, go, ge, seed: seen.append((reads.count(), list(go), list(ge))) or tune_scores(reads.limit(5), p, go[:1], ge[:1], seed))
    reads = spark.range(10_050).selectExpr("id AS read_idx", "concat('read', id) AS read_name", "repeat('ACGT', 25) AS seq", "repeat('I', 100) AS qual")
    monkeypatch.setattr(queries.D, "tagged_reads", lambda *_: reads)
    queries.QUERIES["o57_tune_alignment"](spark, "")
    assert seen == [(10_000, list(range(4, 11)), list(range(1, 6)))]


def test_consensus(spark):
    rows = [(1, ["AA-C", "AAGC", "ANGC", "TAG-"]), (2, ["ACGT"]), (3, [])]
    got = {r.group_id: r for r in C.basic_consensus(spark.createDataFrame(rows, "group_id long, aln array<string>")).collect()}
    assert got[1].seq == "AAGC" and got[2].seq == "ACGT" and got[3].seq == "" and got[3].qual == ""
    assert math.isclose(got[1].log_error[0], math.log1p(-(3 + 0.25) / 5))
    with pytest.raises(Exception):
        C.basic_consensus(spark.createDataFrame([(1, ["A", "AC"])], "group_id long, aln array<string>")).collect()
    q = spark.createDataFrame([(1, ["A", "C"], ["I", "5"])], "group_id long, aln array<string>, quals array<string>")
    r = C.consensus_reads(q, 0.5).first()
    e1, e2 = 1e-4, 1e-2
    like = {"A": (1 - e1) * e2 / 3, "C": e1 / 3 * (1 - e2), "G": e1 * e2 / 9, "T": e1 * e2 / 9}
    assert r.seq == "A" and math.isclose(r.log_error[0], math.log(1 - like["A"] / sum(like.values())), rel_tol=1e-6)


def test_homopolymers(spark):
    got = E.homopolymers(spark.createDataFrame([(0, "ATGG--GGCCGTTTAA")], "read_idx long, seq string"))
    assert sorted((r.start, r.width, r.base) for r in got.collect()) == [(3, 4, "G"), (7, 2, "C"), (10, 3, "T"), (13, 2, "A")]
    r = random.Random(5)
    pairs = []
    for i in range(60):
        n = r.randint(1, 25)
        pairs.append((i, "".join(r.choices("AACC-G", k=n)), "".join(r.choices("AACC-", k=n))))
    df = spark.createDataFrame(pairs, "read_idx long, ref_aln string, read_aln string")
    got = sorted((x.read_idx, x.start, x.observed) for x in E.match_homopolymers(df).collect())
    assert got == sorted(y for i, a, b in pairs for y in plain_matches(i, a, b))


def plain_matches(i, ref, obs):
    spots = [(k, c) for k, c in enumerate(ref) if c != "-"]
    runs, at = [], 0
    while at < len(spots):
        end = at
        while end + 1 < len(spots) and spots[end + 1][1] == spots[at][1]:
            end += 1
        runs.append((at, end))
        at = end + 1
    for a, b in runs:
        if a == b:
            continue
        lo, hi = spots[a - 1][0] + 1 if a else 0, spots[b + 1][0] if b + 1 < len(spots) else len(ref)
        best = 0
        for m in re.finditer(r"([^-])(?:-*\1)*", obs[lo:hi]):
            if m[1] == spots[a][1] and m.start() + lo <= spots[b][0] and m.end() + lo > spots[a][0]:
                best = max(best, len(m[0].replace("-", "")))
        yield i, a + 1, best


def test_errors(spark):
    df = spark.createDataFrame([(0, "AAA--GGGG", "AAAATGGGG"), (1, "AAAGGGG", "AC-GGGG")], "read_idx long, ref_aln string, read_aln string")
    got = {r.pos: r for r in E.error_profile(df).collect()}
    assert len(got) == 8 and got[8].base is None
    assert [(x.len, x.freq) for x in got[4].insertion] == [(0, 1), (2, 1)]
    assert (got[2].A, got[2].C, got[3].deletion) == (1, 1, 1)
    assert {r.base: r.C for r in E.transitions(E.error_profile(df)).collect()} == {"A": 1, "G": 0}
    for bad in ([(0, "AC", "AN")], [(0, "AC", "A")], [(0, "AC", "AC"), (1, "ACG", "ACG")]):
        with pytest.raises(Exception):
            E.error_profile(spark.createDataFrame(bad, "read_idx long, ref_aln string, read_aln string")).collect()


def test_umis(spark):
    s = "ACAGCTAGC"
    for k in range(len(s)):
        masked = s[:k] + "N" + s[k + 1 :]
        assert U.masked_distance(s, masked) == U.masked_distance(masked, masked) == 0.5
    assert U.masked_distance("", "ACG") == 3
    r = random.Random(3)
    rows = [(i, str(i % 3), "".join(r.choices("ACGN", k=r.randint(3, 5), weights=[5, 5, 5, 1]))) for i in range(120)]
    df = spark.createDataFrame(rows, "read_idx long, pre_group string, umi1 string")
    near = {}
    for i, g, a in rows:
        near[i] = {j for j, h, b in rows if g == h and U.masked_distance(a, b) <= 1}
    got = {}
    for x in U.neighbours(df, 1).collect():
        got.setdefault(x.a, set()).add(x.b)
    assert got == {i: n for i, n in near.items() if n}
    clusters = {}
    for x in U.umi_group(df, 1).collect():
        clusters.setdefault(x.cluster_id, set()).add(x.read_idx)
    assert sorted(map(sorted, clusters.values())) == sorted(plain_greedy(near))
    assert sorted(map(sorted, U.greedy_clusters(near))) == sorted(plain_greedy(near))


def test_umis_with_nulls_and_repeats(spark):
    rows = [(1, None, "ACGT"), (2, None, "ACGT"), (3, "g", None), (4, "g", "NNNN"), (5, "g", "ACGT"), (6, "g", "ACGA"), (7, "g", "ACGT"), (8, "h", "")]
    got = {r.read_idx: r.cluster_id for r in U.umi_group(spark.createDataFrame(rows, "read_idx long, pre_group string, umi1 string"), 1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}
    assert U.umi_group(spark.createDataFrame(rows[:1], "read_idx long, pre_group string, umi1 string").limit(0), 1).count() == 0


def test_masked_distances_of_many_pairs():
    r = random.Random(4)
    a, b = (["".join(r.choices("ACGTN", k=r.randint(0, 9))) for _ in range(200)] for _ in "ab")

    def plain(x, y):
        last = [float(j) for j in range(len(y) + 1)]
        for i, p in enumerate(x, 1):
            row = [float(i)]
            for j, q in enumerate(y, 1):
                row.append(min(last[j - 1] + (0.5 if "N" in (p, q) else p != q), last[j] + 1, row[-1] + 1))
            last = row
        return last[-1]

    assert U.masked_distances(a, b).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_tiles_of_distances():
    r = random.Random(5)
    for letters, longest, room in (("ACGTN", 9, 1 << 21), ("ACGTN", 9, 100), ("ACGé😀", 150, 1 << 12), ("N", 0, 1)):
        a, b = (["".join(r.choices(letters, k=r.randint(0, longest))) for _ in range(n)] for n in (21, 17))
        got = {(p + k, q + m): d / 2 for p, q, tile in U.distance_tiles(a, b, room) for (k, m), d in np.ndenumerate(tile)}
        assert got == {(k, m): U.masked_distance(x, y) for k, x in enumerate(a) for m, y in enumerate(b)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_expected_distances_in_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(U, "BLOCK", 8, raising=False)
    r = random.Random(6)
    as_id = int if kind == "long" else "r{}".format
    rows = [(as_id(k), "".join(r.choices("ACGTN", k=r.randint(0, 9)))) for k in range(45)]
    # repeated ids have no pair with each other, a null id has none at all, a null text no distance
    rows += [(as_id(3), "ACG"), (as_id(3), "ACG"), (None, "ACG"), (as_id(50), None)]
    df = spark.createDataFrame(rows, f"read_idx {kind}, seq string").coalesce(1)
    out = U.expected_distances(df)
    assert out.rdd.getNumPartitions() > 1
    want = [(i, j, None if None in (x, y) else U.masked_distance(x, y)) for i, x in rows for j, y in rows if None not in (i, j) and i < j]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert U.expected_distances(df.limit(0)).count() == U.expected_distances(df.limit(1)).count() == 0


def test_components_by_rounds_and_in_one_task(spark):
    r = random.Random(8)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    for small in (0, 20, 10_000):
        assert {x.node: x.comp for x in components(edges, small).collect()} == want


def plain_greedy(links):
    out = [[n] for n in links if links[n] <= {n}]
    free = {n for n in links if not links[n] <= {n}}
    while free:
        centre = max(free, key=lambda n: (len(links[n] & free), n))
        members = (links[centre] & free) | {centre}
        out.append(sorted(members))
        free -= members
    return out


def test_msa(spark):
    r = random.Random(1)
    base = "".join(r.choices("ACGT", k=60))
    seqs = []
    for _ in range(8):
        s = list(base)
        for _ in range(5):
            k = r.randrange(len(s))
            s[k] = r.choice(["", "A", "CC", s[k]])
        seqs.append("".join(s))
    rows = M.center_star(seqs)
    assert len({len(x) for x in rows}) == 1 and [x.replace("-", "") for x in rows] == seqs
    assert M.center_star(["ACG"]) == ["ACG"]
    df = spark.createDataFrame([(1, i, s, "I" * len(s)) for i, s in enumerate(seqs)] + [(2, 99, "ACGT", "IIII")], "group_id long, read_idx long, seq string, qual string")
    aligned = M.multi_read_align(df)
    cons = {x.group_id: x.seq for x in C.consensus_reads(aligned).collect()}
    assert cons[2] == "ACGT" and U.masked_distance(cons[1], base) <= 3


def test_multiple_alignment_query_is_whole(spark, monkeypatch):
    """The registered query aligns the whole reads."""
    r = random.Random(6)
    rows = [(i, f"read{i}", "".join(r.choices("ACGT", k=64)), "".join(r.choices("5?I", k=64))) for i in range(9)]
    reads = spark.createDataFrame(rows, "read_idx long, read_name string, seq string, qual string")
    monkeypatch.setattr(queries.D, "reads", lambda *_: reads)
    got = queries.QUERIES["o39_multi_read_align"](spark, "").orderBy("group_id").collect()
    assert [x.replace("-", "") for g in got for x in g.aln.split("|")] == [s for _, _, s, _ in rows]
    assert [x for g in got for x in g.quals.split(" ")] == [q for *_, q in rows]


def test_sources(spark, tmp_path):
    reads = fastq.mock_reads(spark, 3, 4, 50, "ACGT", "GGTT", seed=2).cache()
    fastq.write_fastq(reads, str(tmp_path / "r"))
    back = fastq.read_fastq(spark, str(tmp_path / "r"))
    key = lambda df: sorted((x.read_name, x.seq, x.qual) for x in df.collect())
    assert key(back) == key(reads) and back.select("read_idx").distinct().count() == 12
    assert key(fastq.sample_fastq(reads, 5, 1)) == key(fastq.sample_fastq(reads, 5, 1))
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception):
        fastq.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "x.sam").write_text("@HD\tVN:1\n@SQ\tSN:c1\tLN:50\nr1\t16\tc1\t3\t20\t2S4M\t*\nr2\t4\t*\t0\t0\t*\t*\nr3\t0\tc1\t5\t5\t4M\nr4\t0\tc1\t5\t50\t4M1D\n")
    got = sam.sam_ranges(spark, str(tmp_path / "x.sam")).collect()
    assert sorted((r.qname, r.start, r.width, r.strand, r.left_clip) for r in got) == [("r1", 3, 4, "-", 2), ("r4", 5, 5, "+", 0)]
    assert sam.sam_ranges(spark, str(tmp_path / "x.sam"), drop_first=True).count() == 1
    assert {r.rname: r.length for r in sam.sam_header(spark.read.text(str(tmp_path / "x.sam"))).collect()} == {"c1": 50, "*": 0}


def test_fastq_in_many_splits(spark, tmp_path):
    r = random.Random(9)
    rows = {}
    for name in ("b.fq", "a.fq"):
        reads = [("@" * r.randint(0, 3) + f"{name}{i}", "".join(r.choices("ACGT", k=n)), "@" * n) for i, n in enumerate(r.choices(range(0, 30), k=300))]
        (tmp_path / name).write_text("".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in reads))
        rows[name] = reads
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [(x.read_name, x.seq, x.qual) for x in fastq.read_fastq(spark, str(tmp_path)).orderBy("read_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == rows["a.fq"] + rows["b.fq"]


def test_mock_reads_with_barcodes(spark):
    got = fastq.mock_reads(spark, 4, 6, 30, "ACNNGGGGTT", "", 0, barcodes=["AAAA", "CCCC"], barcode_position=(5, 8)).collect()
    tables = str.maketrans("ACGT", "TGCA")
    fronts = {}
    for x in got:
        both = (x.seq, x.seq.translate(tables)[::-1])
        fronts.setdefault(x.read_idx // 6, set()).update(s[:10] for s in both if re.match("AC..(AAAA|CCCC)TT", s))
    assert len(fronts) == 4 and all(len(f) == 1 for f in fronts.values())
    with pytest.raises(ValueError):
        fastq.mock_reads(spark, barcodes=["AAA"], barcode_position=(5, 8))


def test_running_sums_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.random() < 0.3, float(r.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(rows, "part string, fake boolean, score double")
    got = {x.part: (x.threshold, x.overlap) for x in T.fdr_threshold(df, 0.2, ["part"]).join(T.tied_overlap(df, ["part"]).withColumnRenamed("part", "q"), F.expr("part <=> q")).collect()}
    for part in ("a", "b", None):
        real, fake = ([s for p, f, s in rows if p == part and f == kind] for kind in (False, True))
        share = lambda s: sum(f > s for f in fake) / (sum(x >= s for x in real) - 1)  # noqa: B023, E731
        fit = [s for s in real if sum(x >= s for x in real) > 1 and share(s) <= 0.2]
        won = sum((f < s) + (f == s) / 2 for s in real for f in fake) / (len(real) * len(fake))
        assert got[part][0] == min(fit) and math.isclose(got[part][1], won)
    for n in (1, 2, 7, 100):
        values = sorted(r.choices(range(30), k=n))
        one_row = T.exact_median(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), F.col("v"), "m").first()
        assert one_row.m == (values[(n - 1) // 2] + values[n // 2]) / 2
    assert T.exact_median(spark.createDataFrame([], "v double"), F.col("v"), "m").first().m is None


def test_thresholds_of_aligned_reads_and_tuned_scores(spark):
    reads = fastq.mock_reads(spark, 3, 5, 40, "ACGTNNACGGT", "GGTTCCAAT", 0.02, 1).cache()
    p = A.AlignParams("ACGTNNACGGT", "GGTTCCAAT", tolerance=30)
    rounded = lambda df: sorted((x.adaptor, x.fake, round(x.score, 6)) for x in df.collect())
    aligned = A.adaptor_align(reads, p)
    assert rounded(T.adaptor_scores(reads, p)) == rounded(T.adaptor_scores(reads, p, aligned=aligned))
    with pytest.raises(Exception):
        T.adaptor_scores(reads, p, aligned=aligned.where("read_idx > 3")).collect()
    best, scores = A.tuned(reads, p, range(4, 6), range(1, 3))
    best = best.first()
    assert scores.where("fake").count() == scores.where("not fake").count() == 15
    assert math.isclose(T.tied_overlap(scores).first()[0], best.overlap)


def test_long_reads(spark):
    """No step takes the square of the length."""
    r = random.Random(7)
    a = "".join(r.choices("ACGT", k=20_000))
    b = a[:7000] + a[7040:12_000] + "ACGTA" + a[12_000:]
    score, moves = M.pair(a, b, 5, 1, 0, -1, 100)
    assert len(moves) == 20_005 and score >= -(5 + 40) - (5 + 5)
    df = spark.createDataFrame([(0, a * 5, "I" * 100_000)], "read_idx long, seq string, qual string")
    masked = df.withColumn("aligned", F.concat(F.lit("--"), F.regexp_replace("seq", "A", "N")))
    assert masked.select(S.unmask(F.col("aligned"), F.col("seq"))).first()[0] == "--" + a * 5
    mixed = A.scrambled(df, 1).first()
    assert sorted(mixed.seq) == sorted(a * 5) and mixed.seq != a * 5
    runs = E.homopolymers(df).collect()
    assert [(x.start - 1, x.width) for x in runs] == [(m.start(), len(m[0])) for m in re.finditer(r"(.)\1+", a * 5)]


def test_bases_outside_homopolymers(spark):
    pairs = spark.createDataFrame([(0, "ACCG-T", "ACTGAT"), (1, None, "A")], "read_idx long, ref_aln string, read_aln string")
    runs = E.homopolymers(spark.createDataFrame([(0, "ACCGT")], "read_idx long, seq string"))
    left = E.outside_homopolymers(E.error_profile(pairs), runs)
    assert sorted(x.pos for x in left.collect()) == [1, 4, 5, 6]
    assert {x.base: x["T"] for x in E.transitions(left).collect()} == {"A": 0, "G": 0, "T": 1}
    nothing = pairs.limit(0)
    assert E.error_profile(nothing).count() == E.match_homopolymers(nothing).count() == 0
