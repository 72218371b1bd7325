"""Every operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandworks.llm import decontaminate as decontamination
from strandworks.llm import html_extract, quality, queries, secret_scan, sharding, topk
from strandworks.llm import near_dedup as nd
from strandworks.llm.common import LOWER, UPPER, ascii_lower
from strandworks.llm.decontaminate import contaminated, decontaminate
from strandworks.llm.html_blocks import Paths, blocks, bucket
from strandworks.llm.html_pages import Maker
from strandworks.llm.line_dedup import line_dedup
from strandworks.llm.mixing import mix_sources
from strandworks.llm.near_dedup import near_dedup
from strandworks.llm.substring_dedup import substring_dedup

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, source string, size string, spans int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def corpus(seed=1, n=90):
    """Invented documents, near and exact copies, shared lines and passages, odd cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeéßñ", k=r.randint(2, 6))) for _ in range(300)]
    make = lambda k: " ".join(r.choices(vocab, k=k))
    line, passage = "Shared LINE here", make(120)
    out = []
    for i in range(n):
        k = i % 9
        if k == 1 and out:
            text = r.choice(out)
        elif k == 2 and out:
            w = (r.choice(out) or "x").split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif k == 3:
            text = make(30) + "\n " + line.upper() + "\t\n" + make(5)
        elif k == 4:
            text = make(r.randint(0, 40)) + passage + make(20)
        elif k == 5:
            text = r.choice([None, "", " ", "\n", "a", "\n\n", "be " * 400])
        else:
            text = make(r.randint(1, 150)) + f' password = "{make(1)}123456" AKIA{"A" * r.randint(10, 20)} {"0af" * r.randint(5, 12)}'
        out.append(text)
    out.append(make(20_000))
    return [(i, t, r.choice(["a", "b", "é", None]), "clash", 1) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_line_dedup(spark, docs, rows):
    got = {r.doc_id: r for r in line_dedup(docs, min_docs=5).collect()}
    keys = collections.Counter(k for _, t, *_ in rows for k in {lower(x.strip(BLANK)) for x in (t or "").split("\n")})
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not lower(x.strip(BLANK)) or keys[lower(x.strip(BLANK))] < 5]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    twice = docs.where("doc_id < 3").unionAll(docs.where("doc_id < 3"))
    assert line_dedup(twice, min_docs=2).agg(F.sum("n_dropped")).first()[0] > 0
    assert twice.count() == line_dedup(twice, min_docs=2).count()
    assert line_dedup(docs.limit(0)).count() == 0


def test_mixing(spark, docs, rows):
    got = mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]} or free
        target |= {s: min(2 * sizes[s], left * weight[s] / total) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    taken = collections.Counter()
    for r in got:
        assert r.size == len(words(dict((x[0], x[1]) for x in rows)[r.doc_id])) and 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 for s in names)
    assert mix_sources(docs.limit(0)).count() == 0
    assert {r.taken for r in mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_contamination(spark, docs, rows):
    r = random.Random(2)
    whole = [t.split() for _, t, *_ in rows if t and len(t.split()) > 60]
    items = [(k, " ".join(w[5 : 5 + r.randint(12, 50)])) for k, w in enumerate(whole[:25])]
    items = [(k, t if k % 3 else " ".join("edit" if j == len(t.split()) // 2 and len(t.split()) > 45 else w for j, w in enumerate(t.split())).upper() if t.isascii() else t) for k, t in items]
    items += [(100, None), (101, ""), (102, "one two"), (103, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in contaminated(docs, bench).collect()}

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = {}
    for k, t in items:
        w = words(t)
        target = bag(w)
        for i, text, *_ in rows:
            d = words(text)
            if not target or not bag(d).keys() & target.keys():
                continue
            best = 0
            for at in range(max(1, len(d) - len(w) + 1)):
                b = bag(d[at : at + len(w)])
                best = max(best, sum((b & target).values()) / sum((b | target).values()))
            if best >= 0.8:
                want[i, k] = best
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {x[0] for x in rows} - {i for i, _ in want}
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert contaminated(docs.limit(0), bench).count() == 0


def test_contamination_in_another_order(spark):
    """Windows that no shared shingle aligns with the item: parts swapped, in longer documents."""
    item = [f"w{k}" for k in range(50)]
    texts = []
    for at in (17, 25, 33):
        texts.append([f"x{k}" for k in range(90)] + item[at:] + item[:at] + [f"y{k}" for k in range(90)])
    texts.append(texts[1][:115] + ["other"] + texts[1][115:])
    texts.append(item[30:] + item[15:30] + item[:15])
    texts.append(item[40:] + item[30:40] + item[20:30] + item[10:20] + item[:10])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.start_word, r.n_words, r.similarity) for r in contaminated(docs, bench).collect()}
    assert got == {i: (90, 50, 42 / 50) for i in range(3)} | {3: (90, 50, 41 / 51)}
    assert [r.doc_id for r in decontaminate(docs, bench).orderBy("doc_id").collect()] == [4, 5]


def test_near_dedup(spark, docs, rows):
    for size in (2, 5):
        sets = {}
        for i, t, *_ in rows:
            w = words(t)
            sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        comp = {i: i for i in sets}
        for i in sets:
            for j in sets:
                if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[j]:
                    a, b = comp[i], comp[j]
                    comp = {k: min(a, b) if c in (a, b) else c for k, c in comp.items()}
        got = near_dedup(docs, shingle=size).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert near_dedup(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y z"), (1, "x y z"), (1, "x y z"), (2, "x y z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup(odd).collect()) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]


def test_near_dedup_large_group(spark):
    """Hundreds of near copies go through several pivot rounds."""
    r = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(60)] = f"x{r.randrange(9999)}"
        texts.append(w)
    sets = [set(zip(w, w[1:])) for w in texts]
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    got = near_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), shingle=2)
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == comp


def test_substring_dedup(spark, docs, rows):
    length = 100
    got = {r.doc_id: r for r in substring_dedup(docs, length).collect()}
    bodies = {i: (t or "").encode() for i, t, *_ in rows}
    seen = collections.Counter(b[s : s + length] for b in bodies.values() for s in range(len(b) - length + 1))
    for i, b in bodies.items():
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                mark[s : s + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        spans = len(re.findall(b"\1+", bytes(mark)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(r.kept) == kept and len(r.spans) == spans
    assert substring_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(docs, 10)


def test_sharding(spark, docs, rows):
    got = sharding.shard_rows(docs, 7).collect()
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == len(rows)
    text = {i: (t or "").encode() for i, t, *_ in rows}
    for r in got:
        assert r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.size == len(text[r.doc_id]) + 8
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_rows(docs.repartition(3), 7).collect()))
    assert sharding.shard_rows(docs.limit(0), 7).count() == 0
    odd = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sharding.shard_rows(odd.unionAll(odd), 5).groupBy("shard").count().count() == 5


def test_ring_moves_few_rows():
    """With loads bounded at 1.25 of the mean, a new shard moves little beside what it takes."""
    r = random.Random(4)
    counts = collections.Counter(r.randrange(sharding.RING) for _ in range(20_000))

    def where(n):
        quota = int(1.25 * 20_000 / n) + 1
        plan = sharding.bounded_loads(counts, sharding.ring(n, 128), [quota] * n)
        assert all(sum(hi - lo for _, lo, hi, s, _ in plan if s == k) <= quota for k in range(n))
        return {(c, k): s for c, lo, hi, s, _ in plan for k in range(lo, hi)}

    before, after = where(24), where(25)
    moved = sum(before[k] != after[k] for k in before)
    assert sum(s == 24 for s in after.values()) / 20_000 <= moved / 20_000 < 0.12


def test_secret_scan(spark, docs, rows):
    odd = [(900, "api_key:token:abcdefgh"), (901, "é Passwd=x token : 'a.b/c+d=e' \x0b"), (902, "AKIA" + "A" * 16 + "AKIA"), (903, "secret=a " * 900 + "SECRET=abcdef " * 900)]
    every = [(r[0], r[1]) for r in rows] + odd
    got = secret_scan.secret_scan(spark.createDataFrame(every, "doc_id long, text string").withColumn("spans", F.lit(3)))
    found = 0
    for r in got.collect():
        want = []
        for k, rule in enumerate(secret_scan.RULES):
            want += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, r.text or "", re.A) if len(m[rule.group]) >= rule.least]
        assert [(s.start, s.kind, s.end) for s in r.spans] == sorted(want)
        found += len(want)
    assert found > 900
    q = secret_scan.trigram_query
    assert q("AKIA[A-Z]+") == [{"aki", "kia"}] and q("[0-9a-f]+") == [] and {"tok", "oke", "ken"} in q(secret_scan.RULES[0].pattern)
    plain = (secret_scan.Rule("any", "[0-9]+", 0, 3),)
    assert secret_scan.secret_scan(docs.limit(0), plain).count() == 0


@pytest.mark.parametrize("rows", [(4096, 2048), (20, 3)])
def test_top_k(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", rows[0])
    monkeypatch.setattr(topk, "QUERY_ROWS", rows[1])
    r = np.random.default_rng(3)
    centres = r.standard_normal((6, 8))
    v = centres[r.integers(0, 6, 300)] + 0.15 * r.standard_normal((300, 8))
    v *= r.choice([0.1, 0.5, 1, 4], 300)[:, None]
    v[200:204] = v[100]
    table = [(i, [float(np.float32(x)) for x in y]) for i, y in enumerate(v)]
    table += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (520, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(df, 5, 20).collect()}
    ok = {i: [int(np.floor(256 * x)) for x in y] for i, y in table if i is not None and y and all(x is not None and np.isfinite(x) for x in y)}
    want = {}
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q)[:5]
            want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1, 2)"), 5, 20).count() == 2
    clash = df.selectExpr("*", "1 AS rank", "'x' AS score", "2 AS query_id", "3 AS _sw_q").where("vec_id in (0, 1, 2)")
    odd = spark.createDataFrame([(40, [1.0, 2.0]), (41, [1.0, 2.0]), (40, [3.0, 1.0])], "vec_id long, embedding array<float>")
    both = topk.top_k(clash.select("vec_id", "embedding").union(odd), 5, 20)
    assert sorted((x.query_id, x.vec_id) for x in both.collect() if x.query_id == 40) == [(40, 41), (40, 41)]
    assert topk.top_k(clash, 5, 20).columns == ["query_id", "rank", "vec_id", "score"]


def test_block_search_prunes_nothing_wanted():
    r = np.random.default_rng(8)
    for scale in (0.05, 0.4, 2):
        base = r.standard_normal(16)
        cand = np.floor(256 * (base + scale * r.standard_normal((400, 16))))
        queries = np.floor(256 * (base + scale * r.standard_normal((30, 16))))
        exact = queries @ cand.T
        floor = np.sort(exact, 1)[:, -5]
        ids = np.arange(400)
        for q, (qid, found, scores) in enumerate(topk.search_block(cand, ids, queries, np.arange(1000, 1030), floor, 5)):
            order = np.lexsort((ids, -exact[q]))[:5]
            assert qid == 1000 + q and list(found) == list(order) and list(scores) == list(exact[q][order])


def test_quality(spark):
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]

    def make(kind):
        w = r.choices(vocab, k=r.randint(40, 150))
        if kind == 0:
            w = [x + r.choice(["***", "###"]) for x in w]
        if kind == 1:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["vile", "nasty"])
        return " ".join(w)

    kinds = [r.choice([0, 1, 2, 2, 2]) for _ in range(900)]
    texts = [make(k) for k in kinds]
    grades = np.array([2 if k == 2 else 1 for k in kinds])
    model = quality.fit(pa.array(texts[:600]), grades[:600])
    assert (np.diff(model.thresholds) >= 0).all()
    tails = np.concatenate([model.tails(p) for _, p in quality.features(pa.array(texts[600:]))])
    right = (tails[:, 1] >= 0.5) == (grades[600:] == 2)
    assert right.mean() > 0.93 and (tails[:, 0] >= tails[:, 1]).all()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(1000, None, 1.0), (1001, "", 1.0)], "doc_id long, text string, kept double")
    labels = spark.createDataFrame([(i, int(k != 0), int(k == 1)) for i, k in enumerate(kinds[:600])], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels)
    assert got.count() == 902 and got.where("doc_id >= 1000 and p_best is null").count() == 0
    kept = quality.quality_scores(docs, labels, filter_rows=True)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got.where("kept").collect()}
    assert quality.quality_scores(docs, labels.limit(0)).where("kept").count() == 902
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_html(spark):
    model = html_extract.trained()
    paths, right = Paths(), 0
    for n in range(150):
        maker = Maker(99_000_000 + n)
        found = blocks(maker.page(), paths)
        labels = model.label([found], paths)
        want = [t in maker.main and bucket("title") not in paths.items[p] for p, t in found]
        right += list(labels) == want
    assert right >= 138
    page = "<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body><nav><ul><li><a href='/'>home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n  two&nbsp;<b>three</b> words here.<p>Second &lt;one&gt; of them.<!-- no --></article><footer>&copy; x</footer>"
    rows = [(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (5, "<!-- open", "x"), (1, page, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_extract.extract_text(df, keep=["page_id"]).collect()
    want = "A & B\nOne two three words here.\nSecond <one> of them."
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, want, len(want))] * 2 + [(k, "", 0) for k in (2, 3, 4, 5)]
    assert html_extract.extract_text(df.limit(0)).count() == 0


def unlike_pages(r, n):
    """Pages of layouts and names that no training page has, with their paragraphs."""
    words = lambda lo, hi: " ".join("".join(r.choices(["ba", "ke", "lo", "mi", "tu", "ren", "sta"], k=r.randint(1, 3))) for _ in range(r.randint(lo, hi)))
    for k in range(n):
        own = [words(8, 50).capitalize() + "." for _ in range(r.randint(2, 10))]
        body, link = "".join(f"<p>{x}</p>" for x in own), lambda: f"<a href='x'>{words(1, 2)}</a>"
        if k % 3 == 0:
            page = f"<div class='vector-header'>{link()}<ul class='vector-menu'><li>{link()}</li><li>{link()}</li></ul></div><div class='mw-content-container'><div class='mw-content-ltr mw-parser-output'>{body}</div></div><div class='mw-footer-container'><ul><li>{words(5, 10)}.</li><li>{link()}</li></ul></div>"
        elif k % 3 == 1:
            page = f"<center><table border=1><tr><td bgcolor=#ccc>{link()} {link()} {link()}</td></tr><tr><td>{body}</td></tr><tr><td align=center><small>Copyright 2003 {words(1, 3)}</small></td></tr></table></center>"
        else:
            page = f"<div class='wrapper-x'><div class='hd'>{link()}</div><div class='bd'><div class='lft'>{body}</div><div class='rgt'><ul><li>{link()}</li><li>{link()}</li></ul></div></div><div class='ft'>&copy; {words(1, 3)}</div></div>"
        yield f"<html><head><title>{words(1, 4)}</title></head><body>{page}</body></html>", own


def test_html_of_unlike_layouts():
    model, paths, hits, wrong, lost = html_extract.trained(), Paths(), 0, 0, 0
    for page, own in unlike_pages(random.Random(5), 150):
        found = blocks(page, paths)
        taken = {t for (_, t), ok in zip(found, model.label([found], paths), strict=True) if ok}
        hits, wrong, lost = hits + len(taken & set(own)), wrong + len(taken - set(own)), lost + len(set(own) - taken)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + lost) > 0.95


def test_html_pages_of_any_length_together():
    model, paths = html_extract.trained(), Paths()
    pages = [blocks(Maker(n).page(), paths) for n in range(40)] + [[]]
    pages.append(blocks("<article>" + "<p>some words stand here.</p>" * 30_000 + "</article>", paths))
    alone = [model.label([p], paths) for p in pages]
    assert (model.label(pages, paths) == np.concatenate(alone)).all() and alone[-1].mean() > 0.9


def test_capitals_of_the_whole_block():
    paths = Paths()
    (path, _), = blocks("<p>text</p>", paths)
    x = html_extract.inputs([[(path, "a" * 200 + "B" * 200), (path, "a" * 400)]], paths)
    assert list(x[:, -1]) == [0.5, 0]


def test_ascii_lower(spark):
    letters = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c + "Az",) for c in letters], "t string")
    assert df.where(ascii_lower(F.col("t")) != F.translate("t", UPPER, LOWER)).count() == 0


def near_copies(seed, groups=2, each=70):
    """Groups of texts at mixed distances from a middle one, where few pairs link and many nearly do."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        middle = r.choices(vocab, k=120)
        for _ in range(each):
            p = r.choice([0, 0.02, 0.04, 0.06, 0.1, 0.15])
            out.append(" ".join(r.choice(vocab) if r.random() < p else w for w in middle))
    return out


def test_near_dedup_of_large_groups(spark, monkeypatch):
    """Hub, component and bucket cells, each dealt out as a grid; repeated doc_ids; against all pairs."""
    monkeypatch.setattr(nd, "CELL_SHINGLES", 2000)
    texts = near_copies(3)
    rows = list(enumerate(texts)) + [(5, texts[100]), (7, texts[130]), (5, texts[100]), (900, None), (901, ""), (902, "One"), (903, "one"), (None, texts[0])]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    sets = [(i, frozenset(tuple(words(t)[k : k + 2]) for k in range(max(1, len(words(t)) - 1))) if words(t) else frozenset()) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = [(i, len(s), find(i), find(i) == i) for i, s in sets]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted(want)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_decontamination_goes_through_the_blocks(spark, monkeypatch):
    """Without an equal block nothing is found; a pair within the radius is taken in its first equal block."""
    item = " ".join(f"q{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "a b c " + item + " d e"), (2, "z " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert contaminated(docs, bench).count() == 1
    monkeypatch.setattr(decontamination, "first_equal_block", lambda xor: F.lit(None).cast("int"))
    assert contaminated(docs, bench).count() == 0


def test_blocks_tile_the_bits(spark):
    parts = decontamination.blocks()
    assert sum(((1 << w) - 1) << at for at, w in parts) == (1 << 64) - 1 and len(parts) == decontamination.RADIUS + 1
    rows = [(1 << 63) - 1, 0, -1, -(1 << 63), 5]
    df = spark.createDataFrame([(x,) for x in rows], "x long").select("x", decontamination.first_equal_block(F.col("x")).alias("b"))
    for x, b in df.collect():
        assert b == next((i for i, (at, w) in enumerate(parts) if not (x >> at) & ((1 << w) - 1)), None)


def test_bags_count_repeats(spark):
    df = spark.createDataFrame([([3, 1, 3, 2, 3],), ([3, 2, 3, 9],)], "h array<long>")
    a, b = (set(r.x) for r in decontamination.with_bag(df, "h", "x").collect())
    assert len(a) == 5 and len(b) == 4 and len(a & b) == 3


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
