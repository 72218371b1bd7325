"""The pipeline's run against its stages one by one."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefgh", k=5)) for _ in range(500)]
    item = " ".join(r.choices(vocab, k=30))
    docs, labels = [], []
    for i in range(160):
        w = r.choices(vocab, k=80)
        junk = i % 8 == 0
        text = " ".join(x + "###" for x in w) if junk else " ".join(w)
        if i in (41, 42):
            text += " " + item
        if i in (51, 52):
            text = docs[50][1] if i == 51 else docs[50][1] + " more"
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not junk), 0))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    current = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        assert k == 4 or out.columns == current.columns
        out.write.parquet(str(tmp_path / "out" / name))
        current = spark.read.parquet(str(tmp_path / "out" / name))
        seen.append([x.doc_id for x in current.collect()])
    clean = {i for i in range(160) if i % 8}
    assert set(seen[0]) == clean
    assert set(seen[1]) == clean - {51, 52}
    assert set(seen[2]) == clean - {51, 52, 41, 42}
    assert set(seen[3]) <= set(seen[2]) and 1.3 < len(seen[3]) / len(seen[2]) < 1.7
    assert sorted(seen[4]) == sorted(seen[3])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, current.collect()))


def test_doc_ids_repeated_over_texts(spark):
    """Rows of one doc_id go or stay together, and every component keeps its first document."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (11, c), (12, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 11, False)}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [3, 11]
