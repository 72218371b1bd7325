"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .html_extract import extract_text
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_dedup
from .quality import quality_scores
from .secret_scan import RULES, secret_scan
from .sharding import shard_rows
from .substring_dedup import substring_dedup
from .topk import top_k


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, length=400).drop("kept", "spans")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sources(docs, weights=(5, 2, 1), share=1.5, max_repeats=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, read(spark, sf_dir, "benchmark")).drop("_sw_k1", "_sw_k2")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, read(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, every=50, scale=256)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan(docs, RULES)
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    counts = {f"n_{r.kind}": F.size(F.filter("spans", lambda s: s["name"] == r.kind)).cast("long") for r in RULES}  # noqa: B023
    return out.select("doc_id", *[c.alias(n) for n, c in counts.items()], joined.alias("spans")).select(
        "doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extraction,
        op2_substring_dedup,
        op3_line_dedup,
        op4_mixing,
        op5_decontamination,
        op6_quality_classifier,
        op7_sharding,
        op8_near_dedup,
        op9_top_k,
        op10_secret_scan,
    )
    return {f.__name__: f for f in found}


LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


SUBSTRING_DEDUP_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT rid, o, substr(h, 2 * o + 1, 1822) AS part FROM d, range(0, length(h) // 2 - 399, 512) t(o)
), w AS (
  SELECT rid, o + i AS i, md5(substr(part, 2 * i + 1, 800)) AS k FROM b, range(0, least(512, length(part) // 2 - 399)) t(i)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1
), g AS (
  SELECT rid, i, sum(CASE WHEN i <= last + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS span
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM r)
), s AS (
  SELECT rid, span, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY rid, span
), k AS (
  SELECT rid, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS done,
         string_agg(substr(h, 2 * last + 1, 2 * (lo - last)), '' ORDER BY lo) AS kept
  FROM (SELECT s.*, h, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS last FROM s JOIN d USING (rid)) GROUP BY rid
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM d, range(1, CASE WHEN len(w) = 1 THEN 2 ELSE len(w) END) t(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (
  SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), c AS (
  SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a
), l AS (
  SELECT a AS doc_id, min(b) AS least_id FROM c GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id,
       least(doc_id, coalesce(least_id, doc_id)) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def secret_scan_sql() -> str:
    """Gaps and matches of each kind alternate, so running sums of their lengths are the positions."""
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS place, '{r.kind}' AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, "
        f"regexp_extract_all(t, '{p}', {r.group}) AS keys, {r.least} AS least FROM d"
        for k, r in enumerate(RULES)
        for p in [r.pattern.replace("'", "''")]
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({kinds}),
u AS (SELECT doc_id, place, kind, least, i, gaps[i] AS gap, hits[i] AS hit, keys[i] AS key FROM (SELECT *, generate_subscripts(hits, 1) AS i FROM m)),
x AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, place ORDER BY i) AS stop FROM u),
f AS (SELECT doc_id, {counts}, string_agg(kind || ':' || (stop - length(hit)) || ':' || stop, ',' ORDER BY stop - length(hit), place) AS spans
      FROM x WHERE length(key) >= least GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": SUBSTRING_DEDUP_SQL,
        "op3_line_dedup": LINE_DEDUP_SQL,
        "op8_near_dedup": NEAR_DEDUP_SQL,
        "op9_top_k": TOP_K_SQL,
        "op10_secret_scan": secret_scan_sql(),
    }
