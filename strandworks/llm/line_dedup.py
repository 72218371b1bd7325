"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, hash128, semi_join, text_of, with_row_key


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Drops every line whose key occurs in at least ``min_docs`` documents.

    The normalised lines are exploded as 128-bit hashes, the documents of each
    hash are counted (once per document, combined before the shuffle), the
    positions that carry a frequent hash are gathered per document, and the
    document is put together from the other positions.

    Returns the input columns, with ``text`` rewritten, plus ``n_lines`` and
    ``n_dropped``. Defined cases: null or empty text is one empty line and
    becomes the empty string; keys shorter than ``min_chars`` code points are
    never dropped; repeated rows are documents of their own in the counts; an
    empty table gives an empty result; input columns named like a result
    column are replaced.

    Lines are normalised and hashed once and kept as 16 bytes each. The
    frequent hashes are counted and, up to a bound, broadcast, so that a key
    that a third of all lines share makes no partition of its own; above the
    bound they are joined by a shuffle whose large partitions AQE splits.
    Counts are combined before their shuffle; each text is shuffled once.
    """
    base = with_row_key(docs, doc_id, text)
    lines = F.split(text_of(text), "\n", -1)

    def hashed(line: Column) -> Column:
        key = line_key(line)
        h1, h2 = hash128(key)
        return F.when(F.char_length(key) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))

    keys = cut(base.select("_sw_k1", "_sw_k2", F.transform(lines, hashed).alias("_sw_h")))
    frequent = (
        keys.select(F.explode(F.array_distinct("_sw_h")).alias("h"))
        .where("h is not null")
        .groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2")
    )
    places = (
        keys.select("_sw_k1", "_sw_k2", F.posexplode("_sw_h").alias("pos", "h"))
        .where("h is not null")
        .select("_sw_k1", "_sw_k2", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    )
    drops = semi_join(places, cut(frequent), ["h1", "h2"])
    drops = drops.groupBy("_sw_k1", "_sw_k2").agg(F.collect_set("pos").alias("_sw_drop"))
    n = F.size("_sw_lines")
    kept = F.when(F.col("_sw_drop").isNull(), F.col("_sw_lines")).otherwise(
        F.transform(
            F.array_except(F.sequence(F.lit(0), n - 1), F.col("_sw_drop")), lambda i: F.element_at("_sw_lines", i + 1)
        )
    )
    return (
        base.join(drops, ["_sw_k1", "_sw_k2"], "left")
        .withColumn("_sw_lines", lines)
        .withColumn("_sw_kept", kept)
        .withColumns(
            {
                text: F.concat_ws("\n", "_sw_kept"),
                "n_lines": n.cast("long"),
                "n_dropped": (n - F.size("_sw_kept")).cast("long"),
            }
        )
        .drop("_sw_k1", "_sw_k2", "_sw_drop", "_sw_lines", "_sw_kept")
    )
