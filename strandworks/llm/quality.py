"""Quality classifier: ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .hashing import chunks, mix, not_alnum, sorted_sets, word_hashes

#: Buckets of hashed words (present or not) and of hashed byte trigrams (share of the text), then the shape features.
WORD_BITS, GRAM_BITS, SHAPES = 18, 15, 8
WORDS, GRAMS = 1 << WORD_BITS, 1 << GRAM_BITS
#: Labelled documents that the model is fitted on at most, and the documents a word must occur in to get a weight.
SAMPLE, MIN_DOCS = 3000, 10
#: Bytes of a word's beginnings that are features beside the word.
PREFIXES = (4, 6)
#: Log odds from which a word gets a weight.
LEAST_ODDS = 1.0
#: Mean word lengths above this look alike: such texts hold no words, and longer runs say nothing more.
LONGEST_MEAN = 50

_kind = np.zeros(256, np.uint8)  # 1 upper, 2 lower or non-ASCII, 3 digit, 4 blank, 5 other
_kind[:] = 5
_kind[65:91], _kind[97:123], _kind[128:], _kind[48:58] = 1, 2, 2, 3
_kind[[9, 10, 11, 12, 13, 32]] = 4


def _share(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off), 1)


@dataclass
class Parts:
    """Features of a slice of texts: distinct word buckets, trigram buckets, shapes."""

    words: np.ndarray
    word_off: np.ndarray
    grams: np.ndarray
    gram_off: np.ndarray
    shapes: np.ndarray


def features(column: pa.Array) -> Iterator[tuple[int, Parts]]:
    """(first row, features) for slices of a text column; null reads as empty, texts are read whole."""
    for row, body, off in chunks(column):
        h, at = word_hashes(body, off)
        n = np.diff(at)
        row_of = np.repeat(np.arange(len(n)), n)
        runs, runs_at = word_hashes(body, off, not_alnum, PREFIXES)
        runs_row = np.repeat(np.arange(len(n)), np.diff(runs_at))
        distinct, word_off = sorted_sets(runs & np.uint64(WORDS - 1), runs_row, len(n))
        code = np.zeros(len(body), np.uint64)
        wide = body.astype(np.uint64)
        code[:] = wide << np.uint64(16)
        code[:-1] |= wide[1:] << np.uint64(8)
        code[:-2] |= wide[2:]
        grams = (mix(code) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row_of[1:] == row_of[:-1])
        kind = _kind[body]
        words = np.maximum(n, 1)
        shapes = np.stack(
            [
                _share(same, at),
                np.diff(word_off) / words,
                np.log1p(n),
                _share(kind == 1, off),
                _share(kind == 5, off),
                _share(kind == 3, off),
                np.minimum(np.diff(off) / words, LONGEST_MEAN) / 10,
                _share(body == 10, off),
            ],
            axis=1,
        )
        yield row, Parts(distinct.astype(np.int64), word_off, grams, off, shapes)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def _log_odds(cells: np.ndarray, good: np.ndarray, size: int) -> np.ndarray:
    """How much more likely a word is in documents of the best grade than in others; 0 if rare or not telling against."""
    yes, no = np.bincount(cells[good], minlength=size) + 0.5, np.bincount(cells[~good], minlength=size) + 0.5
    out = np.log(yes / yes.sum()) - np.log(no / no.sum())
    out[(yes + no < MIN_DOCS + 1) | (out > -LEAST_ODDS)] = 0
    return out


@dataclass
class Model:
    """Shared weights and ordered thresholds: P(grade > k) = sigmoid(score - thresholds[k])."""

    words: np.ndarray
    grams: np.ndarray
    shapes: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    thresholds: np.ndarray

    def score(self, p: Parts) -> np.ndarray:
        out = _sums(self.words[p.words], p.word_off)
        out += _sums(self.grams[p.grams], p.gram_off) / np.maximum(np.diff(p.gram_off), 1)
        return out + ((p.shapes - self.centre) / self.spread) @ self.shapes

    def tails(self, p: Parts) -> np.ndarray:
        return _sigmoid(self.score(p)[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: pa.Array, grades: np.ndarray, rounds: int = 150, l2: float = 1e-4, l2_grams: float = 3e-2) -> Model:
    """Maximum likelihood by Adam over the whole sample.

    Words are scaled by their log odds, so that the penalty spares telling
    ones. Only words that tell against a document get a weight: what is good
    grows with the length of a text and would hide a few bad words.
    """
    n, top = len(texts), max(int(grades.max(initial=0)), 1)
    wi, wr, gi, gr, gv, shapes = [], [], [], [], [], []
    for row, p in features(texts):
        rows = len(p.shapes)
        wi.append(p.words)
        wr.append(row + np.repeat(np.arange(rows), np.diff(p.word_off)))
        owner = np.repeat(np.arange(rows), np.diff(p.gram_off))
        cell, count = np.unique(owner.astype(np.int64) * GRAMS + p.grams, return_counts=True)
        gi.append(cell % GRAMS)
        gr.append(row + cell // GRAMS)
        gv.append(count / np.maximum(np.diff(p.gram_off), 1)[cell // GRAMS])
        shapes.append(p.shapes)
    wi, wr, gi, gr, gv = (np.concatenate(x) for x in (wi, wr, gi, gr, gv))
    shapes = np.concatenate(shapes)
    ratio = _log_odds(wi, grades[wr] == top, WORDS)
    keep = ratio[wi] != 0
    wi, wr = wi[keep], wr[keep]
    ratio = ratio * 2
    wv = ratio[wi]
    centre, spread = shapes.mean(0), shapes.std(0) + 1e-6
    z = (shapes - centre) / spread
    # trigram shares are small, so their weights are learned at a larger scale
    gv = gv * 30
    params = [np.zeros(WORDS), np.zeros(GRAMS), np.zeros(SHAPES), np.linspace(-1, 1, top)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    at = np.arange(n)
    for t in range(1, rounds + 1):
        w, g, s, th = params
        score = np.bincount(wr, w[wi] * wv, n) + np.bincount(gr, g[gi] * gv, n) + z @ s
        above = _sigmoid(score[:, None] - th)  # P(grade > k)
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        like = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-9)
        slope = edges * (1 - edges)
        up, down = slope[at, grades] / like, slope[at, grades + 1] / like
        d_score = (down - up) / n
        d_th = np.zeros(top)
        np.add.at(d_th, grades[grades > 0] - 1, up[grades > 0] / n)
        np.add.at(d_th, grades[grades < top], -down[grades < top] / n)
        grads = [
            np.bincount(wi, d_score[wr] * wv, WORDS) + l2 * w,
            np.bincount(gi, d_score[gr] * gv, GRAMS) + l2_grams * g,
            z.T @ d_score + l2_grams * s,
            d_th,
        ]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            params[i] = params[i] - 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-6)
        params[3] = np.maximum.accumulate(params[3])
    return Model(params[0] * ratio, params[1] * 30, params[2], centre, spread, params[3])


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, sample: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and grades of at most ``sample`` labelled documents, chosen by a hash of the id.

    The grade counts what is good about a document: 0, 1 or 2 for quality
    and for not being toxic; null labels do not count as good. Of the texts of
    a repeated doc_id the smallest is taken.
    """
    grade = F.coalesce(F.col("quality").cast("int"), F.lit(0)) + 1 - F.coalesce(F.col("toxic").cast("int"), F.lit(1))
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("_sw_grade"))
    chosen = chosen.orderBy(F.xxhash64(F.col("doc_id"), F.lit(6))).limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_sw_text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("_sw_text").alias("_sw_text"), F.min("_sw_grade").alias("_sw_grade"))
    table = rows.toArrow().sort_by([("doc_id", "ascending")])
    return table["_sw_text"].combine_chunks(), np.clip(table["_sw_grade"].to_numpy(), 0, 2).astype(int)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    sample: int = SAMPLE,
    least: float = 0.5,
    filter_rows: bool = False,
) -> DataFrame:
    """Scores every document with an ordinal model fitted on a bounded labelled sample.

    Hashed words, hashed byte trigrams and shapes of the text share one weight
    vector; ordered thresholds turn its score into P(grade > k). ``kept`` is
    P(grade = best) >= ``least``: documents that are junk or toxic go.

    Returns ``doc_id, expected_grade, p_middle`` (grade 1 or more), ``p_best``
    (grade 2) and ``kept``, one row per input row; with ``filter_rows`` the
    input columns of the kept rows instead. Defined cases: null and empty
    texts are scored as empty; no labels at all, or labels of one grade, keep
    everything; repeated labels of a document count once with the lowest
    grade; repeated rows are scored alike; an empty table gives an empty
    result; other columns, whatever their names, are left out or, with
    ``filter_rows``, returned as they are.

    The sample (at most ``sample`` labelled documents, read whole) is fitted on
    the driver; scoring is one pass without a shuffle.
    """
    texts, grades = labelled_sample(docs, labels, text, doc_id, sample)
    model = fit(texts, grades) if len(grades) and grades.min() < grades.max() else None
    held = docs.sparkSession.sparkContext.broadcast(model)

    def tails(column: pa.Array) -> np.ndarray:
        out = np.ones((len(column), 2))
        if held.value is not None:
            for row, p in features(column.cast(pa.string())):
                got = held.value.tails(p)
                out[row : row + len(got), 0], out[row : row + len(got), 1] = got[:, 0], got[:, -1]
        return out

    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(tails(batch.column(place))[:, 1] >= least))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tails(batch.column(1))
            columns = [batch.column(0), pa.array(t.sum(1)), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array(t[:, 1] >= least)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "p_middle", "p_best", "kept"])

    if filter_rows:
        return docs.mapInArrow(kept, docs.schema)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_sw_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, expected_grade double, p_middle double, p_best double, kept boolean")
