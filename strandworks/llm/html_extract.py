"""Main-text extraction by a recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import word_hashes
from .html_blocks import PATH_DIM, Paths, blocks, bucket
from .html_pages import Maker

#: Buckets of hashed words, further inputs (length, end of sentence, share of capitals), and units of each direction.
WORD_DIM, MORE, HIDDEN = 32, 3, 20
INPUT = PATH_DIM + WORD_DIM + MORE
#: Pages and bytes of pages read together, and pages of the training set.
BATCH_PAGES, BATCH_BYTES, TRAINING_PAGES = 256, 1 << 23, 2000
#: Share of training pages that lose path items in a round, and of items that they lose.
LOSING_PAGES, LOST_ITEMS = 0.25, 0.5
#: Blocks, padding included, that go through the network at once; a longer page goes alone.
CELLS = 1 << 14

Page = list[tuple[int, str]]


def inputs(pages: list[Page], paths: Paths) -> np.ndarray:
    """One row per block of all pages: tag-path vector, hashed-word vector, shape."""
    rows = [b for p in pages for b in p]
    x = np.zeros((len(rows), INPUT), np.float32)
    if not rows:
        return x
    number = np.array([p for p, _ in rows])
    for path in np.unique(number):
        at = np.flatnonzero(number == path)
        x[np.ix_(at, paths.items[path])] = 1
    raw = [t.encode() for _, t in rows]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    h, at = word_hashes(np.frombuffer(b"".join(raw), np.uint8), off)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(rows)), n)
    cell = owner * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(rows) * WORD_DIM).reshape(len(rows), WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.maximum(n, 1)[:, None]
    x[:, -3] = np.log1p(n) / 4
    x[:, -2] = [t[-1] in ".!?" for _, t in rows]
    x[:, -1] = [sum(map(str.isupper, t)) / len(t) for _, t in rows]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, page) -> row of x for both directions, and which cells are blocks."""
    steps = int(sizes.max(initial=0))
    t = np.arange(steps)[:, None]
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    live = t < sizes
    forth = np.where(live, start + t, 0)
    back = np.where(live, start + sizes - 1 - t, 0)
    return forth, back, live


def run_lstm(z: np.ndarray, u: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Outputs per step for inputs ``z`` (already multiplied and biased), recurrent weights ``u``."""
    steps, pages, _ = z.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        a = z[t] + h @ u
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        s = np.tanh(c)
        m = live[t][:, None]
        h, c = np.where(m, o * s, before[0]), np.where(m, c, before[1])
        out[t] = h
        if keep:
            tape.append((i, f, o, g, s, *before, m))
    return out, tape


def back_lstm(d_out: np.ndarray, tape: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients for the inputs ``z`` and for ``u``."""
    steps, pages, _ = d_out.shape
    dz, du = np.zeros((steps, pages, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, s, h0, c0, m = tape[t]
        total = dh + d_out[t]
        inner = np.where(m, total, 0)
        d_c = np.where(m, dc, 0) + inner * o * (1 - s * s)
        a = np.concatenate([d_c * g * i * (1 - i), d_c * c0 * f * (1 - f), inner * s * o * (1 - o), d_c * i * (1 - g * g)], 1)
        dz[t] = a
        du += h0.T @ a
        dh = np.where(m, a @ u.T, total)
        dc = np.where(m, d_c * f, dc)
    return dz, du


class Labeller:
    """A bidirectional LSTM; every block's label sees the whole page's blocks."""

    def __init__(self, seed: int) -> None:
        r = np.random.default_rng(seed)
        f32 = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {k + d: v for d in "fb" for k, v in (("w", f32(INPUT, 4 * HIDDEN)), ("u", f32(HIDDEN, 4 * HIDDEN)), ("b", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.p["b" + d][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"v": f32(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        order = dict(zip("fb", padded(x, sizes)[:2], strict=True))
        live = padded(x, sizes)[2]
        out, tapes = np.zeros((len(x), 2 * HIDDEN), np.float32), {}
        for n, d in enumerate("fb"):
            z = x @ self.p["w" + d] + self.p["b" + d]
            h, tapes[d] = run_lstm(z[order[d]], self.p["u" + d], live, keep)
            out[order[d][live], n * HIDDEN : (n + 1) * HIDDEN] = h[live]
        return out @ self.p["v"] + self.p["c"], out, order, live, tapes

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        score, out, order, live, tapes = self.forward(x, sizes, True)
        d = ((_sigmoid(score) - y) / len(y)).astype(np.float32)
        grads = {"v": out.T @ d, "c": d.sum(keepdims=True)}
        d_out = d[:, None] * self.p["v"]
        for n, k in enumerate("fb"):
            stepwise = np.zeros((*live.shape, HIDDEN), np.float32)
            stepwise[live] = d_out[order[k][live], n * HIDDEN : (n + 1) * HIDDEN]
            dz, grads["u" + k] = back_lstm(stepwise, tapes[k], self.p["u" + k])
            flat = np.zeros((len(x), 4 * HIDDEN), np.float32)
            flat[order[k][live]] = dz[live]
            grads["w" + k], grads["b" + k] = x.T @ flat, flat.sum(0)
        return grads

    def label(self, pages: list[Page], paths: Paths) -> np.ndarray:
        """Labels of all blocks. Pages of like length go together, so that padding stays small."""
        sizes = np.array([len(p) for p in pages], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])
        out, order, at = np.zeros(start[-1], bool), np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * sizes[order[end]] <= CELLS:
                end += 1
            some, at = order[at:end], end
            if sizes[some].sum():
                labels = self.forward(inputs([pages[i] for i in some], paths), sizes[some])[0] > 0
                out[np.concatenate([np.arange(start[i], start[i + 1]) for i in some])] = labels
        return out


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, rounds: int = 13, seed: int = 1) -> Labeller:
    """The labeller fitted by Adam to invented pages whose main text is known; the same for the same arguments."""
    paths, data = Paths(), []
    for n in range(pages):
        maker = Maker(seed * 1_000_003 + n)
        found = blocks(maker.page(), paths)
        if found:
            # the last block of a page that breaks off is the beginning of a known one
            cut_off = any(m.startswith(found[-1][1]) for m in maker.main)
            title = bucket("title")
            y = [t in maker.main and title not in paths.items[p] for p, t in found]
            y[-1] = y[-1] or cut_off
            data.append((found, y))
    model = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    r, t = np.random.default_rng(seed), 0
    for epoch in range(rounds):
        order = r.permutation(len(data))
        for at in range(0, len(order), 35):
            some = [data[i] for i in order[at : at + 35]]
            sizes = np.array([len(p) for p, _ in some])
            y = np.concatenate([np.array(y, np.float32) for _, y in some])
            x = inputs([p for p, _ in some], paths)
            # early on, some pages lose part of their path items, so that words and shapes carry names never seen
            dropped = (epoch < rounds - 3) & (r.random((len(some), PATH_DIM)) < LOST_ITEMS) & (r.random((len(some), 1)) < LOSING_PAGES)
            x[:, :PATH_DIM] *= ~np.repeat(dropped, sizes, axis=0)
            grads, t = model.gradients(x, sizes, y), t + 1
            rate = 0.02 if epoch < rounds - 3 else 0.005
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return model


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The main text of every page: its blocks that the labeller takes for the article, joined by newlines.

    Blocks are maximal runs of text between block-level tags, character
    references decoded, white space turned into single spaces. Scripts,
    styles, comments and other raw elements are never blocks.

    Returns the columns ``keep`` (default: all but ``html``) plus ``text`` and
    ``n_chars`` (code points). Defined cases: null, empty and text-less pages
    give an empty text; an unfinished tag or comment at the end is dropped;
    repeated rows are extracted alike; clashing ``text`` and ``n_chars``
    columns are replaced; an empty table gives an empty result.

    One pass without a shuffle; a task holds BATCH_PAGES pages or BATCH_BYTES at a time.
    """
    names = [c for c in (keep or [c for c in pages.columns if c != html]) if c not in ("text", "n_chars")]
    held = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(*names, F.col(html).cast("string").alias("_sw_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.num_columns - 1)
            total = np.cumsum(pc.fill_null(pc.binary_length(source), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES, "right"))
                end = max(at + 1, min(end, at + BATCH_PAGES))
                paths = Paths()  # they grow with the pages
                found = [blocks(h or "", paths) for h in source.slice(at, end - at).to_pylist()]
                labels, texts, pos = held.value.label(found, paths), [], 0
                for page in found:
                    texts.append("\n".join(t for (_, t), ok in zip(page, labels[pos : pos + len(page)], strict=True) if ok))
                    pos += len(page)
                extra = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns[:-1], *extra], [*names, "text", "n_chars"])
                at = end

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
