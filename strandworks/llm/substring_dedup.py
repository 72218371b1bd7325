"""Exact removal of repeated substrings by depth-limited most-significant-digit passes.

A plain radix sort would carry one row for every byte. Here the first digit is
read only where it is needed: each window of ``length`` bytes is assigned to
the place of the smallest hash of a gram inside it, which depends on the
window's bytes alone, so equal windows are assigned to equal grams at equal
distances, and about two of ``length - gram`` places stand for all windows.
Three passes read ever longer digits: the gram, the part that all windows of a
cell of 23 distances share, the window itself. Groups of one drop out after
each pass, and a group whose members agree on all bytes that its windows touch
is settled at once. The equal groups that remain in the last pass are exactly
the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, semi_join, with_row_key
from .hashing import _INVERSE, _ROOT, _table, chunks, mix, powers

#: Bytes of a gram, distances that form a cell, and bytes of a document handled at once.
GRAM, CELL, SLICE = 32, 23, 1 << 21
_LOW = np.uint64((1 << 26) - 1)
KEY = ["_sw_k1", "_sw_k2"]
ID = "_sw_k1 long, _sw_k2 long"


class Sums:
    """Hashes of any ranges of a byte array."""

    def __init__(self, body: np.ndarray) -> None:
        n = len(body)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_table[body] * powers(_ROOT, max(n, 1))[:n], out=self.total[1:])
        self.shift = powers(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.shift[starts] + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` items, by prefix and suffix minima of blocks."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def owned_runs(body: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one owner: (first start, last start, owner, gram hash, hash of all their bytes)."""
    if len(body) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums = Sums(body)
    at = np.arange(len(body) - GRAM + 1)
    gram = sums.of(at, at + GRAM)
    owner = (sliding_min((gram & ~_LOW) | at.astype(np.uint64), length - GRAM + 1) & _LOW).astype(np.int64)
    row = np.searchsorted(off, np.arange(len(owner)), "right")
    valid = np.arange(len(owner)) + length <= off[np.minimum(row, len(off) - 1)]
    new = valid.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | ~valid[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    return lo, hi, owner[lo], gram[owner[lo]], sums.of(lo, hi + length)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names)


def first_digit(length: int):
    """For mapInArrow over (key, text): the owned runs of every text with the first outer and inner digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "lo", "hi", "at", "outer", "inner"]
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, body, off in chunks(batch.column(2)):
                # a very long text is read in slices that overlap by all but one byte of a window
                for start in range(0, max(len(body), 1), SLICE) if len(off) == 2 else [0]:
                    part = body[start : start + SLICE + length - 1] if len(off) == 2 else body
                    ends = np.array([0, len(part)]) if len(off) == 2 else off
                    lo, hi, at, outer, inner = owned_runs(part, ends, length)
                    r = np.searchsorted(ends, lo, "right") - 1
                    shift = start - ends[r]
                    yield _batch([k1[row + r], k2[row + r], lo + shift, hi + shift, at + shift, outer, inner], names)

    return run, f"{ID}, lo long, hi long, at long, outer long, inner long"


def with_bytes(length: int):
    """For mapInArrow over (key, text, runs): the bytes that each run's windows touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = (batch.column(2)[i].as_py() or "").encode()
                runs = batch.column(3)[i].as_py()
                n = len(runs)
                yield _batch(
                    [
                        [batch.column(0)[i].as_py()] * n,
                        [batch.column(1)[i].as_py()] * n,
                        *[np.array([x[k] for x in runs], np.int64) for k in ("lo", "hi", "at", "outer")],
                        [body[x["lo"] : x["hi"] + length] for x in runs],
                    ],
                    [*KEY, "lo", "hi", "at", "gram", "body"],
                )

    return run, f"{ID}, lo long, hi long, at long, gram long, body binary"


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices repeated, and the integers from first to last of each."""
    n = last - first + 1
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owner]


def next_digits(length: int, windows: bool):
    """For mapInArrow over runs with bytes: their cells, or with ``windows`` their single windows in the wanted cells.

    A cell holds the windows whose gram lies 23 c to 23 c + 22 bytes after
    their start. Its outer digit hashes the bytes that all of them share; the
    inner one those that any of them touches, if the run owns the whole cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, lo, hi, at, gram = (batch.column(i).to_numpy() for i in range(6))
            bodies = batch.column(6).to_pylist()
            base = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])[:-1]
            sums = Sums(np.frombuffer(b"".join(bodies), np.uint8))
            near, far = at - hi, at - lo
            if windows:
                cells = batch.column(7).to_pylist()
                which = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
                cell = np.array([c for x in cells for c in x], np.int64)
                o, d = _ranges(np.maximum(cell * CELL, near[which]), np.minimum(cell * CELL + CELL - 1, far[which]))
                r = which[o]
                start = at[r] - d
                s = base[r] + start - lo[r]
                columns = [k1[r], k2[r], start, start, sums.of(s, s + length // 2), sums.of(s + length // 2, s + length)]
                yield _batch(columns, [*KEY, "lo", "hi", "outer", "inner"])
                continue
            r, c = _ranges(near // CELL, far // CELL)
            whole = (c * CELL >= near[r]) & (c * CELL + CELL - 1 <= far[r])
            p = base[r] + at[r] - lo[r]
            core_start, core_end = p - c * CELL, p - c * CELL - CELL + 1 + length
            outer = mix(sums.of(core_start, core_end) + c.astype(np.uint64) + mix(gram[r].view(np.uint64)))
            alone = mix(k1[r].view(np.uint64) + mix(k2[r].view(np.uint64) + mix(at[r].astype(np.uint64) * np.uint64(64) + c.astype(np.uint64)) + lo[r].astype(np.uint64)))
            w0, w1 = np.where(whole, p - c * CELL - CELL + 1, 0), np.where(whole, p - c * CELL + length, 0)
            inner = np.where(whole, sums.of(w0, w1), alone)
            first, last = at[r] - np.minimum(c * CELL + CELL - 1, far[r]), at[r] - np.maximum(c * CELL, near[r])
            yield _batch([k1[r], k2[r], first, last, lo[r], c, outer, inner], [*KEY, "lo", "hi", "run", "cell", "outer", "inner"])

    extra = "" if windows else "run long, cell long, "
    return run, f"{ID}, lo long, hi long, {extra}outer long, inner long"


def split_groups(rows: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(settled rows, one row for each distinct member of groups that need a further digit).

    Rows are settled if another has the same outer and inner digit. A group
    that agrees on the outer digit alone goes on with one row per inner digit.
    """
    if last:
        groups = rows.groupBy("outer", "inner").agg(F.count("*").alias("n")).where("n > 1").select("outer", "inner")
        return rows.join(groups, ["outer", "inner"]), None
    groups = rows.groupBy("outer").agg(F.count("*").alias("n"), F.min("inner").alias("i0"), F.max("inner").alias("i1"))
    shared = cut(rows.join(groups.where("n > 1").select("outer", (F.col("i0") != F.col("i1")).alias("mixed")), "outer"))
    same = shared.groupBy("outer", "inner").agg(F.count("*").alias("n")).where("n > 1").select("outer", "inner")
    settled = shared.join(same, ["outer", "inner"])
    payload = [c for c in rows.columns if c not in ("outer", "inner")]
    onward = shared.where("mixed").groupBy("outer", "inner").agg(F.min(F.struct(*payload)).alias("r"))
    return settled, onward.select("outer", "r.*")


def removed(length: int):
    """For mapInArrow over (id, text, intervals): what is left of the bytes, and its figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = (text.as_py() or "").encode()
                if (spans := spans.values) is None or not len(spans):
                    out.append((len(body), 0, 0, body, []))
                    continue
                lo, hi = spans.field(0).to_numpy(), spans.field(1).to_numpy() + length
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                new = np.ones(len(lo), bool)
                new[1:] = lo[1:] > reach[:-1]
                starts = lo[new]
                ends = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]
                edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(body), len(body) - len(kept), len(starts), kept, np.stack([starts, ends], 1).tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
                    pa.array([hashlib.sha256(r[3]).hexdigest() for r in out], pa.string()),
                    pa.array([r[3] for r in out], pa.binary()),
                    pa.array([r[4] for r in out], pa.list_(pa.list_(pa.int64()))),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    return run


def substring_dedup(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Removes every byte that a ``length``-byte string covers which also starts anywhere else.

    Texts are UTF-8; matches never cross documents, may overlap themselves,
    and are judged on the input. Returns ``doc_id, n_bytes, n_removed,
    n_spans, kept_sha256``, the remaining bytes ``kept`` and the removed
    ``spans``. Strings count as equal when two 64-bit hashes of them are.

    Defined cases: null text is empty; texts shorter than ``length`` keep all;
    repeated rows are documents of their own, so from ``length`` bytes on they
    lose all; an empty table gives an empty result; other columns are left out.

    About one row of 56 bytes per 185 bytes of text is shuffled, grouped by
    digits with partial counts, so that a passage shared by a third of all
    documents makes no large group; texts are shuffled once, for the result.
    """
    if length < 2 * GRAM + CELL or length > 1 << 16:
        raise ValueError(f"length must be from {2 * GRAM + CELL} to {1 << 16}")
    base = with_row_key(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), *KEY, F.col(text).cast("string").alias("_sw_text"))
    run, schema = first_digit(length)
    # read twice, as writing the runs down would cost more disk than working them out again costs time
    runs = base.select(*KEY, "_sw_text").mapInArrow(run, schema)
    done, onward = split_groups(runs)
    spans = [done.select(*KEY, "lo", "hi")]
    onward = cut(onward.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi", "at", "outer")).alias("runs")))
    held = semi_join(base.select(*KEY, "_sw_text"), onward.select(*KEY), KEY).dropDuplicates(KEY)
    run, schema = with_bytes(length)
    bodies = cut(held.join(onward, KEY).mapInArrow(run, schema))
    run, schema = next_digits(length, windows=False)
    done, cells = split_groups(bodies.mapInArrow(run, schema))
    spans.append(done.select(*KEY, "lo", "hi"))
    wanted = cells.groupBy(*KEY, F.col("run").alias("lo")).agg(F.collect_set("cell").alias("cells"))
    run, schema = next_digits(length, windows=True)
    done, _ = split_groups(cut(bodies.join(wanted, [*KEY, "lo"]).select(*KEY, "lo", "hi", "at", "gram", "body", "cells").mapInArrow(run, schema)), last=True)
    spans.append(done.select(*KEY, "lo", "hi"))
    all_spans = spans[0].unionByName(spans[1]).unionByName(spans[2])
    found = all_spans.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("_sw_spans"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return (
        base.join(found, KEY, "left")
        .select("doc_id", "_sw_text", "_sw_spans")
        .mapInArrow(
            removed(length),
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>",
        )
    )

