"""Multiple alignment of the reads of a group around their most central read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(a: str, b: str, opening: float, extension: float, match: float, mismatch: float, band: int) -> tuple[float, list[int]]:
    """Global affine alignment in a band: score and moves from the start (0 both, 1 only a, 2 only b).

    Only the band's cells are worked out and stored, one byte each.
    """
    n, m = len(a), len(b)
    band = max(band, abs(n - m) + 1)
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    low, step = -1e18, opening + extension
    # rows have a cell of the band's edge at both sides; cell k of row i is column i - band - 1 + k
    width = 2 * band + 3
    inside = lambda i: slice(max(0, i - band) - i + band + 1, min(m, i + band) - i + band + 2)
    h, up = np.full(width, low), np.full(width, low)
    first = min(m, band)
    h[band + 1 : band + 2 + first] = -(opening + extension * np.arange(first + 1))
    h[band + 1] = 0
    way = np.full((n + 1, width), 2, np.uint8)
    offsets = extension * np.arange(width)
    for i in range(1, n + 1):
        s = inside(i)
        start, stop = s.start + i - band - 1, s.stop + i - band - 1
        above = slice(s.start + 1, s.stop + 1)
        now, now_up = np.full(width, low), np.full(width, low)
        now_up[s] = np.maximum(h[above] - step, up[above] - extension)
        diag = np.full(stop - start, low)
        skip = int(start == 0)
        diag[skip:] = h[s.start + skip : s.stop] + np.where(y[start + skip - 1 : stop - 1] == x[i - 1], match, mismatch)
        best = np.maximum(diag, now_up[s])
        # a gap along the row: the best start so far, with its extension taken off
        run = np.maximum.accumulate(best - opening + offsets[: len(best)])
        side = np.concatenate([[low], run[:-1] - offsets[1 : len(best)]])
        way[i, s] = np.where((diag >= now_up[s]) & (diag >= side), 0, np.where(now_up[s] >= side, 1, 2))
        now[s] = np.maximum(best, side)
        h, up = now, now_up
    moves, i, j = [], n, m
    while i or j:
        k = 2 if i == 0 else 1 if j == 0 else int(way[i, j - i + band + 1])
        moves.append(k)
        i, j = i - (k != 2), j - (k != 1)
    return float(h[m - n + band + 1]), moves[::-1]


def kmers(s: str, k: int = 6) -> set[str]:
    return {s[i : i + k] for i in range(max(1, len(s) - k + 1))}


def center_star(seqs: list[str], opening: float = 5, extension: float = 1, match: float = 0, mismatch: float = -1, band: int = 100) -> list[str]:
    """Rows of equal width whose gaps taken out are the input, in input order; one read passes through."""
    if len(seqs) < 2:
        return list(seqs)
    sets = [kmers(s) for s in seqs]
    shared: dict[str, int] = {}
    for s in sets:
        for k in s:
            shared[k] = shared.get(k, 0) + 1
    centre = max(range(len(seqs)), key=lambda i: (sum(shared[k] for k in sets[i]) / len(sets[i]), -i))
    star, moves_of = seqs[centre], []
    room = np.zeros(len(star) + 1, int)  # widest insertion before each base of the centre
    for s in seqs:
        moves = pair(star, s, opening, extension, match, mismatch, band)[1]
        moves_of.append(moves)
        at, run = 0, 0
        for k in [*moves, 0]:
            if k == 2:
                run += 1
                continue
            room[at] = max(room[at], run)
            at, run = at + 1, 0
            if at > len(star):
                break
    out = []
    for s, moves in zip(seqs, moves_of, strict=True):
        row, at, j, inserted = [], 0, 0, ""
        for k in moves:
            if k == 2:
                inserted += s[j]
                j += 1
                continue
            row.append(inserted.ljust(room[at], "-"))
            row.append(s[j] if k == 0 else "-")
            j, at, inserted = j + (k == 0), at + 1, ""
        row.append(inserted.ljust(room[at], "-"))
        out.append("".join(row))
    return out


def multi_read_align(reads: DataFrame, opening: float = 5, extension: float = 1, match: float = 0, mismatch: float = -1, band: int = 100) -> DataFrame:
    """``group_id, aln, quals``: one multiple alignment per group, rows in the order of read_idx.

    Groups of one read stay in the JVM. Gap costs have their documented
    meaning. A null group_id is one group.
    """
    cols = ["read_idx", "seq", "qual"] if "qual" in reads.columns else ["read_idx", "seq"]
    rows = F.sort_array(F.collect_list(F.struct(*cols)))
    groups = reads.groupBy("group_id").agg(rows.alias("r"))
    groups = groups.select("group_id", F.transform("r", lambda x: x["seq"]).alias("aln"), *[F.transform("r", lambda x: x["qual"]).alias("quals")] * ("qual" in cols))

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([center_star(list(x), opening, extension, match, mismatch, band) for x in s])

    # declared so that no filter is moved below it with the rows still unaligned
    one = groups.where(F.size("aln") == 1)
    return one.unionByName(groups.where(F.size("aln") > 1).withColumn("aln", run.asNondeterministic()("aln")))
