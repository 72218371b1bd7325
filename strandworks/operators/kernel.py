"""Quality-aware affine alignment of many reads against one reference, anti-diagonal by anti-diagonal.

Every numpy step handles one anti-diagonal of all reads of a batch. Row i
counts read bases, column j reference bases. A gap of k bases costs
``opening + k * extension``. In local mode read bases before and after the
reference are free; reference bases are always charged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandworks.functions.sequences import error_table

#: How many bases an IUPAC letter stands for.
CLASS = {**dict.fromkeys("ACGT", 1), **dict.fromkeys("MRWSYK", 2), **dict.fromkeys("VHDB", 3), "N": 4}
MEMBERS = {"M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT"}
#: Best ending of a cell, and whether a gap that ends there is longer than one base.
DIAGONAL, LEFT, UP, ENDING, LEFT_LONGER, UP_LONGER = 0, 1, 2, 3, 4, 8
#: Cells of stored endings that a batch holds at most, one byte each.
CELLS = 32_000_000


def score_tables(kind: str = "phred") -> tuple[int, np.ndarray, np.ndarray]:
    """(first quality code, match scores, mismatch scores); rows are letter classes 1 to 4."""
    first, table = error_table(kind)
    e = np.array(table)
    share = 1 / np.arange(1, 5)[:, None]
    with np.errstate(divide="ignore"):
        match = np.log2(share * (1 - e) * 4 + (1 - share) * e * 4 / 3)
        mismatch = np.log2((1 - share) * (1 - e) * 4 + share * e * 4 / 3)
    match[3] = 0.0
    return first, match, mismatch


@dataclass(frozen=True)
class Settings:
    """``iupac`` "compat" scores two- and three-base letters alike for every observed base; "strict" looks at the base."""

    opening: float = 5
    extension: float = 1
    local: bool = True
    kind: str = "phred"
    iupac: str = "compat"


def encode(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("latin-1"), np.uint8)
    return out


def gains(reference: str, seqs: list[str], quals: list[str], s: Settings) -> list[np.ndarray]:
    """For each reference base the (read, read base) scores of pairing the two."""
    if any(c not in CLASS for c in reference):
        raise ValueError(f"unknown reference base in '{reference}'")
    if any(len(a) != len(b) for a, b in zip(seqs, quals, strict=True)):
        raise ValueError("sequence and quality strings should have the same length")
    n = max(map(len, seqs), default=0)
    first, match, mismatch = score_tables(s.kind)
    seen, code = encode(seqs, n), encode(quals, n).astype(int) - first
    code[np.arange(n) >= np.array([len(x) for x in seqs], int)[:, None]] = 0
    if (code < 0).any():
        raise ValueError("quality character below the encoding")
    code = np.minimum(code, match.shape[1] - 1)
    table = {}
    for letter in set(reference):
        k = CLASS[letter] - 1
        inside = np.isin(seen, np.frombuffer(MEMBERS.get(letter, letter).encode(), np.uint8))
        if letter == "N":
            table[letter] = np.zeros(code.shape)
        elif k and s.iupac == "compat":
            table[letter] = (mismatch if k == 1 else match)[k][code]
        else:
            table[letter] = np.where(inside, match[k][code], mismatch[0][code])
    return [table[c] for c in reference]


def align(reference: str, seqs: list[str], quals: list[str], s: Settings, endings: bool):
    """Scores of a batch, and with ``endings`` the (diagonal, read, column) array that :func:`walk` reads.

    Three states per cell: the best alignment, the best that ends with a
    reference base in a gap (left), the best that ends with a read base in one
    (up). Of equal endings up is preferred to left and left to diagonal.
    """
    gain = gains(reference, seqs, quals, s)
    lengths = np.array([len(x) for x in seqs], int)
    b, n, width = len(seqs), int(lengths.max(initial=0)), len(reference)
    begin = lambda k: -(s.opening + s.extension * k)
    if width == 0:
        return np.where((lengths > 0) & (not s.local), begin(lengths), 0.0), None
    # a read base beside the last reference base is free in local mode
    charged = np.ones(width + 1)
    charged[-1] = not s.local
    nothing = np.full((b, width + 1), -np.inf)
    best, older, left, up = nothing, nothing, nothing, nothing
    out = np.zeros(b)
    tape = np.zeros((n + width + 1, b, width + 1), np.uint8) if endings else None
    for d in range(n + width + 1):
        now, now_left, now_up = nothing.copy(), nothing.copy(), nothing.copy()
        lo, hi = max(1, d - n), min(width, d - 1)
        if lo <= hi:
            here, beside = slice(lo, hi + 1), slice(lo - 1, hi)
            pair = np.stack([gain[j - 1][:, d - j - 1] for j in range(lo, hi + 1)], axis=1)
            straight = older[:, beside] + pair
            opened, longer = best[:, beside] + begin(1), left[:, beside] - s.extension
            long_left, now_left[:, here] = longer > opened, np.maximum(opened, longer)
            opened, longer = best[:, here] + begin(1) * charged[here], up[:, here] - s.extension * charged[here]
            long_up, now_up[:, here] = longer > opened, np.maximum(opened, longer)
            gap = np.maximum(now_left, now_up)[:, here]
            now[:, here] = np.maximum(straight, gap)
            if endings:
                side = np.where(now_left > now_up, LEFT, UP)[:, here]
                tape[d, :, here] = (np.where(straight > gap, DIAGONAL, side) + long_left * LEFT_LONGER + long_up * UP_LONGER).astype(np.uint8)
        if d <= n:
            now[:, 0] = 0 if s.local or d == 0 else begin(d)
        if 0 < d <= width:
            now[:, d] = begin(d)
        ended = lengths + width == d
        out[ended] = now[ended, width]
        best, older, left, up = now, best, now_left, now_up
    return out, tape


@dataclass(frozen=True)
class Spans:
    """How many read bases one alignment has used before and after each reference base."""

    before: np.ndarray
    after: np.ndarray

    def whole(self) -> tuple[int, int]:
        """First and last read base under the reference, 1-based; (0, 0) if there is none."""
        if not len(self.after) or self.before[0] == self.after[-1]:
            return 0, 0
        return int(self.before[0]) + 1, int(self.after[-1])

    def section(self, first: int, last: int, length: int) -> tuple[int, int]:
        """(start, width) of the read bases between the reference bases around a section."""
        if not len(self.after):
            return 1, 0
        used = self.after[first - 2] if first > 1 else 0
        until = self.before[last] if last < len(self.before) else length
        return int(used) + 1, int(until - used)

    def gapped(self, reference: str, query: str) -> tuple[str, str]:
        """Both strings with dashes."""
        a, b, used = [], [], 0
        for letter, start, stop in zip(reference, self.before.tolist(), self.after.tolist(), strict=True):
            a.append("-" * (start - used) + letter)
            b.append(query[used:stop] if stop > start else query[used:start] + "-")
            used = stop
        return "".join(a) + "-" * (len(query) - used), "".join(b) + query[used:]


def walk(tape: np.ndarray | None, lengths: np.ndarray, width: int) -> list[Spans]:
    """The spans of each read's best alignment; all reads of the batch step back at once."""
    before, after = np.zeros((len(lengths), width), int), np.zeros((len(lengths), width), int)
    i, j, inside = lengths.copy(), np.full(len(lengths), width), np.zeros(len(lengths), int)
    # in row 0 only reference bases are left, and none has used a read base
    while len(on := np.flatnonzero((i > 0) & (j > 0))):
        r, c = i[on], j[on]
        cell = tape[r + c, on, c]
        move = np.where(inside[on] > 0, inside[on], cell & ENDING)
        across, down = move != UP, move != LEFT
        after[on[across], c[across] - 1] = r[across]
        before[on[across], c[across] - 1] = (r - down)[across]
        longer = np.where(move == LEFT, cell & LEFT_LONGER, np.where(move == UP, cell & UP_LONGER, 0)) > 0
        inside[on] = np.where(longer, move, 0)
        i[on], j[on] = r - down, c - across
    return [Spans(x, y) for x, y in zip(before, after, strict=True)]


def batches(seqs: list[str], width: int, directions: bool):
    """Row numbers, sorted by length, in batches whose directions fit."""
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    at = 0
    while at < len(order):
        size = 512
        while size > 1 and directions:
            longest = len(seqs[order[min(at + size, len(order)) - 1]])
            if size * (longest + width + 1) * (width + 1) <= CELLS:
                break
            size //= 2
        yield order[at : at + size]
        at += size


def scores(reference: str, seqs: list[str], quals: list[str], s: Settings) -> list[float]:
    out = [0.0] * len(seqs)
    for part in batches(seqs, len(reference), False):
        got, _ = align(reference, [seqs[i] for i in part], [quals[i] for i in part], s, False)
        for i, x in zip(part, got, strict=True):
            out[i] = float(x)
    return out


def traced(reference: str, seqs: list[str], quals: list[str], s: Settings) -> list[tuple[float, Spans]]:
    """Score and spans of each read."""
    out: list = [None] * len(seqs)
    for part in batches(seqs, len(reference), True):
        got, tape = align(reference, [seqs[i] for i in part], [quals[i] for i in part], s, True)
        spans = walk(tape, np.array([len(seqs[i]) for i in part], int), len(reference))
        for i, x, y in zip(part, got, spans, strict=True):
            out[i] = (float(x), y)
    return out
