"""Word and shingle hashes of whole Arrow string columns, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
#: Separators of letter and digit runs: every other ASCII byte.
not_alnum = np.array([not chr(b).isalnum() for b in range(128)] + [False] * 128)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_table = mix(np.arange(1, 257, dtype=np.uint64) * _U(_ROOT))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = held
    return held[:n]


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of slices of about CHUNK_BYTES; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK_BYTES, "right")) - 1)
        yield row, body[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_hashes(body: np.ndarray, off: np.ndarray, separators: np.ndarray = _blank, limits: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the offsets of each row's words.

    With ``limits``, each word gives a hash of its first so many bytes for
    each limit as well, one after another.
    """
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~separators[body]
    cuts = np.zeros(n + 1, bool)
    cuts[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cuts[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cuts[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_table[_lower[body]] * powers(_ROOT, n), out=total[1:])
    shift = powers(_INVERSE, n)[starts]
    h = mix((total[ends] - total[starts]) * shift)
    at = np.searchsorted(starts, off)
    if limits:
        cut = [mix((total[np.minimum(ends, starts + b)] - total[starts]) * shift + _U(b)) for b in limits]
        h, at = np.stack([h, *cut], 1).ravel(), at * (1 + len(limits))
    return h, at


def shingles(words: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and the row of each; fewer words are one run, none give nothing."""
    counts = np.diff(off)
    row_of = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    total = np.zeros(n, np.uint64)
    left = np.zeros(n, np.int64)
    if n:
        left = off[row_of + 1] - np.arange(n)
    for j in range(size):
        at = np.flatnonzero(left > j)
        total[at] = mix(total[at] + words[at + j] + _U(j + 1))
    whole = (left >= size) | ((left == counts[row_of]) if n else False)
    return total[whole], row_of[whole]


def sorted_sets(h: np.ndarray, row_of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted, and the rows' offsets."""
    order = np.lexsort((h, row_of))
    h, row_of = h[order], row_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row_of[1:] != row_of[:-1])
    h, row_of = h[new], row_of[new]
    return h, np.searchsorted(row_of, np.arange(rows + 1))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, offsets) for slices of a text column."""
    for row, body, off in chunks(column):
        words, at = word_hashes(body, off)
        h, row_of = shingles(words, at, size)
        yield row, *sorted_sets(h, row_of, len(off) - 1)
