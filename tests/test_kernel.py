"""The alignment kernel against a plain cell-by-cell version."""

import math
import random

import pytest

from strandworks.operators import kernel as K

INF = float("inf")


def plain_score(ref, seq, qual, s):
    """Three-state affine alignment, cell by cell."""
    first, match, mismatch = K.score_tables(s.kind)
    n, m, step, ext = len(seq), len(ref), s.opening + s.extension, s.extension
    h = [[-INF] * (m + 1) for _ in range(n + 1)]
    e = [[-INF] * (m + 1) for _ in range(n + 1)]
    f = [[-INF] * (m + 1) for _ in range(n + 1)]
    h[0][0] = 0
    for i in range(1, n + 1):
        h[i][0] = 0 if s.local else -(step + ext * (i - 1))
    for j in range(1, m + 1):
        h[0][j] = -(step + ext * (j - 1))
        last = s.local and j == m
        for i in range(1, n + 1):
            e[i][j] = max(h[i][j - 1] - step, e[i][j - 1] - ext)
            f[i][j] = max(h[i - 1][j] - (0 if last else step), f[i - 1][j] - (0 if last else ext))
            k, q = K.CLASS[ref[j - 1]], ord(qual[i - 1]) - first
            if k == 1:
                gain = (match if ref[j - 1] == seq[i - 1] else mismatch)[0][q]
            else:
                gain = 0 if k == 4 else (mismatch if k == 2 else match)[k - 1][q]
            h[i][j] = max(h[i - 1][j - 1] + gain, e[i][j], f[i][j])
    return h[n][m]


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("gaps", [(5, 1), (0, 1), (2, 3)])
def test_scores(local, gaps):
    r = random.Random(str((local, gaps)))
    s = K.Settings(*gaps, local=local)
    ref = "ACGTNNRYACGTVACC"
    seqs = ["".join(r.choices("ACGTN", k=r.randint(0, 40))) for _ in range(60)]
    seqs += [x[:5] + "ACGTGGACACGTAACC" + x[5:] for x in seqs[:20]]
    quals = ["".join(chr(33 + r.randint(1, 40)) for _ in x) for x in seqs]
    for got, (score, spans), seq, qual in zip(K.scores(ref, seqs, quals, s), K.traced(ref, seqs, quals, s), seqs, quals, strict=True):
        assert math.isclose(got, plain_score(ref, seq, qual, s), abs_tol=1e-9)
        assert got == score
        a, b = spans.gapped(ref, seq)
        assert a.replace("-", "") == ref and b.replace("-", "") == seq and len(a) == len(b)
        assert math.isclose(path_score(a, b, qual, s), score, abs_tol=1e-9)


def path_score(a, b, qual, s):
    """What the gapped strings cost."""
    first, match, mismatch = K.score_tables(s.kind)
    out, i, gap = 0.0, 0, ""
    lead = len(a) - len(a.lstrip("-")) if s.local else 0
    tail = len(a.rstrip("-")) if s.local else len(a)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        kind = "u" if x == "-" else "l" if y == "-" else ""
        if kind == "u" and (k < lead or k >= tail):
            pass
        elif kind:
            out -= s.extension + (s.opening if kind != gap else 0)
        else:
            c, q = K.CLASS[x], ord(qual[i]) - first
            out += (match if x == y else mismatch)[0][q] if c == 1 else 0 if c == 4 else (mismatch if c == 2 else match)[c - 1][q]
        gap = kind
        i += y != "-"
    return out


def test_edges():
    s = K.Settings()
    assert K.scores("", ["ACGT", ""], ["IIII", ""], s) == [0, 0]
    assert K.scores("AAAAGGGGCCCCTTTT", [""], [""], s) == [-21]
    assert K.traced("AAAAGGGGCCCCTTTT", [""], [""], s)[0][1].whole() == (0, 0)
    assert K.traced("", ["AC"], ["II"], s)[0][1].whole() == (0, 0)
    read = "CCAAAAGGGGCCCCTTTTGA"
    spans = K.traced("AAAAGGGGCCCCTTTT", [read], ["I" * 20], s)[0][1]
    assert spans.whole() == (3, 18)
    assert spans.section(1, 16, 20) == (1, 20)
    assert spans.section(5, 8, 20) == (7, 4)
    with pytest.raises(ValueError):
        K.scores("acgt", ["A"], ["I"], s)
    with pytest.raises(ValueError):
        K.scores("ACGT", ["AC"], ["I"], s)


def test_strict_letters():
    compat, strict = K.Settings(local=False), K.Settings(local=False, iupac="strict")
    assert K.scores("R", ["A"], ["5"], compat) == K.scores("R", ["C"], ["5"], compat)
    assert K.scores("R", ["A"], ["5"], strict) > K.scores("R", ["C"], ["5"], strict)
