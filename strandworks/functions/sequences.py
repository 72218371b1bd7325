"""Sequence and quality functions as Catalyst expressions. Positions are 1-based and closed."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters, their complements, and the lowest character and score of each quality encoding.
IUPAC = "ACGTMRWSYKVHDBN-"
COMPLEMENT = "TGCAKYWSRMBDHVN-"
ENCODINGS = {"phred": ("!", 0, 93), "solexa": (";", -5, 62), "illumina": ("@", 0, 62)}


def error_table(kind: str = "phred") -> tuple[int, list[float]]:
    """(code of the first quality character, error probability of each character from there on)."""
    first, lowest, highest = ENCODINGS[kind]
    scores = range(lowest, highest + 1)
    if kind == "solexa":
        return ord(first), [1 / (1 + 10 ** (q / 10)) for q in scores]
    return ord(first), [10 ** (-q / 10) for q in scores]


def error_of(char: Column, kind: str = "phred") -> Column:
    """Error probability of a quality character; above the table its last entry, below it an error."""
    first, table = error_table(kind)
    at = F.ascii(char) - first
    literal = F.array(*[F.lit(float(e)) for e in table])
    return F.when(at < 0, F.raise_error(F.lit("quality character below the encoding")).cast("double")).otherwise(
        F.element_at(literal, F.least(at, F.lit(len(table) - 1)) + 1)
    )


def front_window(seq: Column, tolerance: int) -> Column:
    return F.substring(seq, 1, tolerance)


def back_window(seq: Column, tolerance: int) -> Column:
    """The last bases, reverse-complemented."""
    return reverse_complement(F.right(seq, F.lit(tolerance)))


def back_quality(qual: Column, tolerance: int) -> Column:
    return F.reverse(F.right(qual, F.lit(tolerance)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def ambiguous_runs(adaptor: str) -> list[tuple[int, int]]:
    """Maximal runs of anything but A, C, G and T."""
    return [(m.start() + 1, m.end()) for m in re.finditer("[^ACGT]+", adaptor.upper())]


def bases(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column, letter: Callable[[Column], Column]) -> Column:
    """Maximal runs of items of equal ``letter``: an array of ``start, width, base``."""
    at = F.transform(items, lambda x, i: F.struct((i + 1).alias("start"), letter(x).alias("base")))
    first = lambda a: F.filter(a, lambda x: (x["start"] == 1) | (F.get(a, x["start"] - 2)["base"] != x["base"]))
    width = lambda f, x, k: F.coalesce(F.get(f, k + 1)["start"], F.size(items) + 1) - x["start"]
    spread = lambda f: F.transform(f, lambda x, k: F.struct(x["start"].alias("start"), width(f, x, k).alias("width"), x["base"].alias("base")))
    return let(let(at, first), spread)


def quality_mask(seq: Column, qual: Column, max_error: float | None, kind: str = "phred") -> Column:
    """Bases whose error exceeds ``max_error`` become N; None leaves the sequence as it is."""
    if max_error is None:
        return seq
    first, table = error_table(kind)
    # errors do not grow with the score, so the comparison is one of characters
    bad = sum(e > max_error for e in table)
    masked = F.zip_with(bases(seq), bases(qual), lambda s, q: F.when(F.ascii(q) < first + bad, F.lit("N")).otherwise(s))
    unequal = F.char_length(seq) != F.char_length(qual)
    return F.when(unequal, F.raise_error(F.lit("sequence and quality strings should have the same length"))).otherwise(F.array_join(masked, ""))


def unmask(aligned: Column, original: Column) -> Column:
    """Puts the original bases back for N in a gapped sequence."""
    plain = F.regexp_replace(aligned, "-", "")
    restored = F.zip_with(bases(plain), bases(original), lambda a, b: F.when(a.isin("N", "n"), b).otherwise(a))
    # the runs of gaps before each base and at the end
    step = F.array_join(F.zip_with(F.split(aligned, "[^-]"), restored, lambda gaps, b: F.concat(gaps, F.coalesce(b, F.lit("")))), "")
    bad = F.char_length(plain) != F.char_length(original)
    differs = F.exists(
        F.zip_with(bases(plain), bases(original), lambda a, b: ~a.isin("N", "n") & (F.upper(a) != F.upper(b))), lambda x: x
    )
    return (
        F.when(bad, F.raise_error(F.lit("alignment and original sequence differ in length")))
        .when(differs, F.raise_error(F.lit("alignment does not match the original sequence")))
        .otherwise(step)
    )


def trim(seq: Column, start: Column, end: Column) -> Column:
    return F.substring(seq, start, F.greatest(end - start + 1, F.lit(0)))


def scrambled(text: Column, key: Column, seed: int) -> Column:
    """The letters in an order that depends on the key, the seed and the length alone, so retries and qualities agree."""
    drawn = F.transform(bases(text), lambda x, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(drawn), lambda s: s["x"]), "")


def _total(numbers: Column) -> Column:
    return F.aggregate(F.transform(numbers, lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)


def cigar_width(cigar: Column) -> Column:
    """Reference bases that an alignment spans."""
    return _total(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)))


def left_clip(cigar: Column) -> Column:
    part = lambda i: F.regexp_extract(cigar, r"^(?:(\d+)H)?(?:(\d+)S)?", i)
    return _number(part(1)) + _number(part(2))


def right_clip(cigar: Column) -> Column:
    part = lambda i: F.regexp_extract(cigar, r"(?:(\d+)S)?(?:(\d+)H)?$", i)
    return _number(part(1)) + _number(part(2))


def _number(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int"))


def is_unmapped(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(4)) != 0


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(16)) != 0


def is_reversed(forward_start: Column, forward_end: Column, reverse_start: Column, reverse_end: Column) -> Column:
    """True if the reverse scores, negatives read as 0, add up to more; a tie is forward."""
    zero = F.lit(0.0)
    return F.greatest(forward_start, zero) + F.greatest(forward_end, zero) < F.greatest(reverse_start, zero) + F.greatest(reverse_end, zero)


def phred_char(log_error: Column) -> Column:
    """The phred character of a natural log error, 93 at most."""
    score = F.round(log_error * F.lit(-10 / math.log(10)))
    return F.chr((F.least(score, F.lit(93.0)) + 33).cast("int"))


def phred_string(log_errors: Column) -> Column:
    return F.array_join(F.transform(log_errors, phred_char), "")
