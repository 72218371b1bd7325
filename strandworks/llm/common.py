"""Helpers shared by the training-data operators.

Column names that start with ``_sw_`` belong to the operators. An operator
that adds result columns replaces input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.scratch import cut, free  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Space and the control characters 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text, null read as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


#: Letters other than A-Z that the built-in lower-casing may change, and characters this Java does not know.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; a text without other capitals takes the built-in, which is many times faster."""
    plain = (F.octet_length(c) == F.char_length(c)) | ~c.rlike(OTHER_CAPITALS)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds; never null."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5157), *cols)]


def with_row_key(df: DataFrame, *cols: str) -> DataFrame:
    """Adds ``_sw_k1, _sw_k2``, which stand for the values of ``cols``.

    Nulls are told from values, and rows equal in ``cols`` share a key.
    """
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    k1, k2 = hash128(*parts)
    return df.withColumns({"_sw_k1": k1, "_sw_k2": k2})


def with_running_ends(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces arrays of longs by their inclusive running sums, null kept.

    Two levels of about sqrt(n) items keep it at n * sqrt(n) steps, so one very
    long array does not become quadratic. Each step is a projection of its
    own, so that no expression is evaluated more than once a row.
    """
    one, zero = F.lit(1), F.lit(0).cast("long")

    def total(x: Column) -> Column:
        return F.aggregate(x, zero, lambda a, v: a + v)

    def blocks(c: str) -> Column:
        n = F.size(c)
        w = F.ceil(F.sqrt(F.greatest(n, one))).cast("int")
        return F.when(n > 0, F.transform(F.sequence(one, n, w), lambda b: F.slice(c, b, w)))

    def starts(c: str) -> Column:
        return F.transform(F.sequence(one, F.size(c)), lambda i: total(F.slice(c, one, i - 1)))

    def ends(b: str, s: str) -> Column:
        inner = lambda x, at: F.transform(F.sequence(one, F.size(x)), lambda i: at + total(F.slice(x, one, i)))
        return F.flatten(F.zip_with(b, s, inner))

    df = df.withColumns({f"{c}_b": blocks(c) for c in columns})
    df = df.withColumns({f"{c}_t": F.transform(f"{c}_b", total) for c in columns})
    df = df.withColumns({f"{c}_s": F.when(F.col(f"{c}_t").isNotNull(), starts(f"{c}_t")) for c in columns})
    df = df.withColumns({c: ends(f"{c}_b", f"{c}_s") for c in columns})
    return df.drop(*[f"{c}_{x}" for c in columns for x in "bts"])


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small local relation made from a JSON literal; no Python runs on executors."""
    import json

    names = [f.split()[0] for f in schema.split(",")]
    body = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(body), f"array<struct<{schema_ddl(schema)}>>")))


def schema_ddl(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split() for f in schema.split(",")))


#: Keys of a semi or anti join that are broadcast at most: about 64 MB.
BROADCAST_KEYS = 2_000_000


def semi_join(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` with (or, by ``left_anti``, without) a key.

    ``keys`` should be cut, as it is counted. Up to BROADCAST_KEYS of them are
    broadcast, so that ``df`` and its texts stay where they are; more are
    joined by a shuffle.
    """
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)
