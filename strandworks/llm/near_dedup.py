"""Near-duplicate classes: minwise signatures and a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.operators.components import components

from .common import cut, free, semi_join
from .hashing import mix, shingle_sets

#: Symbols of a signature, bytes of a symbol, and the largest distance (differing symbols) whose pairs are all found.
#: At similarity 0.8 the distance is binomial with mean 12.8 and deviation 3.2.
SYMBOLS, SYMBOL_BYTES, RADIUS = 64, 2, 27
#: Each chunk may hold this many errors; by the pigeonhole principle some chunk of a pair within RADIUS does not hold more.
CHUNK_ERRORS = 1
CHUNKS = RADIUS // (CHUNK_ERRORS + 1) + 1
#: Longs of a sketch: four bits of every symbol.
SKETCH = SYMBOLS // 16
#: Shingles that one side of a cell holds at a time, 8 bytes each; larger cells are split into a grid.
CELL_SHINGLES = 4_000_000
#: Right-hand sets that are verified at once.
STEP = 256
#: Kinds of cells: a hub and its bucket, a component and what meets it, a bucket against itself.
HUB, COMPONENT, SAME = 1, 2, 3

_rng = np.random.default_rng(20)
_xor = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_odd = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "_sw_id long, _sw_n long, _sw_node long, _sw_f2 long, _sw_sig binary, _sw_sketch array<long>"


def signatures(size: int, with_sets: bool = False):
    """For mapInArrow over (id, text): id, set size, a 128-bit set fingerprint, the signature, and its sketch or the set.

    The first half of the fingerprint, ``_sw_node``, names the class of equal sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, h, off in shingle_sets(batch.column(1), size):
                rows, some = len(off) - 1, np.diff(off) > 0
                sig = np.zeros((rows, SYMBOLS), np.uint64)
                f1, f2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                if starts := off[:-1][some].tolist():
                    for j in range(SYMBOLS):
                        sig[some, j] = np.minimum.reduceat((h ^ _xor[j]) * _odd[j], starts)
                    f1[some] = np.add.reduceat(mix(h), starts)
                    f2[some] = np.add.reduceat(mix(h ^ _xor[0]), starts)
                symbols = np.ascontiguousarray(mix(sig).astype(np.uint16))
                packed = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(SYMBOLS * SYMBOL_BYTES), rows, [None, pa.py_buffer(symbols.tobytes())]
                )
                if with_sets:
                    last = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))
                else:
                    nibbles = (symbols & 15).astype(np.uint64).reshape(rows, SKETCH, 16) << np.arange(0, 64, 4, dtype=np.uint64)
                    longs = np.bitwise_or.reduce(nibbles, axis=2).view(np.int64)
                    last = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * SKETCH, pa.int32()), pa.array(longs.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, rows), pa.array(np.diff(off), pa.int64()), *[pa.array(f.view(np.int64)) for f in (f1, f2)], packed.cast(pa.binary()), last],
                    ["_sw_id", "_sw_n", "_sw_node", "_sw_f2", "_sw_sig", "_sw_set" if with_sets else "_sw_sketch"],
                )

    return run


def chunk_keys(sig: Column) -> Column:
    """One key per symbol: its chunk with that symbol left out.

    Two signatures share a key exactly if a chunk of theirs differs in no
    symbol or in the one left out, so enumerating the left-out symbol is
    enumerating the allowed error.
    """
    keys, at = [], 0
    for chunk in range(CHUNKS):
        width = SYMBOLS // CHUNKS + (chunk < SYMBOLS % CHUNKS)
        for out in range(at, at + width):
            before, after = out - at, at + width - 1 - out
            keys.append(
                F.xxhash64(
                    F.lit(out),
                    F.substring(sig, at * SYMBOL_BYTES + 1, before * SYMBOL_BYTES),
                    F.substring(sig, (out + 1) * SYMBOL_BYTES + 1, after * SYMBOL_BYTES),
                )
            )
        at += width
    return F.array(*keys)


def sketch_distance(a: Column, b: Column) -> Column:
    """Symbols that differ in their four sketched bits: never more than the signatures' distance."""
    total = F.lit(0)
    for i in range(SKETCH):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def size_fits(n: Column, least: Column, most: Column, percent: int) -> Column:
    """Whether a set of ``n`` can be similar to one of a size from ``least`` to ``most``."""
    return (n * 100 >= least * percent) & (most * 100 >= n * percent)


class Linker:
    """Compares the right-hand rows of a cell with its left-hand rows; keeps one link where several would join the same."""

    def __init__(self, percent: int) -> None:
        self.percent, self.left, self.root = percent, [], {}

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(up, up)
        return x

    def links(self, right: dict[str, np.ndarray], same: bool) -> list[tuple[int, int]]:
        """``same``: both sides of the cell hold the same nodes, so each pair is met twice and taken once."""
        out: list[tuple[int, int]] = []
        for node, comp, n, sig, own in self.left:
            fit = (right["comp"] != comp) & (np.minimum(right["n"], n) * 100 >= np.maximum(right["n"], n) * self.percent)
            if same:
                fit &= right["node"] > node
            at = np.flatnonzero(fit)
            far = (right["sig"][at] != sig).sum(1)
            near = far <= RADIUS
            at = at[near][np.argsort(far[near], kind="stable")]
            for first in range(0, len(at), STEP):
                some = [i for i in at[first : first + STEP].tolist() if self.find(int(right["comp"][i])) != self.find(comp)]
                if not some:
                    continue
                off, values = right["off"], right["values"]
                body = np.concatenate([values[off[i] : off[i + 1]] for i in some])
                place = np.minimum(np.searchsorted(own, body), len(own) - 1)
                cuts = np.cumsum([0] + [off[i + 1] - off[i] for i in some[:-1]])
                both = np.add.reduceat((own[place] == body).astype(np.int64), cuts)
                for i, k in zip(some, both.tolist(), strict=True):
                    if k * 100 >= (n + int(right["n"][i]) - k) * self.percent:
                        a, b = self.find(comp), self.find(int(right["comp"][i]))
                        if a != b:
                            self.root[max(a, b)] = min(a, b)
                            out.append((node, int(right["node"][i])))
        return out


CELL = ["_sw_kind", "_sw_cell", "_sw_i", "_sw_j"]


def compare(percent: int):
    """For mapInArrow over rows sorted by cell and side: links ``(a, b)`` between the sides of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, linker = None, Linker(percent)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)
            node, comp, n = (batch.column(i).to_numpy() for i in (5, 6, 7))
            sig = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            sets = batch.column(9)
            off, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            found: list[tuple[int, int]] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if (own := tuple(key[lo, :4].tolist())) != cell:
                    cell, linker = own, Linker(percent)
                if key[lo, 4] == 0:
                    # copies, as the batch goes
                    linker.left += [
                        (int(node[i]), int(comp[i]), int(n[i]), sig[i].copy(), values[off[i] : off[i + 1]].copy()) for i in range(lo, hi)
                    ]
                else:
                    found += linker.links({"node": node[lo:hi], "comp": comp[lo:hi], "n": n[lo:hi], "sig": sig[lo:hi], "off": off[lo : hi + 1], "values": values}, cell[0] == SAME)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def links(cells: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links between the left (``_sw_side`` 0) and right rows of cells.

    ``cells``: ``_sw_kind, _sw_cell, _sw_side, _sw_node, _sw_comp, _sw_n``. A
    pair is linked if its signatures are within RADIUS, its full sets have the
    similarity, and its components are not joined already. A cell whose side
    has more than CELL_SHINGLES shingles is dealt out as a grid of blocks.
    """
    cell = ["_sw_kind", "_sw_cell"]
    total = lambda side: F.sum(F.when(F.col("_sw_side") == side, F.col("_sw_n")).otherwise(0))
    blocks = lambda c: F.ceil(F.greatest(c, F.lit(1)) / CELL_SHINGLES).cast("int")
    grid = cells.groupBy(*cell).agg(blocks(total(0)).alias("_sw_p0"), blocks(total(1)).alias("_sw_p1"))
    grid = grid.where("_sw_p0 > 1 or _sw_p1 > 1")
    one = F.lit(1)
    p0, p1 = F.coalesce("_sw_p0", one), F.coalesce("_sw_p1", one)
    own = F.pmod(F.xxhash64("_sw_node"), F.when(F.col("_sw_side") == 0, p0).otherwise(p1)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("_sw_side") == 0, p1).otherwise(p0) - 1))
    dealt = cells.join(grid, cell, "left").withColumn("_sw_own", own).withColumn("_sw_other", other)
    left = F.col("_sw_side") == 0
    dealt = dealt.withColumn("_sw_i", F.when(left, F.col("_sw_own")).otherwise(F.col("_sw_other")))
    dealt = dealt.withColumn("_sw_j", F.when(left, F.col("_sw_other")).otherwise(F.col("_sw_own")))
    involved = cut(classes.join(cells.select("_sw_node").distinct(), "_sw_node", "left_semi").select("_sw_id").distinct())
    held = semi_join(texts, involved, ["_sw_id"]).mapInArrow(
        signatures(size, with_sets=True), "_sw_id long, _sw_n long, _sw_node long, _sw_f2 long, _sw_sig binary, _sw_set array<long>"
    )
    held = held.where("_sw_n > 0").groupBy("_sw_node").agg(F.first(F.struct("_sw_sig", "_sw_set")).alias("_sw_h"))
    rows = dealt.join(held, "_sw_node").select(*CELL, "_sw_side", "_sw_node", "_sw_comp", "_sw_n", "_sw_h._sw_sig", "_sw_h._sw_set")
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL, "_sw_side")
    out = cut(rows.mapInArrow(compare(percent), "a long, b long"))
    free(involved)
    return out


def near_links(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all links between class nodes.

    A bucket is the set of nodes that share a chunk key; pairs within RADIUS
    share one. A node's weight is the number of others it meets, and the
    heaviest node of a bucket is its hub.

    1. Every node is compared with the hubs of its buckets. The heaviest of a
       group of copies is the one that most others are close to, so a group
       has few hubs, and a group of m costs about m comparisons.
    2. Pairs of different components that share a bucket are still open. The
       largest component of a bucket is compared as a whole: each node that
       meets it there makes one row, and both are dealt out as a grid of
       blocks, so no pair of theirs is a row.
    3. Nodes outside their bucket's largest component are compared with one
       another, if a sketch of the signature lets them be within RADIUS of any.

    Every open pair is in 2 or 3, so the three steps settle all.
    """
    keyed = classes.select("_sw_node", "_sw_n", F.explode(chunk_keys(F.col("_sw_sig"))).alias("_sw_key"))
    shared = keyed.groupBy("_sw_key").agg(F.count("*").alias("_sw_c")).where("_sw_c > 1")
    weight = F.sum("_sw_c").over(Window.partitionBy("_sw_node"))  # a node has SYMBOLS keys at most
    live = cut(keyed.join(shared, "_sw_key").select("_sw_key", "_sw_node", "_sw_n", weight.alias("_sw_w")))

    def cells(df: DataFrame, kind: int, cell: str, side: int) -> DataFrame:
        return df.select(F.lit(kind).alias("_sw_kind"), F.col(cell).alias("_sw_cell"), F.lit(side).alias("_sw_side"), "_sw_node", "_sw_comp", "_sw_n")

    hubs = live.groupBy("_sw_key").agg(F.max(F.struct("_sw_w", F.col("_sw_node").alias("hub"), F.col("_sw_n").alias("m"))).alias("_sw_hub"))
    star = live.join(hubs, "_sw_key").select("_sw_node", "_sw_n", "_sw_hub.hub", "_sw_hub.m").where("_sw_node <> hub")
    star = cut(star.where(size_fits(F.col("_sw_n"), F.col("m"), F.col("m"), percent)).distinct().withColumn("_sw_comp", F.col("_sw_node")))
    middle = star.select(F.col("hub").alias("_sw_node"), F.col("hub").alias("_sw_comp"), F.col("m").alias("_sw_n")).distinct()
    first = links(cells(middle, HUB, "_sw_node", 0).unionByName(cells(star, HUB, "hub", 1)), classes, texts, size, percent)
    labels = components(first).toDF("_sw_node", "_sw_comp")

    inside = cut(classes.select("_sw_node", "_sw_n").join(labels, "_sw_node", "left").withColumn("_sw_comp", F.coalesce("_sw_comp", "_sw_node")))
    extent = inside.groupBy("_sw_comp").agg(F.count("*").alias("size"), F.min("_sw_n").alias("least"), F.max("_sw_n").alias("most"))
    extent = extent.where("size > 1")
    placed = labels.join(extent, "_sw_comp")
    rows = live.join(placed, "_sw_node", "left").withColumn("_sw_comp", F.coalesce("_sw_comp", "_sw_node"))
    place = F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.col("_sw_comp").alias("main"), F.coalesce("least", "_sw_n").alias("least"), F.coalesce("most", "_sw_n").alias("most"))
    rows = rows.select("_sw_key", "_sw_node", "_sw_n", "_sw_comp", place.alias("place"))
    mixed = rows.groupBy("_sw_key").agg(F.max("place").alias("top"), F.min("_sw_comp").alias("c0"), F.max("_sw_comp").alias("c1")).where("c0 <> c1")
    rest = rows.join(mixed.select("_sw_key", "top"), "_sw_key").where("_sw_comp <> top.main").select("_sw_key", "_sw_node", "_sw_n", "_sw_comp", "top")
    rest = cut(rest)

    meets = rest.where(size_fits(F.col("_sw_n"), F.col("top.least"), F.col("top.most"), percent))
    meets = meets.select(F.col("top.main").alias("main"), "_sw_node", "_sw_n", "_sw_comp").distinct()
    members = inside.join(meets.select(F.col("main").alias("_sw_comp")).distinct(), "_sw_comp", "left_semi").withColumn("main", F.col("_sw_comp"))

    sketched = rest.select("_sw_key", "_sw_node", "_sw_n", "_sw_comp").join(classes.select("_sw_node", "_sw_sketch"), "_sw_node")
    other = sketched.select("_sw_key", F.col("_sw_n").alias("m"), F.col("_sw_comp").alias("c"), F.col("_sw_sketch").alias("s"))
    near = (
        (sketched["_sw_key"] == other["_sw_key"])
        & (F.col("_sw_comp") != F.col("c"))
        & size_fits(F.col("_sw_n"), F.col("m"), F.col("m"), percent)
        & (sketch_distance(F.col("_sw_sketch"), F.col("s")) <= RADIUS)
    )
    open_rows = cut(sketched.join(other, near, "left_semi").select("_sw_key", "_sw_node", "_sw_n", "_sw_comp"))

    second = cells(meets, COMPONENT, "main", 0).unionByName(cells(members, COMPONENT, "main", 1))
    second = second.unionByName(cells(open_rows, SAME, "_sw_key", 0)).unionByName(cells(open_rows, SAME, "_sw_key", 1))
    second = cut(second)
    out = first.unionByName(links(second, classes, texts, size, percent))
    free(live, star, inside, rest, open_rows, second)
    return out


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by word-shingle similarity of ``percent`` / 100 or more.

    Words are runs of non-blanks, A-Z lower-cased; a text with fewer words than
    ``shingle`` is one shingle; one without words has none and is linked with
    nothing. Documents with equal sets (by a 128-bit fingerprint) form a class
    at once. Classes whose signatures differ in at most RADIUS symbols meet in
    the multi-index join and are confirmed on their full sets.

    Returns ``doc_id, n_shingles, component_id, kept``: one row per input row,
    ``component_id`` the smallest doc_id reachable. Defined cases: a null
    doc_id takes no part (component null, kept); rows that repeat a doc_id
    are linked through each of their texts, and are kept alike; an empty
    table gives an empty result; other columns are left out.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("_sw_id"), F.col(text).cast("string").alias("_sw_text"))
    sigs = cut(texts.mapInArrow(signatures(shingle), SIGNED))
    some = sigs.where("_sw_n > 0 and _sw_id is not null")
    one = F.min(F.struct("_sw_id", "_sw_sig", "_sw_sketch")).alias("_sw_one")
    classes = cut(some.groupBy("_sw_node", "_sw_f2", "_sw_n").agg(one).select("_sw_node", "_sw_n", "_sw_one.*"))
    edges = near_links(classes, texts.where("_sw_id is not null"), shingle, percent)
    several = some.groupBy("_sw_id").agg(F.min("_sw_node").alias("b"), F.max("_sw_node").alias("_sw_hi")).where("b <> _sw_hi").select("_sw_id", "b")
    edges = edges.unionByName(some.select("_sw_id", F.col("_sw_node").alias("a")).join(several, "_sw_id").select("a", "b"))
    labels = components(edges).toDF("_sw_node", "_sw_comp")
    ids = classes.select("_sw_node", "_sw_id").join(labels, "_sw_node", "left")
    least = ids.where("_sw_comp is not null").groupBy("_sw_comp").agg(F.min("_sw_id").alias("_sw_least"))
    named = ids.join(least, "_sw_comp", "left").select("_sw_node", F.coalesce("_sw_least", "_sw_id").alias("component_id"))
    out = sigs.select("_sw_id", "_sw_n", "_sw_node").join(named, "_sw_node", "left")
    component = F.when(F.col("_sw_n") > 0, F.when(F.col("_sw_id").isNotNull(), F.col("component_id"))).otherwise(F.col("_sw_id"))
    out = out.select(F.col("_sw_id").alias("doc_id"), F.col("_sw_n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
