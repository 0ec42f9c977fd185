"""SimHash near-duplicates, found by a grid over segment popcounts.

Fingerprints: A-Z are lower-cased, words are split at ASCII white space, shingles
are runs of words joined by one space (fewer words than a shingle: all of them),
and a bit is set if it is set in over half the shingles' XXH64 values. A text
without words, or a null, has fingerprint zero and links like any other.

Links: a fingerprint's 64 bits are cut into 32 segments of two bits, and each
segment's number of set bits is one coordinate. The Manhattan distance of two
such points never exceeds the Hamming distance. The coordinates fall into BLOCKS
blocks; points within distance 3 agree in all but three blocks, so they share
the grid cell of at least one choice of BLOCKS - 3 blocks. Points of one cell
are joined, kept if the Manhattan distance is at most 3, then verified by the
exact Hamming distance. A pair is reported by the first choice it shares only.
Cells with many points are dealt out: a cell's points are split by hash into
parts of about PART, and each pair of parts is a join key of its own, so no cell
is one task's work.

Only distinct fingerprints are joined, so exact copies cost nothing there.
Components spread over the links by large-star and small-star rounds.
Repeated rows each get their row; a row with a null doc_id has a fingerprint and,
as component, the smallest doc_id of its group (null if there is none). An empty
table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, durable, keep_marked, map_batches, marks

SEED, BITS, SEGMENT = 42, 64, 2
RADIUS, BLOCKS = 3, 6
PART = 1000
_CHUNK = 1 << 16


def _ones_of(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fold_bits(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes (unsigned, repeats included) as a signed number; zero of none."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(h), _CHUNK):
        ones += _ones_of(h[start : start + _CHUNK])
    return _majority(ones, len(h))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones, n = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        ones += _ones_of(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(start, stop)), "<u8", stop - start))
    return _majority(ones, n)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of df."""
    types = {"doc_id": pa.int64(), "fp": pa.int64()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch_of({"doc_id": batch.column(0), "fp": [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]}, types)

    return map_batches(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], process, "doc_id long, fp long")


# --- the grid ----------------------------------------------------------------

#: Which coordinates (two-bit segments, from the lowest bits) make up each block.
_BLOCK_SEGMENTS = [list(map(int, part)) for part in np.array_split(np.arange(BITS // SEGMENT), BLOCKS)]
_CHOICES = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
#: By the set of blocks in which two points agree, as a bit mask: the first choice inside it, or -1.
_FIRST_CHOICE = [
    next((k for k, c in enumerate(_CHOICES) if all(mask >> b & 1 for b in c)), -1) for mask in range(1 << BLOCKS)
]


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


_LOW = int("01" * 32, 2)


def _ones(fp: Column) -> Column:
    """The popcounts of the 32 segments, packed as two-bit numbers (0, 1 or 2)."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(_long(_LOW))
    low = fp.bitwiseAND(_long(_LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _block_mask(block: int) -> int:
    return sum(3 << (2 * s) for s in _BLOCK_SEGMENTS[block])


def _manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed popcount points.

    Digits are 0 to 2, so |a - b| is 2 where one is 0 and the other 2, and 1 where
    just one of them is odd. 2 is binary 10: a difference of 2 is the high bit in
    the exclusive or with both low bits clear.
    """
    x = a.bitwiseXOR(b)
    odd = x.bitwiseAND(_long(_LOW))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(_long(_LOW))
    return F.bit_count(odd) + F.bit_count(high.bitwiseAND(F.bitwise_not(odd))) * 2


def _agreeing(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    mask = F.lit(0)
    for k in range(BLOCKS):
        mask = mask + F.when(x.bitwiseAND(_long(_block_mask(k))) == 0, 1 << k).otherwise(0)
    return mask


def links(points: DataFrame, part: int = PART) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fp values of points at most RADIUS bits apart."""
    base = points.select("fp", _ones(F.col("fp")).alias("pt"))
    cells = F.array(*[
        F.struct(F.lit(k).alias("choice"), F.col("pt").bitwiseAND(_long(sum(_block_mask(b) for b in c))).alias("cell"))
        for k, c in enumerate(_CHOICES)
    ])
    keyed = base.select("fp", "pt", F.explode(cells).alias("c")).select("fp", "pt", "c.choice", "c.cell")
    # Only cells that are over part large are counted out; their number falls with their size.
    crowded = keyed.groupBy("choice", "cell").count().where(F.col("count") > 1)
    counted = keyed.join(crowded, ["choice", "cell"])
    parts = F.ceil(F.col("count") / F.lit(part)).cast("int")
    dealt = counted.select("fp", "pt", "choice", "cell", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "fp", "pt", "choice", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"
    )
    left, right = dealt.alias("l"), dealt.alias("r")
    a, b = F.col("l.pt"), F.col("r.pt")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("choice", "cell", "i", "j")]
    near = (
        (F.col("l.fp") < F.col("r.fp"))
        & ((F.col("l.i") == F.col("l.j")) | (F.col("l.own") != F.col("r.own")))
        & (_manhattan(a, b) <= RADIUS)
        & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= RADIUS)
        & (F.element_at(F.array(*map(F.lit, _FIRST_CHOICE)), _agreeing(a, b) + 1) == F.col("l.choice"))
    )
    cond = same[0]
    for c in [*same[1:], near]:
        cond = cond & c
    return left.join(right, cond).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


# --- components --------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge (a, b).

    Large-star links each node's larger neighbours to its smallest, small-star its
    smaller ones; the rounds end when the edges are stars around smallest nodes, which
    is tested before each. Each round is written to the shared checkpoint folder.
    """
    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        # Both directions come of one pass: a union would double the tasks.
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        least = smallest(e.select(F.inline(ends))).select("u", F.least("u", "m").alias("m"))
        moved = e.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = smallest(down)
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()

    def are_stars(e: DataFrame) -> bool:
        # A node with a smaller neighbour has no other.
        ends = F.array(F.struct(F.col("a").alias("u"), F.lit(0).alias("larger")), F.struct(F.col("b").alias("u"), F.lit(1).alias("larger")))
        between = e.select(F.inline(ends)).groupBy("u").agg(F.sum("larger").alias("smaller"), F.count("*").alias("n")).where("smaller > 0 AND n > 1")
        return not between.agg(F.count("*")).first()[0]

    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not are_stars(edges):
        edges = durable(small_star(large_star(edges)))
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _by_root(points: DataFrame) -> DataFrame:
    """points (fp and further columns) with root, the smallest fingerprint of each one's component."""
    roots = components(links(points))
    return points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of df."""
    docs = durable(fingerprints(df, id_col, text_col, shingle))
    labelled = _by_root(durable(docs.groupBy("fp").agg(F.min("doc_id").alias("first"))))
    # The smallest doc_id over the fingerprints of a component; fingerprints without links stand alone.
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    # The side of the documents may hold one fingerprint many times; adaptive execution splits such partitions of a sort-merge join.
    return docs.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with one row of each group of linked fingerprints: the one whose doc_id is the smallest, a row without one last.

    Rows, not ids, are chosen, so a doc_id that stands for different texts loses no
    group: among rows of one doc_id the smallest fingerprint stays, then the smallest
    hash of the row. (The pipeline's stage is jaccard.keep_first.)
    """
    types = {"doc_id": pa.int64(), "mark": pa.int64(), "mark2": pa.int32(), "fp": pa.int64()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = [fingerprint(t, shingle) for t in batch.column(3).to_pylist()]
        yield batch_of({**{k: batch.column(i) for i, k in enumerate(("doc_id", "mark", "mark2"))}, "fp": fps}, types)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *marks(docs), "text"]
    rows = durable(map_batches(docs, columns, process, "doc_id long, mark long, mark2 int, fp long"))
    # One row for each fingerprint, the first by the same order.
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "mark", "mark2")
    best = _by_root(durable(rows.groupBy("fp").agg(F.min(order).alias("x"))))
    return keep_marked(docs, best.groupBy("root").agg(F.min("x").alias("x")).select("x.mark", "x.mark2"))
