"""Near-duplicates by SimHash, verified and completed by exact Jaccard similarity of word shingles.

A-Z are lower-cased, words are split at ASCII white space, and a document's set
holds the XXH64 values of its runs of WORDS words (fewer words: all of them as
one; no words or null: an empty set, and such documents are copies of each
other). Two documents are linked if their sets' Jaccard similarity is OVER / OF
or more. Documents of the same words collapse to one node first.

Two ways propose pairs, and the sets themselves decide.

* simhash.links: fingerprints of the same shingles at most 3 bits apart. Cheap, but
  most pairs near the limit differ in more bits.
* Prefixes, which lose no pair: with all values in one order, two linked sets share a
  value among the first n - ceil(n * OVER / OF) + 1 of each. The order puts values that
  a sample of documents finds frequent last. It decides how many candidates there
  are, never which links are found.

The first round proposes the fingerprints' pairs and, for every shared value, each
node with the value's smallest one, so that a large group costs a few pairs for each
member. The second does so again with SALTS other nodes of each value that the links so far leave in
several components, for members too far from the smallest one. The third proposes all other pairs of
a value's nodes that are still in different components. Crowded values are dealt out in pairs of
parts. A pair may share hundreds of values; it is made at the first of them, and hardly ever again,
because each row knows the LAST values before its own, and a pair that shares one of those was made there.

A pair is only sent on if its sets' points allow a link: the values are counted in
SEGMENTS segments by their lowest bits, modulo two, and the Manhattan distance of two
such points never exceeds the number of values in which the sets differ, which a link
bounds by (|A| + |B|) * (OF - OVER) / (OF + OVER). The join itself tests that, so pairs
that share a passage alone are hardly ever written. Components spread as in simhash.

Repeated rows and texts collapse; nulls in any column count like other values; very
long texts have larger sets, nothing is cut; an empty table gives an empty result; and
columns of any further names pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable, keep_marked, marks
from .simhash import SEED, components, fold_bits, links

WORDS, OVER, OF = 5, 4, 5
#: Documents in the sample of the order (at least; and one in SHARE), how often a value counts as frequent there, and how many such values are kept.
SAMPLE, SHARE, OFTEN, FREQUENT = 4000, 20, 3, 200_000
PART = 1000
#: Further nodes of a value that its others are held against, and values before its own that a row knows.
SALTS, LAST = 4, 4
#: Segments in which values are counted modulo two, 64 to a long; sets of more values than SEGMENTS get finer ones, too, up to FINE.
SEGMENTS, FINE = 512, 1 << 14
#: Bits of the filter of nodes whose sets are checked; a clash only lets a further set through.
_BITS = 1 << 24


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every run of words, repeats included."""
    n = max(1, len(words) - WORDS + 1) if words else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + WORDS]), SEED) for i in range(n)), "<u8", n)


def shingles(words: list[bytes]) -> np.ndarray:
    """The set's values, sorted."""
    return np.unique(hashes(words).view("<i8"))


def prefix(values: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted set by which it meets every linked one: others, and those in frequent, which is sorted."""
    size = len(values) - -(-len(values) * OVER // OF) + 1 if len(values) else 0
    if not len(frequent):
        return values[:size], values[:0]
    known = frequent[np.searchsorted(frequent, values).clip(max=len(frequent) - 1)] == values
    rare = values[~known][:size]
    return rare, values[known][: size - len(rare)]


def _each_once(df: DataFrame, columns: list, make: Callable[[int, list[bytes], bool, tuple], tuple | None], schema: pa.Schema) -> DataFrame:
    """Rows that make gives of (node, words, whether the node is new in this partition, the other columns); text is the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = []
                for text, *others in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns)):
                    words = words_of(text)
                    key = node(words)
                    made = make(key, words, key not in seen, tuple(others))
                    seen.add(key)
                    rows += [] if made is None else [made]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    bounded_batches(df.sparkSession)
    names = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.binary(): "binary"}
    return df.select(*columns).mapInArrow(run, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


_LONGS = pa.list_(pa.int64())


def frequent_values(docs: DataFrame) -> np.ndarray:
    """Values in OFTEN or more of about SAMPLE distinct texts or one text in SHARE, sorted; at most FREQUENT, the most frequent ones.

    The sample grows with docs, so that a value of a given number of documents does not pass for rare in a larger table.
    """
    step = min(SHARE, max(1, docs.count() // SAMPLE))
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).dropDuplicates(["text"])
    sets = _each_once(some, ["text"], lambda key, words, new, _: (key, shingles(words)) if new else None, pa.schema({"node": pa.int64(), "v": _LONGS}))
    often = sets.select(F.explode("v").alias("v")).groupBy("v").count().where(F.col("count") >= OFTEN)
    return np.sort(often.orderBy(F.desc("count"), "v").limit(FREQUENT).select("v").toArrow()["v"].to_numpy())


_POINT = [f"o{k}" for k in range(SEGMENTS // 64)]


def point(values: np.ndarray, segments: int = SEGMENTS) -> list[int]:
    """Whether each segment holds an odd number of the values."""
    counts = np.bincount(values & (segments - 1), minlength=segments)
    return np.packbits(counts & 1, bitorder="little").view("<i8").tolist()


def _fine(values: np.ndarray) -> list[int]:
    """The finer point of a large set: of twice as many segments as values or more, up to FINE; of a small set, none."""
    return point(values, min(FINE, 1 << (2 * len(values) - 1).bit_length())) if len(values) > SEGMENTS else []


def _apart(a: Column, b: Column) -> Column:
    """In how many segments two finer points differ; zero if one is missing. One of more segments is folded onto the other."""

    def folded(x: Column, y: Column, n: Column) -> Column:
        halves = F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(y), halves).otherwise(x)

    # The larger of two sets that may be linked has at most twice as many segments.
    n = F.least(F.size(a), F.size(b))
    bits = F.zip_with(folded(a, b, n), folded(b, a, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(n == 0, 0).otherwise(F.aggregate(bits, F.lit(0), lambda s, x: s + x))


def _possible(left: str, right: str) -> Column:
    """Whether the sizes and the points of two sides allow a link."""
    apart = " + ".join(f"bit_count({left}.{o} ^ {right}.{o})" for o in _POINT)
    sizes = f"least({left}.n, {right}.n) * {OF} >= greatest({left}.n, {right}.n) * {OVER}"
    return F.expr(f"{sizes} AND ({apart}) * {OF + OVER} <= ({left}.n + {right}.n) * {OF - OVER}")


def _filtered(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that points allow; points with a root leave out pairs of one root."""
    root = [c for c in ("root",) if c in points.columns]
    l, r = points.hint("merge").alias("l"), points.hint("merge").alias("r")
    one = pairs.join(l, F.col("a") == F.col("l.node")).select("a", "b", F.struct("l.n", *[f"l.{c}" for c in (*_POINT, *root)]).alias("p"))
    both = one.join(r, F.col("b") == F.col("r.node")).where(_possible("p", "r"))
    return (both.where("p.root != r.root") if root else both).select("a", "b")


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    at = F.explode(F.array(*[F.pmod(k, F.lit(_BITS)) for k in "ab"])).alias("at")
    # At most _BITS / 64 rows reach the driver.
    bits = pairs.select(at).groupBy(F.floor(F.col("at") / 64).alias("k")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("w")).toArrow()
    asked = np.zeros(_BITS // 64, "<i8")
    asked[bits["k"].to_numpy()] = bits["w"].to_numpy()

    def make(key: int, words: list[bytes], new: bool, _: tuple) -> tuple | None:
        at = key % _BITS
        if not new or not int(asked[at // 64]) >> (at % 64) & 1:
            return None
        values = shingles(words)
        return key, values, _fine(values)

    # One exchange by node serves all joins below.
    made = _each_once(docs, ["text"], make, pa.schema({"node": pa.int64(), "v": _LONGS, "fine": _LONGS}))
    sets = made.groupBy("node").agg(F.first(F.struct("v", "fine")).alias("x")).select("node", "x.v", "x.fine")
    # Long sets are held apart by finer points before they move themselves.
    a, b = (sets.select(F.col("node").alias(k), F.size("v").alias(f"n{k}"), F.col("fine").alias(f"f{k}")) for k in "ab")
    near = _apart(F.col("fa"), F.col("fb")) * (OVER + OF) <= (F.col("na") + F.col("nb")) * (OF - OVER)
    pairs = pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(near)
    a, b = (sets.select(F.col("node").alias(k), F.col("v").alias(f"v{k}")) for k in "ab")
    both = pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    common, total = F.size(F.array_intersect("va", "vb")), F.size("va") + F.size("vb")
    return both.where(common * (OVER + OF) >= total * OVER).select("a", "b")


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, node, root, count): the rows of shared (v, node) whose value is met in several components, with its number of nodes."""
    placed = shared.select("v", "node").join(roots.hint("merge"), "node", "left").select("v", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("count")).where("lo < hi")
    return placed.join(mixed.select("v", "count").hint("merge"), "v")


def _salted(mixed: DataFrame) -> DataFrame:
    """(a, b), a < b: each node of a value with SALTS others, the same ones for as many values as possible."""
    stars = mixed.groupBy("v").agg(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(SALTS)]).alias("stars"))
    pairs = mixed.join(stars.hint("merge"), "v").select("node", F.explode("stars").alias("star")).where("node != star")
    return pairs.select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()


def _made(mixed: DataFrame, points: DataFrame, part: int) -> DataFrame:
    """(a, b), a < b, a few of them repeated: possible pairs of a value's nodes with different roots, crowded values dealt out in parts.

    A pair's first shared value makes it. The rows of others know LAST values of their node before their own
    and make it again only if the pair shares none of those.
    """
    parts = F.ceil(F.col("count") / F.lit(part)).cast("int")
    before = Window.partitionBy("node").orderBy("v").rowsBetween(-LAST, -1)
    some = mixed.select("v", "node", "root", parts.alias("parts"), F.collect_list("v").over(before).alias("before")).join(points.hint("merge"), "node")
    dealt = some.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("v", "node", "n", "root", "before", *_POINT, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    left, right = dealt.alias("l"), dealt.alias("r")
    cond = F.lit(True)
    for k in ("v", "i", "j"):
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    cond = cond & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root"))
    cond = cond & ((F.col("l.i") == F.col("l.j")) | (F.col("l.own") != F.col("r.own"))) & _possible("l", "r")
    cond = cond & ~F.arrays_overlap("l.before", "r.before")
    return left.join(right, cond).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def _by_fingerprint(points: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes of one fingerprint with its smallest, and the smallest of near fingerprints."""
    least = durable(points.groupBy("fp").agg(F.min("node").alias("least")))
    same = points.join(least.hint("merge"), "fp").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    x, y = least.alias("x"), least.alias("y")
    near = links(least).alias("l").join(x, F.col("l.a") == F.col("x.fp")).join(y, F.col("l.b") == F.col("y.fp"))
    return same.union(near.select(F.least("x.least", "y.least").alias("a"), F.greatest("x.least", "y.least").alias("b")))


def _stars(roots: DataFrame) -> DataFrame:
    """(a, b): links that say what roots (node, root) say; with further ones they need fewer rounds than the links they come from."""
    return roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _shared(rows: DataFrame) -> DataFrame:
    """(v, node, least): values that several nodes have, with the smallest of them."""

    def of(keyed: DataFrame) -> DataFrame:
        multi = keyed.groupBy("v").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
        return keyed.join(multi.select("v", "least").hint("merge"), "v").distinct()

    # A rare value has few nodes, so it may move before it is counted: one exchange serves the counting and the join.
    # A frequent one is counted within the tasks first, and its join can be split.
    rare = rows.select("node", F.explode("rare").alias("v")).repartition("v")
    often = rows.select("node", F.explode("often").alias("v"))
    return of(rare).union(of(often))


def grouped(docs: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, mark, mark2, node, root): the component of every row of docs, by its smallest node."""
    frequent = frequent_values(docs)

    def make(key: int, words: list[bytes], new: bool, others: tuple) -> tuple:
        if not new:
            return (*others, key, *[None] * (4 + len(_POINT)))
        h = hashes(words)
        values = np.unique(h.view("<i8"))
        return (*others, key, len(values), fold_bits(h), *prefix(values, frequent), *point(values))

    schema = pa.schema({"doc_id": pa.int64(), "mark": pa.int64(), "mark2": pa.int32(), "node": pa.int64(), "n": pa.int32(), "fp": pa.int64(),
                        "rare": _LONGS, "often": _LONGS, **{o: pa.int64() for o in _POINT}})
    rows = durable(_each_once(docs, ["text", F.col("doc_id").cast("long").alias("doc_id"), *marks(docs)], make, schema))
    points = durable(rows.where("n > 0").select("node", "n", "fp", *_POINT).distinct())
    shared = durable(_shared(rows.where("n > 0")))
    stars = shared.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    tried = durable(_filtered(stars.union(_by_fingerprint(points)).distinct(), points))
    roots = components(_linked(docs, tried))
    mixed = durable(_mixed(shared, roots))
    placed = points.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = durable(_filtered(_salted(mixed), placed).join(tried, ["a", "b"], "left_anti"))
    roots = components(_stars(roots).union(_linked(docs, again)))
    mixed = durable(_mixed(mixed, roots))
    rest = _made(mixed, points.select("node", "n", *_POINT), part).distinct().join(tried.union(again), ["a", "b"], "left_anti")
    found = components(_stars(roots).union(_linked(docs, durable(rest))))
    named = rows.select("doc_id", "mark", "mark2", "node").join(found.hint("merge"), "node", "left")
    return named.select("doc_id", "mark", "mark2", "node", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: the one whose doc_id is the smallest, a row without one last.

    Among rows of the same doc_id the smallest node stays, then the smallest hash of the row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node", "mark", "mark2")
    return keep_marked(docs, grouped(docs).groupBy("root").agg(F.min(order).alias("x")).select("x.mark", "x.mark2"))
