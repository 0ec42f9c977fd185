"""Best-fit-decreasing packing of documents into sequences of several permitted lengths.

Items are documents by their estimated tokens; a document longer than the largest
capacity is cut into pieces of that length and a rest. Items of one length are
alike, so the plan is made on the histogram of lengths, whose size is bounded by
the largest capacity whatever the size of the corpus: lengths in falling order go
to the open bins with the least room that fits (a bin takes as many of a length
as it holds), and where none fits, bins are opened of the permitted size with the
least cost per expected token. In the end each bin is downsized to the smallest
permitted size that holds its contents.

The cost of a sequence of c tokens is c + c * c / QUADRATIC + OVERHEAD. Its expected
tokens are those placed now and a share of its room that the shorter items left
over can still fill.

The plan is a list of rules: items of length l with ranks lo to hi go, per_bin at
a time, to the bins from first on. Ranks within a length are dealt by counting,
in buckets of a hash, so a length that a third of all documents share is no
single task's work.

Lengths are in any unit that a text can be cut by: `start` and `length` of a piece count
the same unit, so sequences() builds the sequences from the plan. The registered query
packs UTF-8 bytes, the pipeline the tokens of the byte-pair codec; without a length the
estimate tokens_of() stands in.

Null and empty texts have length 0 and no bin (null). Rows that repeat are items
of their own. Very long texts give many pieces. Ties: among open bins of equal room the
one opened first is filled, among capacities of equal cost the smaller is opened, and
items of one length are taken by doc_id and piece within their bucket. An empty table
gives an empty result, and columns besides the id and the length's are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CAPACITIES = (512, 1024, 2048, 4096)
QUADRATIC, OVERHEAD = 8192.0, 16.0
BYTES_PER_TOKEN = 4
#: Items of one length are ranked in buckets of about this many.
_BUCKET_ROWS = 10_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / QUADRATIC + OVERHEAD


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple], list[tuple]]:
    """Rules (length, lo, hi, first, per_bin) and bins (first, end, capacity, used) for counts of lengths.

    Lengths must lie between 1 and the largest capacity.
    """
    sizes = sorted(capacities)
    rooms: list[int] = []  # the distinct rooms of open bins, rising
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # by room: (first, end, used)
    rules, made = [], 0
    shorter = sum(l * n for l, n in histogram.items())

    def put_back(room: int, first: int, end: int, used: int) -> None:
        if first >= end:
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((first, end, used))

    def fill(length: int, done: int, left: int, room: int, first: int, end: int, used: int) -> int:
        """Fill bins first to end, each with room, by up to left items; how many were placed."""
        per_bin = room // length
        full = min(end - first, left // per_bin)
        placed = full * per_bin
        if full:
            rules.append((length, done, done + placed, first, per_bin))
            put_back(room - per_bin * length, first, first + full, used + per_bin * length)
        rest = min(left - placed, per_bin) if full < end - first else 0
        if rest:
            rules.append((length, done + placed, done + placed + rest, first + full, rest))
            put_back(room - rest * length, first + full, first + full + 1, used + rest * length)
        put_back(room, first + full + bool(rest), end, used)
        return placed + rest

    for length in sorted((l for l, n in histogram.items() if n), reverse=True):
        left, done = histogram[length], 0
        shorter -= length * left
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, end, used = open_bins[room].pop(0)
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                def per_token(c: int) -> float:
                    own = c // length * length
                    bins = -(-left // (c // length))
                    return cost(c) / (own + min(c - own, shorter / bins))

                room = min((c for c in sizes if c >= length), key=lambda c: (per_token(c), c))
                first, used = made, 0
                end = made = made + -(-left // (room // length))
            n = fill(length, done, left, room, first, end, used)
            done, left = done + n, left - n
    bins = sorted(
        (first, end, next(c for c in sizes if c >= used), used) for group in open_bins.values() for first, end, used in group if used
    )
    return rules, bins


def _by_final_bin(rules: list[tuple], bins: list[tuple]) -> list[tuple]:
    """Rules cut so that all bins of a rule have one capacity and content."""
    starts = [b[0] for b in bins]
    out = []
    for length, lo, hi, first, per_bin in rules:
        end = first + -(-(hi - lo) // per_bin)
        k = bisect_left(starts, first + 1) - 1
        while k < len(bins) and bins[k][0] < end:
            a, b = max(first, bins[k][0]), min(end, bins[k][1])
            out.append((length, lo + (a - first) * per_bin, min(hi, lo + (b - first) * per_bin), a, per_bin, bins[k][2], bins[k][3]))
            k += 1
    return out


def tokens_of(text_col: str) -> Column:
    """Estimated tokens of a text: its UTF-8 bytes by BYTES_PER_TOKEN, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text_col) / BYTES_PER_TOKEN), F.lit(0)).cast("long")


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, capacity, bin_used): a row for each piece of each row of df."""
    spark, most = df.sparkSession, max(capacities)
    # Read several times below; a length that is a plain column of the input costs a narrow scan each time.
    rows = df.select(F.col(id_col).alias("doc_id"), (tokens_of("text") if length is None else F.coalesce(length.cast("long"), F.lit(0))).alias("n"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    items = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select(
        "doc_id", "piece", (F.col("piece") * F.lit(most).cast("long")).alias("start"),
        F.least(F.lit(most), F.col("n") - F.col("piece") * F.lit(most).cast("long")).cast("int").alias("length"),
    )
    counts = items.groupBy("length").count().collect()  # at most the largest capacity + 1 rows
    histogram = {r["length"]: r["count"] for r in counts if r["length"] > 0}
    rules = _by_final_bin(*plan(histogram, capacities))
    buckets = max(1, -(-sum(histogram.values()) // _BUCKET_ROWS))

    item = W.partitionBy("length", "bucket")
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = sizes.select("length", "bucket", (F.sum("size").over(
        W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(item.orderBy("doc_id", "piece")) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))

    rule = "struct<lo:bigint,hi:bigint,first:bigint,per_bin:bigint,capacity:int,used:int>"
    by_length: dict[int, list] = {}
    for l, *rest in rules:
        by_length.setdefault(l, []).append(tuple(rest))
    table = spark.createDataFrame(sorted(by_length.items()), f"length int, rules array<{rule}>")
    # One row for each length that occurs, so at most the largest capacity.
    placed = ranked.join(F.broadcast(table), "length", "left")
    found = F.filter("rules", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))
    placed = placed.withColumn("r", F.get(found, F.lit(0)))
    return placed.select(
        "doc_id", "piece", "start", "length",
        (F.col("r.first") + F.floor((F.col("rank") - F.col("r.lo")) / F.col("r.per_bin"))).cast("long").alias("bin_id"),
        F.col("r.capacity").alias("capacity"), F.col("r.used").alias("bin_used"),
    )


def sequences(packed: DataFrame, units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(bin_id, capacity, units): each bin's pieces joined in order of doc_id and piece.

    units has id_col, unique, and units, an array or a binary that start and length count.
    A bin holds at most its capacity, so no group is large.
    """
    binary = units.schema["units"].dataType.simpleString() == "binary"
    cut = F.substring("units", F.col("start") + 1, F.col("length")) if binary else F.slice("units", F.col("start") + 1, F.col("length"))
    parts = packed.where("bin_id is not null").join(units.select(F.col(id_col).alias("doc_id"), "units"), "doc_id").select(
        "bin_id", "capacity", F.struct("doc_id", "piece", cut.alias("units")).alias("p"))
    bins = parts.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list("p")).alias("p"))
    if binary:
        joined = F.aggregate("p.units", F.lit(b""), lambda a, x: F.concat(a, x))
    else:
        joined = F.flatten("p.units")
    return bins.select("bin_id", "capacity", joined.alias("units"))
