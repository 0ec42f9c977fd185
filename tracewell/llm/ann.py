"""Approximate nearest neighbours by largest inner product, over pruned graphs.

Equal vectors are one point: copies are collapsed first, keeping the smallest
TOP + 1 ids of each (a query never needs more), so copies neither crowd the
graph nor one task. Points are dealt to shards by norm class, then by hash; each shard
builds a directed graph: points enter in growing rounds, a greedy search from the entry
point proposes neighbours, and robust pruning keeps, nearest first, only those that no
kept neighbour is ALPHA times closer to; back edges are pruned alike. A beam search from
the entry point then queries every shard with every query, and the nearest over all
shards are merged by score, ties by the smaller id.

Inner products become distances by one more coordinate that brings each vector to the
shard's largest norm. Norms of a shard differ little, as CLASSES quantiles of the norm
are kept apart: otherwise that coordinate would hide the directions of short vectors.

Each shard's beam is measured, not fixed: SAMPLE queries are answered exactly within
the shard, and the beam doubles until the graph finds TARGET of their neighbours (or the
beam holds the whole shard). Easy data keep a small beam; data without any structure
pay for theirs.

Scores are inner products of the original vectors in double precision.

Shards hold about SHARD_ROWS points at most, fewer where vectors are long (SHARD_BYTES).
A task searches a group of shards (about GROUP_ROWS points, GROUP_BYTES) with a block of
queries (BLOCK, or as many as GROUP_BYTES hold), so a query travels once for each group
and a group once for each block: with up to BLOCK queries, what is shuffled grows with
the rows alone. Vectors that are null, zero or hold null or non-finite components take
no part, nor do rows with a null id. Vectors of different lengths are never compared. An
id that occurs more than once counts for each of its vectors, but once a result. An
empty table gives an empty result; columns besides the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable

ALPHA, DEGREE, BUILD_BEAM, BEAM = 1.2, 48, 96, 64
SHARD_ROWS, SHARD_BYTES, MIN_SHARDS, CLASSES = 2000, 1 << 25, 6, 64
GROUP_ROWS, GROUP_BYTES, BLOCK = 50_000, 1 << 26, 1 << 15
SAMPLE, TARGET = 32, 0.95

# --- one shard's graph -------------------------------------------------------


class Graph:
    """A robust-pruned directed graph over the rows of x (float32)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
        n = len(x)
        self._place(x)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        self.edges = np.full((n, degree), -1, np.int32)
        self.count = np.zeros(n, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        self.entry = int(np.argmin(((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int64) if n else order
        done, size = 1, 1
        while done < n:
            batch = order[done : done + size]
            self._insert(batch)
            done += len(batch)
            size = min(2 * size, 512, n)

    def _place(self, x: np.ndarray) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        norms = np.einsum("ij,ij->i", self.x, self.x)
        lift = np.sqrt(np.maximum(0, norms.max(initial=0) - norms)).astype(np.float32)
        self.points = np.hstack([self.x, lift[:, None]])
        self.sq = np.einsum("ij,ij->i", self.points, self.points)

    @classmethod
    def restore(cls, x: np.ndarray, edges: bytes, entry: int) -> "Graph":
        g = cls.__new__(cls)
        g._place(x)
        g.edges = np.frombuffer(edges, np.int32).reshape(len(x), -1)
        g.degree, g.entry = g.edges.shape[1], entry
        return g

    def _insert(self, batch: np.ndarray) -> None:
        found, dist = self._search(self.points[batch], self.beam, with_seen=True)
        self._prune_into(batch, found, dist)
        # Back edges: append where there is room, prune where there is none.
        src = np.repeat(batch, self.degree)
        dst = self.edges[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, starts, counts = np.unique(dst, return_index=True, return_counts=True)
        most = int(counts.max(initial=0))
        if not most:
            return
        new = np.full((len(targets), most), -1, np.int64)
        new[np.repeat(np.arange(len(targets)), counts), np.arange(len(dst)) - np.repeat(starts, counts)] = src
        room = self.count[targets] + counts <= self.degree
        for t, row, c in zip(targets[room], new[room], counts[room]):
            self.edges[t, self.count[t] : self.count[t] + c] = row[:c]
            self.count[t] += c
        if (~room).any():
            full = targets[~room]
            cand = np.hstack([self.edges[full].astype(np.int64), new[~room]])
            self._prune_into(full, cand, self._distances(self.points[full], cand))

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        safe = np.maximum(ids, 0)
        d = self.sq[safe] - 2 * np.einsum("bd,bkd->bk", q, self.points[safe]) + np.einsum("bd,bd->b", q, q)[:, None]
        return np.where(ids < 0, np.inf, np.maximum(d, 0))

    def _prune_into(self, rows: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> None:
        """Robust pruning of each row's candidates, nearest first."""
        for start in range(0, len(rows), 128):
            part = rows[start : start + 128]
            c, d = cand[start : start + 128], dist[start : start + 128].copy()
            d[c == part[:, None]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, : 3 * self.degree]
            c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
            vec = self.points[np.maximum(c, 0)]
            between = self.sq[np.maximum(c, 0)]
            between = np.maximum(between[:, :, None] + between[:, None, :] - 2 * vec @ vec.transpose(0, 2, 1), 0)
            alive = np.isfinite(d)
            out = np.full((len(part), self.degree), -1, np.int32)
            kept = np.zeros(len(part), np.int32)
            at = np.arange(len(part))
            for _ in range(self.degree):
                best = np.argmax(alive, axis=1)
                ok = alive[at, best]
                if not ok.any():
                    break
                out[at[ok], kept[ok]] = c[at[ok], best[ok]]
                kept += ok
                # Squared distances: a kept neighbour closer by the factor alpha makes a candidate needless.
                alive &= ~((self.alpha**2 * between[at, best] <= d) & ok[:, None])
                alive[at, best] = False
            self.edges[part], self.count[part] = out, kept

    def _search(self, q: np.ndarray, beam: int, with_seen: bool = False, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows of q together: the beam's ids and squared distances, nearest first."""
        b = len(q)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], dist[:, 0], open_[:, 0] = self.entry, self._distances(q, np.full((b, 1), self.entry))[:, 0], True
        seen = np.zeros((b, len(self.x)), bool)
        seen[:, self.entry] = True
        active = np.arange(b)
        while len(active):
            # The nearest few open entries of each beam are expanded at once.
            o = open_[active]
            rank = np.cumsum(o, axis=1)
            take = o & (rank <= step)
            open_[active] = o & ~take
            who, col = np.nonzero(take)
            near = self.edges[ids[active[who], col]].astype(np.int64)
            who = np.repeat(who, self.degree)
            near = near.ravel()
            ok = near >= 0
            who, near = who[ok], near[ok]
            fresh = ~seen[active[who], near]
            who, near = who[fresh], near[fresh]
            key = np.unique(who * len(self.x) + near)
            who, near = key // len(self.x), key % len(self.x)
            if len(who):
                seen[active[who], near] = True
                counts = np.bincount(who, minlength=len(active))
                first = np.cumsum(counts) - counts
                wide = np.full((len(active), int(counts.max())), -1, np.int64)
                wide[who, np.arange(len(who)) - first[who]] = near
                d = self._distances(q[active], wide).astype(np.float32)
                all_ids = np.hstack([ids[active], wide])
                all_d = np.hstack([dist[active], d])
                all_o = np.hstack([open_[active], wide >= 0])
                order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
                ids[active] = np.take_along_axis(all_ids, order, 1)
                dist[active] = np.take_along_axis(all_d, order, 1)
                open_[active] = np.take_along_axis(all_o, order, 1)
            active = active[open_[active].any(axis=1)]
        return ids, dist

    def query(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Ids (-1: none) of the beam of each query, by largest inner product."""
        length = np.sqrt(np.einsum("ij,ij->i", q, q))
        unit = (q / np.where(length > 0, length, 1)[:, None]).astype(np.float32) * np.sqrt(self.sq.max(initial=1))
        lifted = np.hstack([unit, np.zeros((len(q), 1), np.float32)]).astype(np.float32)
        parts = [self._search(lifted[i : i + 256], beam)[0] for i in range(0, len(q), 256)]
        return np.vstack(parts) if parts else np.empty((0, beam), np.int64)

    def measured_beam(self, x: np.ndarray, q: np.ndarray, top: int, beam: int = BEAM, target: float = TARGET) -> int:
        """The first beam, doubling from the given one, that finds target of the top of queries q in points x."""
        if not len(q) or not len(x):
            return max(beam, top)
        exact = q @ x.T
        k = min(top, len(x))
        least = np.partition(exact, len(x) - k, axis=1)[:, len(x) - k]
        while beam < len(x):
            found = self.query(q, beam)
            near = np.where(found >= 0, np.take_along_axis(exact, np.maximum(found, 0), 1), -np.inf)
            if np.minimum((near >= least[:, None]).sum(axis=1), k).mean() >= target * k:
                break
            beam *= 2
        return max(top, min(beam, len(x)))


# --- Spark -------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): the rows that take part, as arrays of double."""
    vec = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.frombuffer(v, "<f8") for v in column]) if len(column) else np.empty((0, 0))


def _pack(rows: DataFrame) -> DataFrame:
    """Vectors as bytes (little-endian doubles), a form that is hashed and shuffled cheaply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
            ends = np.cumsum([0, *b.column(1).value_lengths().to_numpy(zero_copy_only=False)])
            packed = [flat[i:j].astype("<f8").tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["id", "v"])

    return rows.mapInArrow(run, "id long, v binary")


def _with_norm(points: DataFrame) -> DataFrame:
    """points (h, v, ids, dim) with the norm of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms = [float(np.linalg.norm(np.frombuffer(v, "<f8"))) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norms, pa.float64())], names=[*b.schema.names, "norm"])

    return points.mapInArrow(run, "h long, v binary, ids array<long>, dim int, norm double")


def _norm_classes(points: DataFrame, classes: int) -> list[float]:
    """Up to classes - 1 rising bounds that cut the points' norms into parts of about equal size."""
    if classes < 2:
        return []
    shares = [k / classes for k in range(1, classes)]
    got = points.agg(F.percentile_approx("norm", F.array(*map(F.lit, shares)), F.lit(10_000)).alias("q")).first()["q"]
    return sorted(set(got or []))


def search(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = 20,
    shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS, beam: int = BEAM, target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the top nearest of each row whose id is divisible by every."""
    packed = durable(_pack(usable(vectors, id_col, vec_col)).distinct())
    # Copies: the smallest ids of each vector, limited within the tasks before the exchange.
    by_vector = W.partitionBy("h", "v").orderBy("id")
    few = packed.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= top + 1)
    points = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.length("v"))
    points = durable(_with_norm(points))
    size = points.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n, row_bytes = size["n"], size["dim"] or 8
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // row_bytes))
    group_rows = max(shard_rows, min(GROUP_ROWS, GROUP_BYTES // row_bytes))
    shards = max(min_shards, -(-n // shard_rows))
    groups = max(min_shards, -(-n // group_rows))
    asked = packed.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // max(1, min(BLOCK, GROUP_BYTES // row_bytes))))
    # A query's vector is searched once however many ids share it; the smallest of them names it.
    named = asked.withColumn("h", F.xxhash64("v")).groupBy("h", "v").agg(F.min("id").alias("qid"))
    queries = durable(named.withColumn("dim", F.length("v")).withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int")))
    # At most SAMPLE queries of each vector length; lengths differ only where the table mixes them.
    first = W.partitionBy("dim").orderBy("h", "v")
    sample = [(r["dim"], bytes(r["v"])) for r in queries.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE).orderBy("dim", "h", "v").collect()]

    bounds = _norm_classes(points, min(CLASSES, shards))
    kind = F.lit(0)
    for bound in bounds:
        kind = kind + F.when(F.col("norm") > bound, 1).otherwise(0)
    classed = points.withColumn("kind", kind)
    # At most CLASSES rows a vector length; a class is split by hash into shards of its own.
    split = classed.groupBy("dim", "kind").agg(F.ceil(F.count("*") / F.lit(-(-n // shards) or 1)).cast("int").alias("parts"))
    dealt = classed.join(F.broadcast(split), ["dim", "kind"]).withColumn("part", F.pmod(F.shiftright("h", 17), F.col("parts")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        # Order by content: the graph does not depend on the order in which rows arrive.
        pdf = pdf.sort_values(["h", "v"], kind="stable")
        x, dim = _matrix(pdf.v), int(pdf.dim.iloc[0])
        g = Graph(x)
        asks = [np.frombuffer(v, "<f8") for d, v in sample if d == dim]
        chosen = g.measured_beam(x, np.vstack(asks) if asks else x[:0], top + 1, beam, target)
        return pd.DataFrame({"dim": [dim], "kind": [pdf.kind.iloc[0]], "part": [pdf.part.iloc[0]], "x": [x.tobytes()], "edges": [g.edges.tobytes()],
                             "entry": [g.entry], "beam": [chosen], "ids": [[list(map(int, i)) for i in pdf.ids]]})

    made = dealt.select("dim", "kind", "part", "h", "v", "ids").groupBy("dim", "kind", "part").applyInPandas(
        build, "dim int, kind int, part int, x binary, edges binary, entry int, beam int, ids array<array<long>>")
    graphs = durable(made.withColumn("grp", F.pmod(F.xxhash64("kind", "part"), F.lit(groups)).cast("int")).drop("kind", "part"))

    none = F.lit(None)
    sent = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "dim", "grp", "block", "x", "edges", "entry", "beam", "ids", F.lit(-1).cast("long").alias("qid"), none.cast("binary").alias("v"))
    asking = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        "dim", "grp", "block", none.cast("binary").alias("x"), none.cast("binary").alias("edges"), F.lit(-1).alias("entry"), F.lit(-1).alias("beam"),
        none.cast("array<array<long>>").alias("ids"), "qid", "v")

    def beam_search(pdf: pd.DataFrame) -> pd.DataFrame:
        index, q = pdf[pdf.x.notna()], pdf[pdf.v.notna()].sort_values("qid", kind="stable")
        out = {"qid": [], "vec_id": [], "score": []}
        if not len(index) or not len(q):
            return pd.DataFrame(out)
        qx, dim = _matrix(q.v), int(q.dim.iloc[0])
        near: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
        for shard in index.itertuples():
            original = np.frombuffer(shard.x, "<f8").reshape(-1, dim // 8)
            g = Graph.restore(original, shard.edges, int(shard.entry))
            for k, hit in enumerate(g.query(qx, max(int(shard.beam), top + 1))):
                hit = hit[hit >= 0]
                s = original[hit] @ qx[k]
                best = np.argsort(-s, kind="stable")[: 2 * top + 2]
                near[k] = sorted([*near[k], *((-float(s[j]), int(i)) for j in best for i in shard.ids[hit[j]])])[: top + 1]
        for key, pairs in zip(q.qid, near):
            out["qid"] += [key] * len(pairs)
            out["vec_id"] += [i for _, i in pairs]
            out["score"] += [-s for s, _ in pairs]
        return pd.DataFrame(out)

    found = sent.unionByName(asking).groupBy("dim", "grp", "block").applyInPandas(beam_search, "qid long, vec_id long, score double")
    # The best of all groups for each distinct query vector, then for each id that asked with it.
    best = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top + 1)
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.negative("score").alias("s"), "vec_id"))).alias("near"))
    own = asked.withColumn("h", F.xxhash64("v")).join(queries.select("h", "v", "qid"), ["h", "v"]).select(F.col("id").alias("query_id"), "qid")
    mine = own.join(lists, "qid").select(
        "query_id", F.slice(F.filter("near", lambda t: t.vec_id != F.col("query_id")), 1, top).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.negative("t.s").alias("score"))


def brute_force(x: np.ndarray, ids: np.ndarray, every: int = 20, top: int = 20) -> dict[int, list[tuple[int, float]]]:
    """The exact answer, for tests and for measuring recall."""
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = x.astype(np.float64) @ x[k].astype(np.float64)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:top]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out
