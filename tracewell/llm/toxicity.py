"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their beginnings of 4 to 7
letters (inflected and compound words share them), hashed into 2**22 buckets. A
term's value is 1 + ln of the number of distinct words that have it, however
long the text. Training reads up to SAMPLE labelled
documents (those with the smallest hash of doc_id) outside the held-out fold,
keeps the TERMS buckets whose share differs most surely between the classes, and
fits w0 + sum w + sum of <v_i, v_j> over pairs of a text's terms by logistic loss.
The pairwise part learns terms that matter only together, such as an insult with
the mention of a group; additive weights can't.

Scores are probabilities of label 1, for every row of the table, over the whole
text. A null or empty text has no terms and gets the bias alone. Without any
labelled rows the score is 0 (within rounding) for all. Repeated rows get equal
scores, ties in choosing terms go to the smaller bucket, an empty table gives an
empty result, and no column but the id, the text and the labels is read. The
collected sample is bounded by SAMPLE documents with their distinct terms; a
doc_id that repeats counts once, with its smallest text and largest label. Very
long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, durable, few_rows, held_out, labelled_texts, map_batches, row_type, whole_rows

BUCKETS, TERMS, FACTORS, SAMPLE = 1 << 22, 4096, 8, 8000
_WORD = re.compile(r"\w+")


PREFIXES = (4, 5, 6, 7)
_CACHE = 50_000
_BLOCK = 1 << 15


def word_buckets(word: str) -> list[int]:
    """Buckets of one lower-cased word's terms."""
    return [xxhash.xxh32_intdigest(t) & (BUCKETS - 1) for t in (word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k))]


def buckets_of(text: str | None) -> tuple[list[int], list[float]]:
    """Sorted buckets of a text's terms and their values."""
    found = Counter(b for w in set(_WORD.findall((text or "").lower())) for b in word_buckets(w))
    ids = sorted(found)
    return ids, [1 + math.log(found[i]) for i in ids]


@dataclass
class FactorizationMachine:
    buckets: np.ndarray  # sorted hash buckets
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score_rows(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities for rows of positions in buckets and values."""
        if not rows:
            return np.zeros(0)
        z = np.full(len(rows), self.w0)
        full = np.array([k for k, (at, _) in enumerate(rows) if len(at)], dtype=np.int64)
        if len(full):
            flat, x = (np.concatenate([rows[k][i] for k in full]) for i in (0, 1))
            starts = np.cumsum([0, *(len(rows[k][0]) for k in full)])[:-1]
            vx = self.v[flat] * x[:, None]
            s, q = np.add.reduceat(vx, starts), np.add.reduceat(vx**2, starts)
            z[full] += np.add.reduceat(self.w[flat] * x, starts) + 0.5 * (s * s - q).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def positions(self, ids: list[int], values: list[float]) -> tuple[np.ndarray, np.ndarray]:
        ids, values = np.asarray(ids, np.int64), np.asarray(values, np.float64)
        if not len(self.buckets):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.buckets, ids)
        at[at == len(self.buckets)] = 0
        known = self.buckets[at] == ids
        return at[known], values[known]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """positions(*buckets_of(text)), by a cache of the words seen before."""
        if getattr(self, "_words", None) is None:
            self._words, self._place = {}, {int(b): k for k, b in enumerate(self.buckets)}
        found: Counter = Counter()
        words, place = self._words, self._place
        for w in set(_WORD.findall((text or "").lower())):
            at = words.get(w)
            if at is None:
                if len(words) >= _CACHE:
                    words.clear()
                at = words[w] = [place[b] for b in word_buckets(w) if b in place]
            if at:
                found.update(at)
        ids = sorted(found)
        return np.array(ids, np.int64), 1 + np.log(np.array([found[i] for i in ids], np.float64))


def z_score(c1, c0, n1, n0):
    """How surely the shares c1 / n1 and c0 / n0 differ; works on numbers, arrays and Columns."""
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    return (c1 / n1 - c0 / n0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5


def fit(chosen: np.ndarray, docs: list[tuple[list[int], list[float]]], labels: list[int], factors: int = FACTORS, epochs: int = 200, seed: int = 3) -> FactorizationMachine:
    """Fit on documents as (buckets, values), of which those in chosen (sorted) count."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        const = -30.0 if not len(y) or y.max() == 0 else 30.0
        return FactorizationMachine(np.zeros(0, np.int64), const, np.zeros(0), np.zeros((0, factors)))
    rng = np.random.default_rng(seed)
    fm = FactorizationMachine(chosen, float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), factors)))
    rows = [fm.positions(*d) for d in docs]
    full = np.array([k for k, (at, _) in enumerate(rows) if len(at)], dtype=np.int64)
    if not len(full):
        return fm
    flat, x = (np.concatenate([rows[k][i] for k in full]) for i in (0, 1))
    counts = np.array([len(rows[k][0]) for k in full])
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(full)), counts)
    # Documents of about _BLOCK positions at a time: of a factor for each position, only so many are held at once.
    cuts = [0, *(np.flatnonzero(np.diff(starts // _BLOCK)) + 1).tolist(), len(full)]
    s, pairs = np.empty((len(full), factors)), np.empty(len(full))
    # Adam over the whole sample; l2 keeps the weights of rare terms small.
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("b", np.zeros(1)), ("w", fm.w), ("v", fm.v))}

    def step(key: str, grad: np.ndarray, rate: float, t: int) -> np.ndarray:
        m, s = state[key]
        m += 0.1 * (grad - m)
        s += 0.01 * (grad**2 - s)
        return rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

    for t in range(1, epochs + 1):
        for lo, hi in zip(cuts, cuts[1:]):
            at = slice(starts[lo], starts[hi] if hi < len(full) else len(flat))
            vx = fm.v[flat[at]] * x[at, None]
            s[lo:hi] = np.add.reduceat(vx, starts[lo:hi] - starts[lo])
            pairs[lo:hi] = 0.5 * (s[lo:hi] * s[lo:hi] - np.add.reduceat(vx * vx, starts[lo:hi] - starts[lo])).sum(axis=1)
        z = np.full(len(y), fm.w0)
        z[full] += np.add.reduceat(fm.w[flat] * x, starts) + pairs
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        e = err[full][owner] * x
        gw = np.bincount(flat, weights=e, minlength=len(chosen)) + 1e-5 * fm.w
        gv = np.empty_like(fm.v)
        for f in range(factors):
            gv[:, f] = np.bincount(flat, weights=e * (s[owner, f] - fm.v[flat, f] * x), minlength=len(chosen))
        fm.w0 -= float(step("b", np.array([err.sum()]), 0.05, t)[0])
        fm.w = fm.w - step("w", gw, 0.1, t)
        fm.v = fm.v - step("v", gv + 1e-4 * fm.v, 0.02, t)
    return fm


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, part: int = 0, sample: int = SAMPLE, terms: int = TERMS) -> FactorizationMachine:
    texts = labelled_texts(docs, labels, "toxic", mod, part, sample)
    types = {"terms": pa.list_(pa.int32()), "weights": pa.list_(pa.float64()), "label": pa.int32(), "doc_id": pa.int64()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batch):
            found = [buckets_of(t) for t in part.column(0).to_pylist()]
            yield batch_of({"terms": [t for t, _ in found], "weights": [x for _, x in found], "label": part.column(1), "doc_id": part.column(2)}, types)

    sampled = durable(map_batches(texts, ["text", "label", "doc_id"], process, "terms array<int>, weights array<double>, label int, doc_id long"))
    n = sampled.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    n1, n0 = max(1, n["n1"] or 0), max(1, n["n0"] or 0)
    # Buckets in 3 documents or more, by how surely their shares differ; at most terms of them reach the driver.
    counts = sampled.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(
        F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0")).where("c1 + c0 >= 3")
    best = counts.withColumn("z", F.abs(z_score(F.col("c1"), F.col("c0"), n1, n0))).where("z > 3").orderBy(F.desc("z"), "bucket").limit(terms)
    chosen = np.array(sorted(r["bucket"] for r in best.select("bucket").collect()), np.int64)

    def reduce(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out_terms, out_weights = [], []
        for t, x in zip(batch.column(0), batch.column(1)):
            t, x = t.values.to_numpy(), x.values.to_numpy()
            keep = np.isin(t, chosen)
            out_terms.append(t[keep])
            out_weights.append(x[keep])
        yield batch_of({"terms": out_terms, "weights": out_weights, "label": batch.column(2), "doc_id": batch.column(3)}, types)

    got = map_batches(sampled, ["terms", "weights", "label", "doc_id"], reduce, "terms array<int>, weights array<double>, label int, doc_id long").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    t, x, label = got.column("terms"), got.column("weights"), got.column("label").to_numpy()
    return fit(chosen, [(t[int(k)].values.to_numpy(), x[int(k)].values.to_numpy()) for k in order], label[order].tolist())


def score(docs: DataFrame, model: FactorizationMachine, mod: int = 5, part: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model_ref = docs.sparkSession.sparkContext.broadcast(model)
    types = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fm = model_ref.value
        for part in few_rows(batch):
            s = fm.score_rows([fm.read(t) for t in part.column(2).to_pylist()])
            yield batch_of({"doc_id": part.column(0), "held_out": part.column(1), "score": s, "predicted": (s >= 0.5).astype(np.int32)}, types)

    return map_batches(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", mod, part).alias("held_out"), "text"], process,
                       "doc_id long, held_out boolean, score double, predicted int")


def with_score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(row, score): every row of docs as it is, with its score."""
    model_ref = docs.sparkSession.sparkContext.broadcast(model)

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fm = model_ref.value
        for part in few_rows(batch):
            s = fm.score_rows([fm.read(t) for t in part.column(0).field("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    return map_batches(docs, [whole_rows(docs)], process, f"row {row_type(docs)}, score double")
