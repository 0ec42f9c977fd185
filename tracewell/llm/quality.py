"""Text quality by regularised quadratic discriminant analysis.

Each text becomes a vector of statistics of the whole text (sizes, shares of
character classes, repetition, line shapes), each brought near a normal shape by
a logarithm. Each class has a mean and a covariance, shrunk towards a scaled unit
matrix; the density's Cholesky factor is computed once and its inverse kept, so a
score is two matrix products: half the difference of squared Mahalanobis lengths
and log determinants, plus the classes' log prior odds, through the logistic.

Training reads up to SAMPLE labelled documents (those with the smallest hash of
doc_id) outside the held-out fold; only their statistics reach the driver. A null
text counts as empty and is scored like it. With no labelled rows, or rows of one
class only, the score is that class's share (1 if nothing is known). A doc_id that
repeats is learned from once, with its smallest text and largest label. Repeated rows
get equal scores, very long texts are read whole, an empty table gives an empty result, and no column but the id,
the text and the labels is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, held_out, labelled_texts, map_batches

SAMPLE, SHRINKAGE, THRESHOLD = 20_000, 0.1, 0.7
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = 4
for _c in b".,;:'\"?()-":
    _CLASS[_c] = 5
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 6
_CLASS[128:] = 7
#: Ordinary shares of capitals, digits, white space, punctuation and symbols. A text's shares
#: are taken as if PRIOR such bytes (or words) stood before it, so a few words are not extreme.
_USUAL = np.array([0.03, 0.005, 0.16, 0.025, 0.002])
PRIOR = 40
FEATURES = 14


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    words = raw.split()
    m = len(words)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = (counts[[2, 3, 4, 5, 6]] + PRIOR * _USUAL) / (n + PRIOR)
    letters = int(counts[1] + counts[2] + counts[7])
    small = sum(c for w, c in seen.items() if len(w) <= 3)
    part = lambda x, usual: (x + PRIOR * usual) / (m + PRIOR)
    return np.array([
        np.log((n + 6 * PRIOR) / (m + PRIOR)),
        *np.log(share + 1e-3), np.log((counts[2] + 0.03 * PRIOR) / (letters + PRIOR)),
        # Distinct words of a text fall with the square root of its length.
        np.log((len(seen) + PRIOR) / (m + PRIOR)) / np.log(m + 10), np.log(part(small, 0.4) + 1e-2),
        np.log(part(max(seen.values(), default=0), 0.05)), np.log((len(lines) - len(set(lines)) + 0.1) / (len(lines) + 5)),
        np.log((n + 200) / (len(lines) + 2)),
        np.log(part(raw.count(b"!"), 0.002)), np.log(part(raw.count(b"|"), 0.002)),
    ])


@dataclass
class Discriminant:
    prior: float  # log odds of class 1, or the constant's logit if means is None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    inverse: np.ndarray | None = None  # inverses of the Cholesky factors, by class
    log_det: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        z = (x - self.center) / self.scale
        density = [-0.5 * (((z - self.means[c]) @ self.inverse[c].T) ** 2).sum(axis=1) - self.log_det[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if n1 < 2 or n0 < 2:
        return Discriminant(500.0 if n0 == 0 else -500.0 if n1 == 0 else float(np.log(n1 / n0)))
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - center) / scale
    means, inverse, log_det = [], [], []
    for c in (0, 1):
        part = z[y == c]
        cov = np.cov(part.T)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        means.append(part.mean(axis=0))
        inverse.append(np.linalg.inv(low))
        log_det.append(float(np.log(np.diag(low)).sum()))
    return Discriminant(float(np.log(n1 / n0)), center, scale, np.array(means), np.array(inverse), np.array(log_det))


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, part: int = 2, sample: int = SAMPLE) -> Discriminant:
    texts = labelled_texts(docs, labels, "quality", mod, part, sample)
    types = {"x": pa.list_(pa.float64()), "label": pa.int32(), "doc_id": pa.int64()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch_of({"x": [statistics(t) for t in batch.column(0).to_pylist()], "label": batch.column(1), "doc_id": batch.column(2)}, types)

    got = map_batches(texts, ["text", "label", "doc_id"], process, "x array<double>, label int, doc_id long").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if got.num_rows else np.zeros((0, FEATURES))
    return fit(x[order], got.column("label").to_numpy()[order])


def score(docs: DataFrame, model: Discriminant, mod: int = 4, part: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    types = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = [statistics(t) for t in batch.column(2).to_pylist()]
        s = model.score(np.array(x)) if x else np.zeros(0)
        yield batch_of({"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= threshold).astype(np.int32)}, types)

    return map_batches(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", mod, part).alias("held_out"), "text"], process,
                       "doc_id long, held_out boolean, score double, predicted int")
