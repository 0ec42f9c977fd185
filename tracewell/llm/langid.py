"""Language identification by a byte convolutional network, trained in numpy.

Lower-cased UTF-8 bytes are cut into windows of WINDOW bytes that cover the whole
text (the last is filled with zero bytes). Each byte has an embedding; filters of
widths 2, 3 and 4 run over a window, keep their largest response, and a softmax
layer makes probabilities of the languages. A text's probabilities are the means
over its windows, weighted by their bytes.

Once trained, a filter's response is a sum of table entries of byte pairs and
single bytes, so the tables replace the multiplications; results are the same.

Training reads, for every value of lang outside the held-out fold, up to SAMPLE
documents (smallest hash of doc_id; fewer where TOTAL documents over all languages
would be passed, but one at least) and WINDOWS windows spread over each. No language
is left out. Rows with a null lang, text or doc_id are not learned from; a doc_id that
repeats counts once, with its smallest lang and text. Text that is null or has no
letter is `und` with score 0, and so is everything if nothing could be learned. Very
long texts are read whole, window by window; ties of probability go to the language
that sorts first; repeated rows are judged alike, an empty table gives an empty
result, and no column but the id, the text and lang is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import batch_of, held_out, map_batches, row_type, whole_rows

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
SAMPLE, TOTAL, WINDOWS, MARGIN = 500, 32_000, 4, 4
#: How far from chance (0) to certainty (1) a score must lie for a text to count as in a known language.
SURE = 0.1
_AT_ONCE = 128


def byte_windows(text: str) -> np.ndarray:
    raw = text.lower().encode()
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class ByteNetwork:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width * EMBED, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, ...]:
        """By pair of bytes: responses of width 2, the first pair of widths 3 and 4, the last pair of width 4; by byte: the last of width 3."""
        if getattr(self, "_tables", None) is None:
            one = [[(self.embed @ f[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filters)]
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
            self._tables = (pair(one[0][0], one[0][1]), pair(one[1][0], one[1][1]), one[1][2], pair(one[2][0], one[2][1]), pair(one[2][2], one[2][3]))
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        t2, t3, t3_last, t4, t4_last = self.tables()
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for start in range(0, len(windows), _AT_ONCE):
            b = windows[start : start + _AT_ONCE].astype(np.int64)
            p = b[:, :-1] * 256 + b[:, 1:]
            pooled = np.concatenate([
                t2.take(p, axis=0).max(axis=1),
                (t3.take(p[:, :-1], axis=0) + t3_last.take(b[:, 2:], axis=0)).max(axis=1),
                (t4.take(p[:, :-2], axis=0) + t4_last.take(p[:, 2:], axis=0)).max(axis=1),
            ], axis=1)
            z = np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[start : start + _AT_ONCE] = z / z.sum(axis=1, keepdims=True)
        return out


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 600, batch: int = 64, seed: int = 5) -> ByteNetwork:
    """Adam on cross entropy; the gradient of a pooled response flows through its largest place only."""
    rng = np.random.default_rng(seed)
    c = len(languages)
    params = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(len(WIDTHS) * FILTERS),
        "dense": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, c)), "dense_bias": np.zeros(c),
    } | {f"f{w}": rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS}
    params = {k: v.astype(np.float32) for k, v in params.items()}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    by_class = [np.flatnonzero(labels == k) for k in range(c)]
    for t in range(1, steps + 1):
        pick = np.array([by_class[k][rng.integers(len(by_class[k]))] for k in rng.integers(c, size=batch)])
        b, y = windows[pick].astype(np.int64), labels[pick]
        e = params["embed"][b]
        pooled, where = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            r = cols @ params[f"f{w}"]
            where.append(r.argmax(axis=1))
            pooled.append(r.max(axis=1))
        h = np.concatenate(pooled, axis=1) + params["bias"]
        a = np.maximum(h, 0)
        z = a @ params["dense"] + params["dense_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(batch), y] -= 1
        dz /= batch
        grad = {"dense": a.T @ dz, "dense_bias": dz.sum(axis=0)}
        dh = (dz @ params["dense"].T) * (h > 0)
        grad["bias"] = dh.sum(axis=0)
        de = np.zeros_like(params["embed"])
        for k, w in enumerate(WIDTHS):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            at = where[k][:, :, None] + np.arange(w)
            seen = b[np.arange(batch)[:, None, None], at]  # (batch, FILTERS, w)
            x = params["embed"][seen].reshape(batch, FILTERS, w * EMBED)
            grad[f"f{w}"] = np.einsum("bf,bfx->xf", g, x)
            back = np.einsum("bf,xf->bfx", g, params[f"f{w}"]).reshape(-1, EMBED)
            np.add.at(de, seen.ravel(), back)
        grad["embed"] = de
        rate = 0.01 * (1 - t / (steps + 1))
        for key, g in grad.items():
            m[key] += 0.1 * (g - m[key])
            s[key] += 0.001 * (g * g - s[key])
            params[key] -= rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(s[key] / (1 - 0.999**t)) + 1e-8)
    return ByteNetwork(languages, params["embed"], [params[f"f{w}"] for w in WIDTHS], params["bias"], params["dense"], params["dense_bias"])


def train(docs: DataFrame, mod: int = 4, part: int = 2, sample: int = SAMPLE, total: int = TOTAL) -> ByteNetwork | None:
    usable = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, part))
    # One row for each value of lang; ids, not rows, are counted, so that repeats do not narrow the bound below.
    counts = {r["lang"]: r["ids"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")).collect()}
    if not counts:
        return None
    sample = max(1, min(sample, total // len(counts)))
    # The smallest hashes of a language all lie below this bound (about MARGIN times the sample do),
    # so few rows of each language are left to be ordered.
    below = F.create_map(*[
        F.lit(x) for k, n in counts.items() for x in (k, min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * MARGIN * sample / max(1, n))))
    ])
    few = usable.where(F.xxhash64("doc_id") <= F.element_at(below, F.col("lang"))).distinct()
    nearest = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        few.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= sample)
        .groupBy("doc_id").agg(F.min("lang").alias("lang"))
    )
    # At most total ids (or one a language), each with one text.
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    types = {"doc_id": pa.int64(), "lang": pa.string(), "window": pa.binary()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            w = byte_windows(text)
            for k in sorted(set(np.linspace(0, len(w) - 1, WINDOWS).astype(int).tolist())):
                rows.append((key, lang, w[k].tobytes()))
        yield batch_of(dict(zip(types, list(zip(*rows)) or [[]] * 3)), types)

    got = map_batches(texts, [F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"], process, "doc_id long, lang string, window binary").toPandas()
    got = got.sort_values(["doc_id", "window"], kind="stable")
    languages = sorted(set(got.lang))
    if not languages:
        return None
    windows = np.vstack([np.frombuffer(w, np.uint8) for w in got.window])
    return fit(windows, np.searchsorted(languages, got.lang.to_numpy(dtype=str)), languages)


def judge(texts: list[str | None], model: ByteNetwork | None) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    for start in range(0, len(texts), 64):
        some = [k for k in range(start, min(len(texts), start + 64)) if texts[k] and has_letter(texts[k])] if model else []
        if not some:
            continue
        parts = [byte_windows(texts[k]) for k in some]
        counts = np.array([len(p) for p in parts])
        windows = np.vstack(parts)
        weight = np.maximum(1, (windows != 0).sum(axis=1))[:, None]
        p = np.add.reduceat(model.probabilities(windows) * weight, np.cumsum(counts) - counts)
        p /= p.sum(axis=1, keepdims=True)
        for k, row in zip(some, p):
            best = int(row.argmax())
            lang[k], score[k] = model.languages[best], min(1.0, float(row[best]))
    return lang, score


def identify(docs: DataFrame, model: ByteNetwork | None, mod: int = 4, part: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs."""
    types = {"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, score = judge(batch.column(2).to_pylist(), model)
        yield batch_of({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": lang, "score": score}, types)

    return map_batches(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", mod, part).alias("held_out"), "text"], process,
                       "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: ByteNetwork | None, sure: float = SURE) -> DataFrame:
    """The rows of docs that the network places in a learned language; a null lang becomes the predicted one.

    Dropped are texts that are null or hold no letter, and texts whose best language
    scores less than a share `sure` of the way from chance to certainty. Where nothing
    could be learned (no row has a lang), every text with a letter stays as it is.
    """
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    chance = 1 / len(model.languages)
    judged = with_language(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= chance + sure * (1 - chance)))
    return judged.select(*[
        F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def with_language(docs: DataFrame, model: ByteNetwork | None) -> DataFrame:
    """(row, lang_pred, score): every row of docs as it is, with its language."""

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, score = judge(batch.column(0).field("text").to_pylist(), model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return map_batches(docs, [whole_rows(docs)], process, f"row {row_type(docs)}, lang_pred string, score double")
