import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.docs import AWKWARD, documents, text
from tracewell.llm import langid, pii, quality, toxicity
from tracewell.llm.common import labelled_ids

INSULTS, GROUPS = ["nitwit", "dolt"], ["plumbers", "bakers"]


def labelled(n=600):
    """Toxic only if an insult meets a group: no sum of single weights can tell."""
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(n):
        words = text(20, k % 9).split()
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ([rng.choice(INSULTS)] if a else []) + ([rng.choice(GROUPS)] if b else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(a and b)))
    return docs, labels


def frames(spark, docs, labels):
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_pairs(spark):
    docs, labels = labelled()
    d, l = frames(spark, docs, labels)
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.train(d, l)).collect()}
    held = [k for k, *_ in docs if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k, *_ in docs)
    assert np.mean([got[k].predicted == labels[k][2] for k in held]) > 0.95


def test_toxicity_of_awkward_rows(spark):
    d, l = frames(spark, AWKWARD, [(8, 1, 1), (9, 0, 0), (None, 1, 1), (6, 5, 5), (8, 0, 0)])
    for labels in (l, l.where("false")):
        rows = toxicity.score(d, toxicity.train(d, labels)).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (8, 9, None)}) == 1
    assert toxicity.score(documents(spark, []), toxicity.train(d, l)).count() == 0
    kept = toxicity.with_score(d, toxicity.train(d, l)).select("row.*")
    assert kept.columns == d.columns and kept.count() == len(AWKWARD)


def test_sample_is_bounded_and_outside_the_fold(spark):
    l = spark.createDataFrame([(k, 1, k % 2) for k in range(500)], "doc_id long, quality int, toxic int")
    ids = [r.doc_id for r in labelled_ids(l, "toxic", 5, 0, 50).collect()]
    assert len(ids) == 50 and all(zlib.crc32(str(k).encode()) % 5 for k in ids)


def test_quality(spark):
    rng = random.Random(2)
    docs = []
    for k in range(400):
        t = text(rng.randint(30, 200), k)
        docs.append((k, t if k % 2 else t.upper().replace(" ", "!! ") if k % 4 else " | ".join(t.split()), "en", "s", 1))
    d, l = frames(spark, docs, [(k, k % 2, 0) for k in range(400)])
    model = quality.train(d, l)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].predicted == k % 2 for k in held]) > 0.97 and all(got[k].held_out for k in held)
    # The kept factors give the density that numpy gives from the covariance.
    x = np.array([quality.statistics(docs[k][1]) for k in held[:5]])
    z = (x - model.center) / model.scale
    low = [np.linalg.inv(i) for i in model.inverse]
    ld = [-0.5 * np.einsum("ij,ij->i", (z - m) @ np.linalg.inv(c @ c.T), z - m) - 0.5 * np.linalg.slogdet(c @ c.T)[1] for m, c in zip(model.means, low)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(ld[1] - ld[0] + model.prior))))


def test_quality_of_awkward_rows(spark):
    d, l = frames(spark, AWKWARD, [(8, 1, 1), (9, 1, 0)])
    for labels in (l, l.where("false")):
        rows = quality.score(d, quality.train(d, labels)).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.score(documents(spark, []), quality.train(d, l)).count() == 0


def test_language(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "and", "th"], "fr": ["eau", "é", "oi", "que"], "de": ["ung", "ß", "ich", "ei"]}
    docs = []
    for k in range(360):
        lang = "en fr de".split()[k % 3]
        docs.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(80)), lang, "s", 1))
    docs += [(1000 + k, t, None, "s", 1) for k, t in enumerate([None, "", "12 !?", "étéauque oiqueau"])]
    d = documents(spark, docs)
    model = langid.train(d)
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    held = [k for k in range(360) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].lang_pred == docs[k][2] for k in held]) > 0.97
    assert [got[1000 + k].lang_pred for k in range(4)] == ["und", "und", "und", "fr"] and got[1000].score == 0
    assert langid.with_language(d, model).select("row.*").columns == d.columns


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.fit(w, rng.integers(0, 2, 40), ["a", "b"], steps=5)
    e = net.embed[w]
    pooled = np.concatenate([
        (np.concatenate([e[:, j : langid.WINDOW - k + 1 + j] for j in range(k)], axis=2) @ f).max(axis=1) for k, f in zip(langid.WIDTHS, net.filters)], axis=1)
    z = np.maximum(pooled + net.bias, 0) @ net.dense + net.dense_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(w), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_of_awkward_rows(spark):
    d = documents(spark)
    rows = langid.identify(d, langid.train(d)).collect()
    assert len(rows) == len(AWKWARD) and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 4}
    empty = documents(spark, [])
    assert langid.train(empty) is None and langid.identify(d, None).where("lang_pred = 'und'").count() == len(AWKWARD)


# --- personal data ---------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
            "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_by_hand(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            digits = re.sub(r"\D", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def strings():
    rng = random.Random(9)
    pieces = ["a@b.c", ".", "@", "d-e.fg", "+1 (017) 555-7713", "1.2.3.4", "256.1", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "é😀", "007", "+", "(", "-", "12345678901234567890", "x", "joe (at) ex (dot) com"]
    return [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for k in range(1500)]


def test_base_spans_against_plain_patterns(spark):
    rows = [(k, t, "en", "s", 1) for k, t in strings()] + [(k and k + 5000, *rest) for k, *rest in AWKWARD] + [(9000, "+" * 3000 + "1" * 20000 + "@" + "a." * 3000, "en", "s", 1)]
    got = pii.digest(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    text_of = {k: t for k, t, *_ in rows}
    for r in got:
        want = base_by_hand(text_of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text_of[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_further_spans_and_clean_texts(spark):
    rows = [(k, f"see mail{k}@x.com or call +1 (415) 555-{1000 + k} now", "en", "s", 1) for k in range(40)]
    rows += [(100, "mail me: joe (at) example (dot) com, call (415) 555-2671", "en", "s", 1), (101, "order 4111111111111112 of 2020-10-10, 12 of 34", "en", "s", 1)]
    got = {r.doc_id: r.spans for r in pii.digest(documents(spark, rows)).collect()}
    assert got[100] == "email:9:35,phone:42:56" and got[101] == ""


def test_masking(spark):
    rows = [(1, "a@b.cd é 1.2.3.4!", "en", "s", 1), (2, None, "en", "s", 1), (3, "clean", "en", "s", 1), (4, "a@b.cd +12 345 678 90 x", "en", "s", 1)]
    d = documents(spark, rows)
    out = pii.masked(d)
    assert out.columns == d.columns and {(r.spans, r.base, r.row) for r in out.collect()} == {(1, 1, "r")}
    assert {r.doc_id: r.text for r in out.collect()} == {1: "[EMAIL] é [IP]!", 2: None, 3: "clean", 4: "[EMAIL] [PHONE] x"}
    assert pii.masked(documents(spark, [])).count() == 0 and pii.digest(documents(spark, [])).count() == 0


def test_no_python_on_the_way(spark):
    plan = pii.digest(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_reliabilities_follow_agreement(spark):
    rows = [(0, False, 2, 2, 2, 90), (0, False, 0, 0, 0, 80), (0, False, 2, 2, 0, 10), (0, False, 0, 0, 2, 10), (0, True, 2, 2, 1, 20)]
    df = spark.createDataFrame(rows, "kind int, base boolean, v1 int, v2 int, v3 int, n long")
    w = {(r.base, r.v1, r.v2, r.v3): r.w for r in pii.vote_probabilities(df).collect()}
    assert w[True, 2, 2, 1] == 1 and w[False, 2, 2, 2] > 0.99 and w[False, 0, 0, 0] < 0.01 and w[False, 2, 2, 0] > 0.5 > w[False, 0, 0, 2]


def test_pairwise_score_equals_a_double_loop():
    rng = np.random.default_rng(5)
    fm = toxicity.FactorizationMachine(np.arange(40), 0.3, rng.normal(size=40), rng.normal(size=(40, 6)) * 0.3)
    rows = []
    for n in (0, 1, 2, 7, 30):
        at = np.sort(rng.choice(40, n, replace=False))
        rows.append((at, rng.uniform(0.5, 2, n)))
    for (at, x), got in zip(rows, fm.score_rows(rows)):
        z = fm.w0 + sum(fm.w[i] * a for i, a in zip(at, x))
        for k in range(len(at)):
            for l in range(k):
                z += fm.v[at[k]] @ fm.v[at[l]] * x[k] * x[l]
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_fit_holds_few_factors_of_positions_at_once():
    """The sample's positions times factors don't fit beside the driver's JVM; the weights are those of all at once."""
    rng = np.random.default_rng(5)
    docs = [(list(range(k % 7, 2000, 11)), [1.0 + k % 3] * len(range(k % 7, 2000, 11))) for k in range(2000)]
    labels, chosen = rng.integers(0, 2, len(docs)).tolist(), np.arange(0, 2000, 2)
    tracemalloc.start()
    fm = toxicity.fit(chosen, docs, labels, epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = [fm.positions(*d) for d in docs]
    assert peak < 24 * sum(len(at) for at, _ in rows) * toxicity.FACTORS
    whole = toxicity.fit(chosen, docs, labels, epochs=2)
    block, toxicity._BLOCK = toxicity._BLOCK, 1 << 40
    try:
        once = toxicity.fit(chosen, docs, labels, epochs=2)
    finally:
        toxicity._BLOCK = block
    assert once.w0 == whole.w0 and (once.w == whole.w).all() and (once.v == whole.v).all()
