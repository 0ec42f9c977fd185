import random

import numpy as np
import pytest

from tests.llm.docs import AWKWARD, documents, text
from tracewell.llm import ann, simhash
from tracewell.llm.common import durable


def by_hand(rows):
    """Fingerprints and components, one bit and one pair at a time."""
    import xxhash

    fps = []
    for _, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        words, word = [], ""
        for c in low + " ":
            if c in " \t\n\x0b\x0c\r":
                words += [word] if word else []
                word = ""
            else:
                word += c
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, (key, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((str(key), f"{fps[i]:016x}", least[find(i)]) for i, (key, *_) in enumerate(rows)), key=str)


def results(df):
    return sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect()), key=str)


def near_copies():
    rng = random.Random(7)
    rows = list(AWKWARD)
    for family in range(6):
        words = text(300, family + 10).split()
        for k in range(8):
            copy = list(words)
            for _ in range(k // 3):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 * (family + 1) + k, (" " if k % 2 else "\n").join(copy).title() if k == 5 else " ".join(copy), "en", "s", 1))
    return rows


def test_simhash_against_brute_force(spark):
    rows = near_copies()
    assert results(simhash.near_duplicates(documents(spark, rows))) == by_hand(rows)


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_lose_no_pair(spark):
    """Random fingerprints with planted neighbours, crowded cells dealt into small parts."""
    rng = random.Random(8)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 12)):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    for part in (1000, 3):
        got = [(r.a, r.b) for r in simhash.links(points, part).collect()]
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_stars_need_no_rounds(spark, monkeypatch):
    """Written edges are the driver's tasks and plans: one for those given, and one for each round that changes them."""
    written = []
    monkeypatch.setattr(simhash, "durable", lambda df: written.append(1) or durable(df))
    rng = random.Random(3)
    stars = [(k, k + 1 + i) for k in range(0, 1000, 100) for i in range(rng.randint(1, 60))]
    for edges, more in ((stars, 0), (stars + stars, 0), (stars[:0], 0), ([*stars, (0, 90), (90, 190)], 1)):
        written.clear()
        got = sorted((r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
        want = {n: n // 100 * 100 for e in edges for n in e} | ({190: 0} if more else {})
        assert got == sorted(want.items()) and (len(written) > 1) == bool(more)


def test_one_document_of_each_group_stays(spark):
    rows = near_copies() + [(None, "alone in the world without an id", "en", "s", 1), (None, "alone in the world without an id", "en", "s", 1)]
    df = documents(spark, rows)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    want = sorted({str(c) for _, _, c in by_hand(rows) if c is not None} | {"None"})
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


# --- nearest neighbours ------------------------------------------------------------------


def vectors(n, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype("f4")
    return x


def table(spark, x, ids=None):
    rows = [(int(k), [float(v) for v in row], 1, 2) for k, row in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, v int")


def grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    x = vectors(2500)
    x *= np.random.default_rng(1).uniform(0.5, 2, (2500, 1)).astype("f4")  # largest inner product, not angle
    got, want = grouped(ann.search(table(spark, x))), ann.brute_force(x, np.arange(2500))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[k]} & {a for a, _ in want[k]}) / 20 for k in want]) >= 0.95
    for k, near in got.items():
        assert near == sorted(near, key=lambda t: (-t[1], t[0]))
        assert all(abs(s - float(x[k].astype("f8") @ x[i].astype("f8"))) < 1e-12 for i, s in near)


def test_copies_ties_and_unusable_rows(spark):
    x = np.vstack([np.tile(vectors(1, 8), (60, 1)), vectors(30, 8, 3)])
    df = table(spark, x).union(spark.sql("SELECT 1000L, CAST(NULL AS ARRAY<FLOAT>), 1, 2 UNION ALL SELECT 1020, array(0f, 0f), 1, 2 UNION ALL SELECT 1040, array(1f, NULL), 1, 2 "
                                         "UNION ALL SELECT 1060, array(float('nan'), 1f), 1, 2 UNION ALL SELECT 1080, array(float('inf'), 1f), 1, 2 UNION ALL SELECT NULL, array(1f), 1, 2 UNION ALL SELECT 1100, array(1f, 2f, 3f), 1, 2"))
    got = grouped(ann.search(df.union(df)))
    want = ann.brute_force(x, np.arange(90))
    assert 1000 not in got and 1100 not in got and set(got) == set(want)
    for q in (0, 20, 40, 60, 80):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_few_and_no_vectors(spark):
    x = vectors(5, 4)
    assert [len(v) for v in grouped(ann.search(table(spark, x))).values()] == [4]
    assert ann.search(table(spark, x).where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("alpha", [1.0, 1.2])
def test_pruning_keeps_diverse_neighbours(alpha):
    g = ann.Graph(vectors(300), degree=8, beam=32, alpha=alpha)
    assert (g.count <= 8).all() and (g.count > 0).all()
    for k in range(300):
        own = g.edges[k][g.edges[k] >= 0]
        assert k not in own and len(set(own)) == len(own)
