"""The joint choice of sizes against every possible packing, and sequences built from a plan."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.docs import AWKWARD, documents
from tests.llm.test_simple_operators import check_plan
from tracewell.llm import bpe, packing
from tracewell.llm.queries import BYTE_CAPACITIES


def partitions(items):
    if not items:
        yield []
        return
    head, rest = items[0], items[1:]
    for p in partitions(rest):
        yield [[head], *p]
        for k in range(len(p)):
            yield [*p[:k], [head, *p[k]], *p[k + 1 :]]


def least_cost(items, capacities):
    best = None
    for p in partitions(items):
        if all(sum(b) <= capacities[-1] for b in p):
            c = sum(packing.cost(min(s for s in capacities if s >= sum(b))) for b in p)
            best = c if best is None or c < best else best
    return best


def test_joint_choice_is_near_the_best_packing():
    rng, ratios = random.Random(4), []
    for _ in range(120):
        capacities = (512, 1024, 2048)
        items = [rng.choice((100, 256, 400, 512, 700, 1024, 1500, 2048)) for _ in range(rng.randint(1, 7))]
        bins = check_plan({l: items.count(l) for l in set(items)}, capacities)
        ratios.append(sum(packing.cost(c) for c, _ in bins.values()) / least_cost(items, capacities))
    assert min(ratios) >= 1 - 1e-12 and max(ratios) <= 1.5 and sum(ratios) / len(ratios) <= 1.1


def test_several_sizes_beat_one():
    rng = random.Random(5)
    items = {rng.randint(1, 2048): rng.randint(1, 30) for _ in range(60)}
    total = lambda sizes: sum(packing.cost(c) for c, _ in check_plan(items, sizes).values())
    assert total((512, 1024, 2048)) < total((2048,))


def test_byte_sequences_can_be_built(spark):
    d = documents(spark, [r for r in AWKWARD if r[0] is not None and r[0] != 8])
    packed = packing.pack(d, length=F.octet_length("text"), capacities=BYTE_CAPACITIES)
    units = d.select("doc_id", F.col("text").cast("binary").alias("units"))
    built = packing.sequences(packed, units).collect()
    want = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    assert sorted(map(len, (r.units for r in built))) == sorted(r.bin_used for r in packed.select("bin_id", "bin_used").where("bin_id is not null").distinct().collect())
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for key, text in want.items():
        assert b"".join(text[s : s + n] for s, n in sorted(pieces[key])) == text
    assert sum(map(len, want.values())) == sum(len(r.units) for r in built) and all(len(r.units) <= r.capacity for r in built)


def test_pipeline_packs_true_tokens(spark):
    import corpus_pipeline

    d = documents(spark)
    got = dict(corpus_pipeline.STAGES)["packing"](spark, d, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    c = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for key, text, *_ in AWKWARD:
        want[key] = want.get(key, 0) + len(c.encode(text or ""))
    assert {r.doc_id: r.n for r in got} == want


def test_a_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "_BUCKET_ROWS", 7)
    d = documents(spark, [(k // 2, "x" * 40, "en", "s", 1) for k in range(200)])
    got = packing.pack(d, capacities=(16, 32)).collect()
    used = {}
    for r in got:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.length
    assert len(got) == 200 and all(used[r.bin_id] == r.bin_used <= r.capacity for r in got)
