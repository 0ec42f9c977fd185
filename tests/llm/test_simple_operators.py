import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.docs import AWKWARD, documents
from tracewell.llm import bpe, mjpeg, packing, url_filter
from tracewell.llm.queries import PAGE_RULES

# --- URL filter ----------------------------------------------------------------


def judge(spark, *urls):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df, "page_id", "url", url_filter.UrlPolicy(rules=PAGE_RULES)).orderBy("id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in got]


def test_url_rules(spark):
    assert judge(spark, "http://A.net/x", "https://m.example.net/en/1?q", "http://example.net/fr/", "http://notnet/x", "http://example.com/de/9", "http://x.org/fr/", "http://net", None, "net/", "://net/#x") == [
        ("a.net", "/x", "net/", "block"), ("m.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"),
        ("notnet", "/x", None, "allow"), ("example.com", "/de/9", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"),
        ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/", "net/", "block")]


def test_url_vocabulary(spark):
    got = judge(spark, "http://a.com/porn/x", "http://a.com/pornography", "http://a.com/free-casino", "http://a.com/free/free", "http://a.com/XXX", "")
    assert [v for *_, v in got] == ["block", "allow", "block", "allow", "block", "allow"]


def test_url_empty_table(spark):
    assert judge(spark) == []


# --- media -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [64, 128, 64 * 32, 64 * 33, 64 * 100])
def test_avi_round_trip(n):
    for payload in (os.urandom(n), b"\xff" * n, bytes(n)):
        frames, fps = mjpeg.decode_avi(mjpeg.write_avi(payload))
        assert b"".join(f.tobytes() for f in frames) == payload and fps == 25


def test_avi_index_and_damage():
    avi = mjpeg.write_avi(bytes(range(256)) * 24)
    found, _ = mjpeg.read_index(avi)
    assert len(found) == 3 and all(avi[a : a + 2] == b"\xff\xd8" for a, _ in found)
    with pytest.raises(ValueError):
        mjpeg.read_index(b"RIFFxxxxWAVE")


def test_shots():
    dark, light = np.zeros((32, 64), np.uint8), np.full((32, 64), 200, np.uint8)
    assert [(a, b) for a, b, _ in mjpeg.clip_bounds([dark] * 3 + [light] * 2 + [dark])] == [(0, 3), (3, 5), (5, 6)]


def test_media_of_awkward_rows(spark):
    media = mjpeg.store_media(documents(spark), "doc_id", "text")
    got = {r.id: r for r in mjpeg.media_digest(media).collect()}
    assert mjpeg.media_digest(media).count() == len(AWKWARD)
    for key, text, *_ in AWKWARD:
        raw = (text or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[key]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256
    rows = mjpeg.clips(media).where("id = 6").orderBy("clip").collect()
    assert rows[0].start_s == 0 and rows[-1].end_frame * 0.04 == pytest.approx(rows[-1].end_s)
    assert mjpeg.media_digest(mjpeg.store_media(documents(spark, []), "doc_id", "text")).count() == 0


# --- byte-level BPE -----------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", "th", "the ", " ", "  ", "\n", "\r\n", "1", "23", "é", "ß", "'s", "'", "'ll", "ing", " un", "!", "...", "日本", "😀", " ", "á", "x" * 40, "9" * 30, "-" * 50, " " * 20]


@pytest.fixture(scope="module")
def reference_encoder():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("leaf, span", [(1, 2), (2, 4), (8, 16), (1024, 512)])
def test_tree_equals_the_library(reference_encoder, leaf, span):
    rng = random.Random(leaf)
    c = bpe.TreeCodec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, leaf, span)
    for _ in range(800):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))
        ids = c.encode(t)
        assert ids == reference_encoder.encode_ordinary(t) and c.decode(ids) == t.encode()


@pytest.mark.parametrize("t", ["a" * 5000, "ab" * 4000, "x1" * 3000, "é" * 4000, "!" * 5000, " " * 5000, "'s" * 3000, "1234567890" * 900, "abc'" * 2000])
def test_endless_words(reference_encoder, t):
    c = bpe.TreeCodec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    assert c.encode(t) == reference_encoder.encode_ordinary(t)


def test_tokens_of_awkward_rows(spark, reference_encoder):
    got = {r.id: r for r in bpe.token_digest(documents(spark), "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()}
    for key, text, *_ in AWKWARD:
        ids = reference_encoder.encode_ordinary(text or "")
        assert got[key].n_tokens == len(ids) and got[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    ids = bpe.encode_column(documents(spark), "doc_id", "text", RANKS, public_tokenizers.PATTERN).where("id = 8").first().ids
    assert list(ids) == reference_encoder.encode_ordinary(AWKWARD[7][1])


# --- packing --------------------------------------------------------------------------


def check_plan(histogram, capacities):
    rules, bins = packing.plan(histogram, capacities)
    content, seen = {}, {}
    for length, lo, hi, first, per_bin in rules:
        for rank in range(lo, hi):
            seen.setdefault(length, set()).add(rank)
            b = first + (rank - lo) // per_bin
            content[b] = content.get(b, 0) + length
    assert {k: len(v) for k, v in seen.items()} == {k: v for k, v in histogram.items() if v}
    assert all(v == set(range(len(v))) for v in seen.values())
    capacity = {b: (c, used) for first, end, c, used in bins for b in range(first, end)}
    assert {b: u for b, (_, u) in capacity.items()} == content
    assert all(c == min(x for x in capacities if x >= content[b]) for b, (c, _) in capacity.items())
    return capacity


def test_plans_hold_every_item_once():
    rng = random.Random(5)
    for _ in range(150):
        capacities = tuple(sorted(rng.sample(range(4, 40), 3)))
        check_plan({rng.randint(1, capacities[-1]): rng.randint(0, 40) for _ in range(rng.randint(0, 10))}, capacities)


def test_plan_is_best_fit_of_single_items():
    """With one capacity the plan opens as many bins as item-by-item best-fit decreasing."""
    rng = random.Random(6)
    for _ in range(100):
        histogram = {rng.randint(1, 30): rng.randint(1, 12) for _ in range(8)}
        rooms = []
        for length in sorted((l for l, n in histogram.items() for _ in range(n)), reverse=True):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((30 if fit is None else fit) - length)
        assert len(check_plan(histogram, (30,))) == len(rooms)


def test_packing_of_rows(spark):
    rows = [(k, "x" * (4 * n), "en", "s", 1) for k, n in enumerate([0, 1, 5, 7, 7, 7, 8, 9, 16, 17, 40])] + AWKWARD
    got = packing.pack(documents(spark, rows), capacities=(8, 16)).collect()
    by_bin = {}
    for r in got:
        if r.length:
            by_bin.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.length for r in b) == b[0].bin_used <= b[0].capacity for b in by_bin.values())
    need = sum(-(-len((t or "").encode()) // 4) for _, t, *_ in rows)
    assert sum(r.length for r in got) == need and sum(r.length == 0 and r.bin_id is None for r in got) == 1 + 2
    assert packing.pack(documents(spark, [])).count() == 0
