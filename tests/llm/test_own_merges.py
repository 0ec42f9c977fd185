"""The tree encodes without a tokenizer library; the library only checks it here."""

import random
import sys

import public_tokenizers
import tiktoken

from tracewell.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def codec(leaf=bpe.LEAF, span=bpe.SPAN):
    return bpe.TreeCodec(RANKS, public_tokenizers.PATTERN, leaf, span)


def test_fixed_pattern():
    assert bpe.COMMON == public_tokenizers.PATTERN and not hasattr(bpe, "tiktoken") and "tiktoken" not in open(bpe.__file__).read()


def test_merges_one_by_one_together_and_long():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeinorst éß日") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    c = codec()
    together = c.merge_all(words)
    for w, ids in zip(words, together):
        assert list(ids) == c._merge_long(w)
        assert c._merge(w) == ([RANKS[w]] if w in RANKS else list(ids))


def test_random_texts():
    rng = random.Random(2)
    pieces = ["the", " of", "'", "'s", "'ll", " ", "  ", "\n", "\t ", " ", "1", " 22", "!", "...", " -", "é", "ß", "日本", "😀", "x" * 30, "\u0001", " ", "A"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["", " ", "\n\n", "a\n", "a \n b", "a\n\nb"]
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    for leaf, span in ((1, 2), (3, 4), (16, 32), (bpe.LEAF, bpe.SPAN)):
        assert codec(leaf, span).encode_all(texts) == want, leaf


def test_every_character_class():
    """White space, letters and numbers as the library sees them, over all code points."""
    c = codec(64)
    text = [chr(k) for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    for start in range(0, len(text), 200_000):
        t = "a".join(text[start : start + 200_000 : 7])
        assert c.encode(t) == LIBRARY.encode_ordinary(t)


def test_recurring_matches_outlive_a_full_cache(monkeypatch):
    """Words of every batch are merged once, however many others a batch brings."""
    monkeypatch.setattr(bpe, "CACHE", 300)
    rng, c, merged = random.Random(5), codec(), []
    merge_all = c.merge_all
    c.merge_all = lambda pieces: merged.extend(pieces) or merge_all(pieces)
    words = lambda n: [" " + "".join(rng.choice("bdfghkqxz") for _ in range(9)) for _ in range(n)]
    often = words(100)
    for _ in range(6):
        text = "".join(often + words(150))
        assert c.encode_all([text]) == [LIBRARY.encode_ordinary(text)]
        assert len(c._seen) <= 300 and len(c._old) <= 300
    assert all(merged.count(w.encode()) == 1 for w in often)


def test_halves_that_meet_at_a_hard_boundary_need_no_window():
    c, windows = codec(), []
    plain = c._plain
    c._plain = lambda pieces: windows.append(pieces) or plain(pieces)
    text = "Some words, 12 numbers; and marks! " * 60
    assert c.encode(text) == LIBRARY.encode_ordinary(text)
    assert sum(len("".join(p)) for p in windows) == len(text)
