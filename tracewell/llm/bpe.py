"""Byte-level BPE by a monoid tree: encode halves, join neighbours at the seam.

A text is halved until a part has at most LEAF characters; a leaf is
split by the pattern (by classes of characters or the expression itself) and each match merged by rank, without any tokenizer library.
Matches met before come from a bounded cache of two generations; those new in a batch of texts are merged
together, by arrays, before the trees are built. Halves meet at a hard boundary near the
middle where there is one, so that seams seldom cut a word; such neighbours are simply put together.
Others are joined by encoding a window around the seam anew and
growing it on both sides until the tokens outside provably stay as they are.
Either of two facts proves a side:

* The window ends at a hard boundary, a place where a match of the pattern ends
  whatever stands before or after: a letter before what is no letter, a number
  before what is no number, or anything but white space before white space. What
  lies beyond it then encodes alike with or without the window.
* The window ends inside a match of the pattern, and the token outside and the
  window's outermost token are a stable pair: their joined bytes encode to just
  these two. A sequence whose adjacent pairs are all stable is the encoding of
  its bytes, as no merge of lower rank can cross any of its seams.

The second fact is used where a run without a hard boundary is longer than
SPAN characters, so one endless word costs windows of bounded size, too. Joining
is associative; parts may be encoded anywhere and joined in any bracketing.
Decoding concatenates the tokens' bytes up the same kind of tree.

A null text counts as empty and has no tokens. Special tokens are never made.
Repeated rows, and rows without an id, are encoded alike; an empty table gives an
empty result, and columns besides the id and the text are not read. Very long texts
are encoded whole; equal ranks (ties) merge leftmost first.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, row_type, slices, whole_rows

LEAF, SPAN = 256, 512
#: Matches of up to SHORT characters are kept, CACHE of them in each of two generations a process; the bytes from which merges use a heap.
SHORT, CACHE, HEAP = 32, 100_000, 200
_NONE = 1 << 60


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Code points (first, last) that are letters or numbers only since Unicode versions after the
#: one the rank files' own libraries follow (16); there they are marks, so here, too.
LATER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce,
    0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb,
    0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9),
    (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2,
    0x16ff3), (0x16ff4, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191),
    (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90,
    0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4),
    (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """1 for letters, 2 for numbers, 3 for white space, 0 for all else, by code point."""
    out = np.zeros(0x110000, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for k, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for part, offset in ((low, 0), (high, 0xE000)):
            for m in regex.finditer(pattern, part):
                out[offset + m.start() : offset + m.end()] = k
    for first, last in LATER:
        out[first : last + 1] = 0
    return out


#: The pattern (a fixed value) whose matches piece_starts() finds by classes of characters.
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Hard boundaries inside a text, and where COMMON's matches start in a text without apostrophes.

    A hard boundary is a place where a match ends whatever stands before or after. A
    match starts where a run of letters, numbers or marks does, or one plain space
    earlier; where a run of white space does; and at such a run's last character if
    anything follows.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    c = _classes()[points]
    a, b = c[:-1], c[1:]
    hard = np.flatnonzero(((a == 1) & (b != 1)) | ((a == 2) & (b != 2)) | ((a != 3) & (b == 3))) + 1
    starts = np.zeros(len(c) + 1, bool)
    starts[0] = starts[-1] = True
    run = np.flatnonzero(a != b) + 1
    starts[run[(c[run] == 3) | (points[run - 1] != 32)]] = True
    starts[run[(c[run] != 3) & (c[run - 1] == 3)] - 1] = True
    return hard.tolist(), np.flatnonzero(starts).tolist()


class TreeCodec:
    """Encoder and decoder over one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, span: int = SPAN):
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self._bytes[i] = b
        self._ranks = ranks
        # Tokens of matches as bytes of 32-bit numbers: those met since the last turn, and those of the turn before.
        self._seen: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._names = [str(i) for i in range(len(self._bytes))]
        # Every way to make a token of two others, as sorted keys with the tokens made.
        made = sorted(
            (ranks[b[:k]] << 32 | ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks)
        self._keys = np.array([k for k, _ in made] + [1 << 62], np.int64)
        self._made = np.array([i for _, i in made] + [_NONE], np.int64)
        self._byte_ids = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        self._pattern = regex.compile(pattern)
        self._common = pattern == COMMON
        self._later = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]")
        self._leaf, self._span = max(1, leaf), max(1, span)
        self._stable = functools.lru_cache(maxsize=100_000)(self._stable_pair)

    # -- encoding

    def _stable_pair(self, a: int, b: int) -> bool:
        return self._merge(self._bytes[a] + self._bytes[b]) == [a, b]

    def _merge(self, piece: bytes) -> list[int]:
        """Byte-pair merges of one piece, lowest rank first, leftmost of equals."""
        ranks = self._ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > HEAP:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        pairs = [get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < _NONE:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], _NONE)
        return [ranks[p] for p in parts]

    def _together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens made of pairs, _NONE where there is none."""
        key = a << 32 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._made[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """_merge() of many short pieces at once: each round merges the leftmost lowest pair of every piece."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max(initial=1)) + 1
        ids = np.zeros((len(pieces), width), np.int64)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self._byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        pairs = np.full((len(pieces), width), _NONE)
        pairs[:, :-1][inside[:, 1:]] = self._together(ids[:, :-1][inside[:, 1:]], ids[:, 1:][inside[:, 1:]])
        out, rows, columns = [()] * len(pieces), np.arange(len(pieces)), np.arange(width)
        while len(rows):
            at = pairs.argmin(axis=1)
            k = np.arange(len(rows))
            least = pairs[k, at]
            done = least == _NONE
            if done.any():
                for r, row, n in zip(rows[done].tolist(), ids[done].tolist(), sizes[done].tolist()):
                    out[r] = tuple(row[:n])
                go = ~done
                rows, ids, pairs, sizes, at, least = rows[go], ids[go], pairs[go], sizes[go], at[go], least[go]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            # What stands right of the merged pair moves one place left.
            source = (k * width)[:, None] + np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, pairs = ids.ravel()[source], pairs.ravel()[source]
            ids[k, at] = least
            sizes = sizes - 1
            more = at + 1 < sizes
            pairs[k, at] = _NONE
            pairs[k[more], at[more]] = self._together(least[more], ids[k[more], at[more] + 1])
            some = at > 0
            pairs[k[some], at[some] - 1] = self._together(ids[k[some], at[some] - 1], least[some])
        return out

    def _learn(self, found: set[str]) -> None:
        """Merge the short matches that are not in the cache, all together.

        A full generation becomes the old one. What is met again comes back from there, so
        that words that recur stay and those of a single text go.
        """
        new = found.difference(self._seen)
        if len(self._seen) + len(new) > CACHE and self._seen:
            self._old, self._seen = self._seen, {}
            new = found
        seen, old = self._seen, self._old
        seen.update((p, old[p]) for p in new.intersection(old))
        fresh = sorted((p for p in new.difference(old) if len(p) <= SHORT), key=len)
        for start in range(0, min(len(fresh), CACHE), 4096):
            part = fresh[start : start + 4096]
            raw = [p.encode() for p in part]
            for p, b, ids in zip(part, raw, self.merge_all(raw)):
                # A piece that is a token of its own is that token, whatever its merges give.
                seen[p] = array("i", [self._ranks[b]] if b in self._ranks else ids).tobytes()

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list of parts; a stale pair no longer has its rank."""
        ranks, n = self._ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part by its start: its end, the start before it
        alive = [True] * n + [False]
        pair = lambda i: ranks.get(piece[i : end[end[i]]]) if end[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or pair(i) != rank:
                continue
            alive[end[i]] = False
            end[i] = end[end[i]]
            if end[i] < n:
                before[end[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := pair(j)) is not None:
                    heapq.heappush(heap, (r, j))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def _plain(self, pieces: list[str]) -> list[int]:
        """Tokens of a leaf's or a window's matches, each merged by itself."""
        try:
            raw = b"".join(map(self._seen.__getitem__, pieces))
        except KeyError:  # a long match, one that a window made, or more matches in a batch than the cache holds
            raw = b"".join(map(self._piece, pieces))
        return array("i", raw).tolist()

    def _piece(self, piece: str) -> bytes:
        """Tokens of one match."""
        ids = self._seen.get(piece)
        if ids is None:
            ids = array("i", self._merge(piece.encode())).tobytes()
            if len(piece) <= SHORT and len(self._seen) < CACHE:
                self._seen[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The tokens of each text; the leaves of all texts are split first, so that their new matches are merged together."""
        trees = []
        for text in texts:
            leaves: list[list[str]] = []
            bounds = boundaries(text) if text else ([], [0])
            trees.append((text, bounds, leaves, self._split(text, bounds, 0, len(text), leaves)))
        self._learn(set().union(*[leaf for _, _, leaves, _ in trees for leaf in leaves]))
        return [self._up(text, bounds, leaves, tree)[0] for text, bounds, leaves, tree in trees]

    def _matches(self, text: str, bounds: tuple, start: int, end: int) -> list[str]:
        """The pattern's matches in a part of a text, as if it stood alone."""
        hard, starts = bounds
        part = text[start:end]
        if self._common and "'" not in part and self._is_hard(hard, start, len(text)) and self._is_hard(hard, end, len(text)):
            at = starts[bisect_left(starts, start) : bisect_right(starts, end)]
            return [text[i:j] for i, j in zip(at, at[1:])]
        plain = part if part.isascii() else self._later.sub("\u2020", part)  # any mark
        if plain is part or plain == part:
            return self._pattern.findall(part)
        return [part[m.start() : m.end()] for m in self._pattern.finditer(plain)]

    @staticmethod
    def _is_hard(hard: list[int], at: int, size: int) -> bool:
        k = bisect_left(hard, at)
        return at in (0, size) or (k < len(hard) and hard[k] == at)

    def _split(self, text: str, bounds: tuple, start: int, end: int, leaves: list[list[str]]) -> tuple:
        """(start, end, leaf number) or (start, end, halves)."""
        if end - start <= self._leaf:
            leaves.append(self._matches(text, bounds, start, end))
            return start, end, len(leaves) - 1
        mid, hard = (start + end) // 2, bounds[0]
        k = bisect_left(hard, mid)
        if k < len(hard) and hard[k] < min(end, mid + 16):
            mid = hard[k]
        return start, end, (self._split(text, bounds, start, mid, leaves), self._split(text, bounds, mid, end, leaves))

    def _up(self, text: str, bounds: tuple, leaves: list[list[str]], tree: tuple) -> tuple[list[int], int]:
        """The tokens of a tree and where it ends."""
        start, end, at = tree
        if isinstance(at, int):
            return self._plain(leaves[at]), end
        left, mid = self._up(text, bounds, leaves, at[0])
        right, _ = self._up(text, bounds, leaves, at[1])
        return self._join(text, bounds, start, mid, end, left, right), end

    def _join(self, text: str, bounds: tuple, start: int, mid: int, end: int, left: list[int], right: list[int]) -> list[int]:
        reach, hard = 16, bounds[0]
        if self._is_hard(hard, mid, len(text)):
            # A match ends here whatever stands on either side, so both sides are encoded already.
            return left + right
        while True:
            lo, hi = max(start, mid - reach), min(end, mid + reach)
            # A boundary needs its two characters on one side of the seam, so that side ends alike there.
            k = bisect_left(hard, mid) - 1
            a = hard[k] if k >= 0 and hard[k] >= max(start + 1, lo) else (start if lo == start else None)
            k = bisect_right(hard, mid)
            b = hard[k] if k < len(hard) and hard[k] < hi else (end if hi == end else None)
            if a is not None and b is not None:
                break
            if reach >= self._span and (joined := self._join_inside(text, start, mid, end, left, right)) is not None:
                return joined
            if lo == start and hi == end:
                a, b = start if a is None else a, end if b is None else b
                break
            reach *= 2
        window = self._plain(self._matches(text, bounds, a, b))
        n_left = self._tokens_over(left, len(text[a:mid].encode()), from_end=True)
        n_right = self._tokens_over(right, len(text[mid:b].encode()), from_end=False)
        return left[: len(left) - n_left] + window + right[n_right:]

    def _tokens_over(self, tokens: Sequence[int], n: int, from_end: bool) -> int:
        """How many tokens at an end hold exactly n bytes."""
        k = 0
        while n > 0:
            n -= len(self._bytes[tokens[-1 - k] if from_end else tokens[k]])
            k += 1
        if n:
            raise AssertionError("a hard boundary lies inside a token")
        return k

    def _join_inside(self, text: str, start: int, mid: int, end: int, left: list[int], right: list[int]) -> list[int] | None:
        """Join within one long match of the pattern by stable pairs; None if the seam is not inside one."""
        m0 = max(start, mid - self._span)
        m1 = min(end, mid + self._span)
        run = text[m0:m1]
        if not (self._one_class(run)):
            return None
        k = 4
        while True:
            # The window may not leave the run: its bytes must lie in text[m0:m1].
            take_l, take_r = min(k, len(left)), min(k, len(right))
            raw_l = b"".join(self._bytes[t] for t in left[len(left) - take_l :])
            raw_r = b"".join(self._bytes[t] for t in right[:take_r])
            if len(raw_l) >= len(text[m0:mid].encode()) or len(raw_r) >= len(text[mid:m1].encode()):
                return None
            window = self._merge(raw_l + raw_r)
            out_l, out_r = left[len(left) - take_l - 1], right[take_r]
            if self._stable(out_l, window[0]) and self._stable(window[-1], out_r):
                return left[: len(left) - take_l] + window + right[take_r:]
            k *= 2

    def _one_class(self, run: str) -> bool:
        """Whether every place in run is inside one match: all letters, all numbers, or all other marks.

        An apostrophe could start a contraction, so runs with one are left to whole windows.
        """
        return "'" not in run and not self._later.search(run) and regex.fullmatch(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", run) is not None

    def listed(self, ids: Sequence[int]) -> str:
        """The tokens as decimal numbers, joined by commas."""
        return ",".join(map(self._names.__getitem__, ids))

    # -- decoding

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of the tokens; parts of at most LEAF tokens are concatenated up the tree."""
        parts = [b"".join(map(self._bytes.__getitem__, ids[i : i + self._leaf])) for i in range(0, len(ids), self._leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


_CODECS: dict[tuple[str, str], TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """One codec per worker process, rank file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TreeCodec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_column(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """(id, ids): the token ids of each row's whole text. The rank file must be at ranks_path on every executor."""
    types = {"id": pa.int64(), "ids": pa.list_(pa.int32())}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for part in slices(batch, "text", 1 << 21):
            texts = part.column(1).to_pylist()
            yield batch_of({"id": part.column(0), "ids": c.encode_all([t or "" for t in texts])}, types)

    return map_batches(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], process, "id long, ids array<int>")


def count_tokens(df: DataFrame, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """(row, n_tokens): every row of df as it is, with the number of its text's tokens."""

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for part in slices(batch, "text", 1 << 21):
            n = [len(ids) for ids in c.encode_all([t or "" for t in part.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["row", "n_tokens"])

    return map_batches(df, [whole_rows(df), F.col(text_col).alias("text")], process, f"row {row_type(df)}, n_tokens long")


def token_digest(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, encoded and decoded again."""
    types = {"id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for part in slices(batch, "text", 1 << 21):
            texts, rows = part.column(1).to_pylist(), []
            for key, ids in zip(part.column(0).to_pylist(), c.encode_all([t or "" for t in texts])):
                rows.append((key, len(ids), hashlib.sha256(c.listed(ids).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            yield batch_of(dict(zip(types, list(zip(*rows)) or [[]] * len(types))), types)

    return map_batches(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], process,
                       "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
