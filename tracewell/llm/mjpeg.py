"""Motion-JPEG video in AVI files as a column: write, index, decode, cut into clips.

The payload's bytes are 8-bit grey samples in rows of WIDTH. Every FRAME_ROWS rows
form one intra frame, a lossless JPEG (process 14, SOF3, predictor 1: the sample
to the left; the first column takes the sample above, the first sample of a frame
128). The last frame has as many rows as remain. The frame's own Huffman table
gives category s a code of 9 - s bits (category 0 one of 9), so each difference
with its s extra bits takes 9 bits in all, so that frames with this table are packed
and unpacked by whole arrays.

Frames written by others are read code by code: 8-bit lossless frames of one component
with any Huffman table and predictor, and baseline frames, grey or (by their luma) in
colour, with any tables of their own, any sampling of the colours and restart marks. A
frame that leaves its tables out, or holds several scans, raises ValueError.

The file is RIFF/AVI: hdrl with avih, strh and strf, movi with one 00dc chunk per
frame, and idx1, by which frames are found again. Files of others may count idx1 from
the start of the file and call their chunks 00db.

Shots: histograms of BINS levels of neighbouring frames are compared (half the sum
of absolute differences of shares, 0 to 1). A cut stands where the difference is
over FLOOR and over mean + SPREAD deviations of the differences since the last
cut (the first difference after a cut has only FLOOR to pass).

A null payload counts as empty; an empty one is stored as 64 zero bytes. Equal
payloads give equal files and clips, so repeated rows give equal rows; an empty
table gives an empty result, and columns besides the id and the text are not read. A
very long text is stored whole. Damaged files raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, slices

WIDTH, FRAME_ROWS, FPS = 64, 32, 25
BINS, FLOOR, SPREAD = 32, 0.2, 2.0
_WORD = 9

# --- the lossless JPEG coder -------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bits of each difference -255..255, the difference of each 9-bit word, and the DHT segment."""
    word = np.zeros(511, np.int64)
    back = np.zeros(512, np.int16)
    for diff in range(-255, 256):
        size = int(abs(diff)).bit_length()
        # Codes by length: size 8 has "0", size 7 "10", ... size 1 seven ones and a zero, size 0 eight ones and a zero.
        length = _WORD - size
        code = (1 << length) - 2
        extra = diff if diff > 0 else diff + (1 << size) - 1
        w = (code << size) | (extra if size else 0)
        word[diff + 255] = w
        back[w] = diff
    bits = ((word[:, None] >> np.arange(_WORD - 1, -1, -1)) & 1).astype(np.uint8)
    counts = bytes([1] * 9 + [0] * 7)
    symbols = bytes(range(8, -1, -1))
    return bits, back, b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + counts + symbols


_BITS, _BACK, _DHT = _tables()
_PLACES = (1 << np.arange(_WORD - 1, -1, -1)).astype(np.int16)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


def _scan_bytes(samples: np.ndarray) -> np.ndarray:
    """Packed scan data of all frames; each full frame has the same number of bytes."""
    rows = samples.astype(np.int16)
    diff = np.empty_like(rows)
    diff[:, 1:] = rows[:, 1:] - rows[:, :-1]
    diff[1:, 0] = rows[1:, 0] - rows[:-1, 0]
    diff[::FRAME_ROWS, 0] = rows[::FRAME_ROWS, 0] - 128
    return np.packbits(_BITS[diff.ravel() + 255].ravel())


def _jpeg(scan: bytes, rows: int) -> bytes:
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, rows, WIDTH, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _DHT + sof + _SOS + scan.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


# --- frames of any writer ----------------------------------------------------


@dataclass
class _Frame:
    """What the markers before a frame's samples say, and the samples' bytes between restart marks."""

    kind: int = 0
    rows: int = 0
    width: int = 0
    parts: list = field(default_factory=list)  # (id, across, down, quantisation table)
    huffman: dict = field(default_factory=dict)  # by class * 16 + place
    own_table: bool = True
    quantisers: dict = field(default_factory=dict)
    interval: int = 0
    tables: list = field(default_factory=list)  # (DC, AC) places of each part
    predictor: int = 0
    scan: bytes = b""


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits, the length of the code they begin with, times 256, plus its symbol; 0 where no code fits."""
    found, at, start = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            end = start + (1 << (16 - length))
            found[start:end] = length << 8 | symbol
            start = end
        at += n
    return found.tolist()


def _read_markers(jpeg: bytes) -> _Frame:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    f, at = _Frame(), 2
    while True:
        marker, size = struct.unpack_from(">HH", jpeg, at)
        data = jpeg[at + 4 : at + 2 + size]
        if marker >> 8 != 0xFF or len(data) != size - 2:
            raise ValueError("damaged JPEG frame")
        if marker in (0xFFC0, 0xFFC1, 0xFFC3):
            precision, f.rows, f.width, parts = struct.unpack_from(">BHHB", data)
            if precision != 8 or not f.rows or not f.width:
                raise ValueError("only frames of 8-bit samples and stated size are read")
            f.kind = marker
            f.parts = [(data[k], data[k + 1] >> 4, data[k + 1] & 15, data[k + 2]) for k in range(6, 6 + 3 * parts, 3)]
        elif 0xFFC0 <= marker <= 0xFFCF and marker not in (0xFFC4, 0xFFC8, 0xFFCC):
            raise ValueError("only baseline and lossless frames with Huffman codes are read")
        elif marker == 0xFFC4:
            f.own_table = f.own_table and jpeg[at : at + 2 + size] == _DHT
            k = 0
            while k < len(data):
                n = sum(data[k + 1 : k + 17])
                f.huffman[data[k]] = (data[k + 1 : k + 17], data[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xFFDB:
            k = 0
            while k < len(data):
                wide, place = data[k] >> 4, data[k] & 15
                f.quantisers[place] = np.frombuffer(data, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                k += 129 if wide else 65
        elif marker == 0xFFDD:
            (f.interval,) = struct.unpack(">H", data)
        at += 2 + size
        if marker == 0xFFDA:
            break
    if not f.parts or data[0] != len(f.parts):
        raise ValueError("only frames of one scan are read")
    places = {data[k]: divmod(data[k + 1], 16) for k in range(1, 1 + 2 * data[0], 2)}
    f.tables = [places[p[0]] for p in f.parts]
    f.predictor = data[1 + 2 * data[0]]
    f.scan = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    return f


class _Codes:
    """Reads codes and numbers from a scan's bytes."""

    def __init__(self, scan: bytes):
        self.data, self.at, self.end = scan.replace(b"\xff\x00", b"\xff") + b"\0\0\0", 0, 0
        self.end = 8 * (len(self.data) - 3)

    def _next(self) -> int:
        if self.at >= self.end:
            raise ValueError("a scan ends early")
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: list[int]) -> int:
        got = table[self._next()]
        if not got:
            raise ValueError("a scan holds an unknown code")
        self.at += got >> 8
        return got & 255

    def number(self, size: int) -> int:
        """A number of so many bits; those that begin with 0 are negative."""
        if not size:
            return 0
        value = self._next() >> (16 - size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def _table(f: _Frame, place: int) -> list[int]:
    if place not in f.huffman:
        raise ValueError("a Huffman table is missing")
    return _lookup(*f.huffman[place])


def _restarts(f: _Frame, units: int) -> Iterator[tuple[_Codes, range]]:
    """The codes between restart marks and the units that they hold."""
    interval = f.interval or units
    pieces = re.split(rb"\xff[\xd0-\xd7]", f.scan)
    if len(pieces) < -(-units // interval):
        raise ValueError("a scan ends early")
    for k in range(-(-units // interval)):
        yield _Codes(pieces[k]), range(k * interval, min(units, (k + 1) * interval))


def _lossless(f: _Frame) -> np.ndarray:
    if len(f.parts) != 1 or f.interval % f.width:
        raise ValueError("only lossless frames of one component, restarted at rows, are read")
    guess = {1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + (b - c >> 1),
             6: lambda a, b, c: b + (a - c >> 1), 7: lambda a, b, c: a + b >> 1}.get(f.predictor)
    if guess is None:
        raise ValueError("unknown predictor")
    table, w = _table(f, f.tables[0][0]), f.width
    out = [0] * (f.rows * w)
    for codes, units in _restarts(f, f.rows * w):
        for k in units:
            first, x = k < units.start + w, k % w
            if k == units.start:
                value = 128
            elif first:
                value = out[k - 1]
            elif not x:
                value = out[k - w]
            else:
                value = guess(out[k - 1], out[k - w], out[k - w - 1])
            size = codes.symbol(table)
            out[k] = (value + (32768 if size == 16 else codes.number(size))) & 0xFFFF
    return (np.array(out, np.int64) & 255).astype(np.uint8).reshape(f.rows, w)


#: Place in a block of 8 x 8 of each coefficient, along the diagonals in turns.
_DIAGONAL = [8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[sum(p) % 2 == 0]))]
_COSINES = np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16) / 2
_COSINES[0] /= np.sqrt(2)


def _block(codes: _Codes, dc: list[int], ac: list[int], last: int) -> list[int]:
    out = [0] * 64
    out[0] = last + codes.number(codes.symbol(dc))
    k = 1
    while k < 64:
        run, size = divmod(codes.symbol(ac), 16)
        if not size and run < 15:
            break
        k += run
        if k > 63:
            raise ValueError("a block is too long")
        out[k] = codes.number(size)
        k += 1
    return out


def _baseline(f: _Frame) -> np.ndarray:
    shapes = [(1, 1)] if len(f.parts) == 1 else [p[1:3] for p in f.parts]
    wide, high = shapes[0]
    if shapes[0] != (max(h for h, _ in shapes), max(v for _, v in shapes)) or not wide or not high or f.parts[0][3] not in f.quantisers:
        raise ValueError("the luma is coarser than the frame, or its quantisation table is missing")
    tables = [(_table(f, dc), _table(f, 16 + ac)) for dc, ac in f.tables]
    across, down = -(-f.width // (8 * wide)), -(-f.rows // (8 * high))
    luma = np.zeros((down * high, across * wide, 64))
    for codes, units in _restarts(f, across * down):
        last = [0] * len(shapes)
        for unit in units:
            y, x = divmod(unit, across)
            for c, (h, v) in enumerate(shapes):
                for k in range(h * v):
                    block = _block(codes, *tables[c], last[c])
                    last[c] = block[0]
                    if c == 0:
                        luma[y * v + k // h, x * h + k % h] = block
    levels = np.zeros_like(luma)
    levels[..., _DIAGONAL] = luma * f.quantisers[f.parts[0][3]]
    samples = _COSINES.T @ levels.reshape(*luma.shape[:2], 8, 8) @ _COSINES + 128
    plane = samples.transpose(0, 2, 1, 3).reshape(8 * luma.shape[0], 8 * luma.shape[1])
    return np.clip(np.rint(plane), 0, 255).astype(np.uint8)[: f.rows, : f.width]


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Samples (rows, width) of one frame, by its own markers; of a frame in colour, its luma."""
    try:
        f = _read_markers(jpeg)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError("damaged JPEG frame") from e
    if f.kind != 0xFFC3:
        return _baseline(f)
    if not f.own_table or not f.huffman or f.predictor != 1 or f.interval or len(f.parts) != 1 or f.tables != [(0, 0)]:
        return _lossless(f)
    n = f.rows * f.width
    scan = np.frombuffer(f.scan.replace(b"\xff\x00", b"\xff"), np.uint8)
    if 8 * len(scan) < n * _WORD:
        raise ValueError("a scan ends early")
    bits = np.unpackbits(scan, count=n * _WORD).reshape(n, _WORD)
    diff = _BACK[bits @ _PLACES].reshape(f.rows, f.width).astype(np.int64)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return (np.cumsum(diff, axis=1) & 255).astype(np.uint8)


# --- the container -----------------------------------------------------------


def _chunk(tag: bytes, data: bytes) -> bytes:
    return tag + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of payload, whose length is a positive multiple of WIDTH."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packed = _scan_bytes(samples).tobytes()
    row_bytes = WIDTH * _WORD // 8
    frames = []
    for start in range(0, len(samples), FRAME_ROWS):
        rows = min(FRAME_ROWS, len(samples) - start)
        frames.append(_jpeg(packed[start * row_bytes : (start + rows) * row_bytes], rows))
    height, most = min(FRAME_ROWS, len(samples)), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 24, b"MJPG", WIDTH * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        movi.append(chunk)
        at += len(chunk)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_index(avi: bytes) -> tuple[list[tuple[int, int]], float]:
    """(offset, size) of each frame's JPEG by idx1, and frames a second."""
    try:
        return _read_index(avi)
    except (struct.error, ZeroDivisionError) as e:
        raise ValueError("damaged AVI file") from e


def _read_index(avi: bytes) -> tuple[list[tuple[int, int]], float]:
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, fps = None, None, float(FPS)
    at, end = 12, 8 + struct.unpack_from("<I", avi, 4)[0]
    while at + 8 <= end:
        tag, (size,) = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)
        if tag == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif tag == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / struct.unpack_from("<I", avi, at + 20)[0]
        elif tag == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("movi or idx1 is missing")
    entries = [struct.unpack_from("<4sIII", avi, k) for k in range(index[0], index[0] + index[1], 16)]
    # Offsets count from the list's name, or in some files from the start of the file.
    base = movi if not entries or avi[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
    found = [(base + offset + 8, size) for tag, _, offset, size in entries if tag in (b"00dc", b"00db")]
    if any(at + size > len(avi) for at, size in found):
        raise ValueError("a frame lies outside the file")
    return found, fps


def decode_avi(avi: bytes) -> tuple[list[np.ndarray], float]:
    found, fps = read_index(avi)
    return [decode_frame(avi[at : at + size]) for at, size in found], fps


# --- shots -------------------------------------------------------------------


def clip_bounds(frames: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, difference at its start) of each clip."""
    shares = [np.bincount(f.ravel() >> 3, minlength=BINS) / f.size for f in frames]
    starts, strength, seen = [0], [0.0], []
    for k in range(1, len(frames)):
        d = float(np.abs(shares[k] - shares[k - 1]).sum() / 2)
        limit = max(FLOOR, np.mean(seen) + SPREAD * np.std(seen)) if seen else FLOOR
        if d > limit:
            starts.append(k)
            strength.append(d)
            seen = []
        else:
            seen.append(d)
    return list(zip(starts, [*starts[1:], len(frames)], strength))


# --- Spark -------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))


def store_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): the text of each row as an AVI file."""
    types = {"id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", 1 << 24):
            made = [payload_of(t) for t in part.column(1).to_pylist()]
            yield batch_of({"id": part.column(0), "n_bytes": [n for n, _ in made], "media": [write_avi(p) for _, p in made]}, types)

    return map_batches(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], process, "id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """One timed row per clip of each file of store_media(): id, clip, frames, seconds, strength of its cut."""
    types = {"id": pa.int64(), "clip": pa.int32(), "first_frame": pa.int32(), "end_frame": pa.int32(),
             "start_s": pa.float64(), "end_s": pa.float64(), "cut": pa.float64()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, avi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if avi is None:
                continue
            frames, fps = decode_avi(avi)
            rows += [(key, k, a, b, a / fps, b / fps, d) for k, (a, b, d) in enumerate(clip_bounds(frames))]
        yield batch_of(dict(zip(types, list(zip(*rows)) or [[]] * len(types))), types)

    return map_batches(media, ["id", "media"], process, "id long, clip int, first_frame int, end_frame int, start_s double, end_s double, cut double")


def media_digest(media: DataFrame) -> DataFrame:
    """What reading each stored file back gives: sizes, hashes and its clips as one string.

    feature is "frames@fps" and the clips' frames, as in "7@25:0-3,3-7".
    """
    types = {"id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
             "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, n, avi in zip(*(batch.column(k).to_pylist() for k in range(3))):
            frames, fps = decode_avi(avi)
            payload = b"".join(f.tobytes() for f in frames)
            shots = ",".join(f"{a}-{b}" for a, b, _ in clip_bounds(frames))
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                         len(avi), hashlib.sha256(avi).hexdigest(), f"{len(frames)}@{fps:g}:{shots}"))
        yield batch_of(dict(zip(types, list(zip(*rows)) or [[]] * len(types))), types)

    return map_batches(media, ["id", "n_bytes", "media"], process,
                       "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
