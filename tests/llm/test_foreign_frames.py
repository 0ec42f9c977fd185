"""Frames and files that other writers make: plain encoders with other tables, read back."""

import struct

import numpy as np
import pytest

from tracewell.llm import mjpeg


class Bits:
    def __init__(self):
        self.text = ""

    def number(self, value):
        size = abs(value).bit_length()
        if size:
            self.text += f"{value if value > 0 else value + (1 << size) - 1:0{size}b}"

    def done(self):
        raw = self.text + "1" * (-len(self.text) % 8)
        return int(raw, 2).to_bytes(len(raw) // 8, "big").replace(b"\xff", b"\xff\x00")


def segment(marker, data):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data


def flat_table(place, symbols, length):
    """All codes of one length, in the order of symbols."""
    return segment(0xC4, bytes([place]) + bytes(len(symbols) if k == length else 0 for k in range(1, 17)) + bytes(symbols))


def joined(pieces):
    return b"".join(p + (b"\xff" + bytes([0xD0 + k % 8]) if k + 1 < len(pieces) else b"") for k, p in enumerate(pieces))


def lossless(samples, predictor, interval_rows=0):
    rows, w = samples.shape
    x, pieces = samples.astype(int), []
    step = interval_rows or rows
    for top in range(0, rows, step):
        bits = Bits()
        for y in range(top, min(rows, top + step)):
            for k in range(w):
                if y == top:
                    guess = x[y, k - 1] if k else 128
                elif not k:
                    guess = x[y - 1, 0]
                else:
                    a, b, c = x[y, k - 1], x[y - 1, k], x[y - 1, k - 1]
                    guess = [a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor - 1]
                diff = int(x[y, k] - guess)
                bits.text += f"{abs(diff).bit_length():05b}"
                bits.number(diff)
        pieces.append(bits.done())
    head = b"\xff\xd8" + segment(0xFE, b"by another") + flat_table(0, range(17), 5) + segment(0xC3, struct.pack(">BHHB3B", 8, rows, w, 1, 1, 0x11, 0))
    if interval_rows:
        head += segment(0xDD, struct.pack(">H", interval_rows * w))
    return head + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + joined(pieces) + b"\xff\xd9"


def zigzag():
    """The path from its description: along each diagonal, turning at its end."""
    y = x = 0
    up = True
    for _ in range(64):
        yield y, x
        if up and (x == 7 or y == 0):
            y, x, up = (y + 1, x, False) if x == 7 else (y, x + 1, False)
        elif not up and (y == 7 or x == 0):
            y, x, up = (y, x + 1, True) if y == 7 else (y + 1, x, True)
        else:
            y, x = (y - 1, x + 1) if up else (y + 1, x - 1)


def cosine(block):
    c = np.array([[np.cos((2 * k + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for k in range(8)] for u in range(8)])
    return c @ block @ c.T


def put(bits, block, quant, last):
    z = [int(np.rint(block[y, x] / quant)) for y, x in zigzag()]
    bits.text += f"{abs(z[0] - last).bit_length():04b}"
    bits.number(z[0] - last)
    run = 0
    for k in range(1, 64):
        if not z[k]:
            run += 1
            continue
        while run > 15:
            bits.text, run = bits.text + f"{0xF0:08b}", run - 16
        bits.text += f"{run * 16 + abs(z[k]).bit_length():08b}"
        bits.number(z[k])
        run = 0
    if run:
        bits.text += f"{0:08b}"
    return z[0]


def baseline(samples, quant=1, interval=0, sampling=None):
    """Grey, or with two flat colour parts where sampling (across, down) of the luma is given."""
    rows, w = samples.shape
    h, v = sampling or (1, 1)
    down, across = -(-rows // (8 * v)), -(-w // (8 * h))
    x = np.pad(samples.astype(float), ((0, down * 8 * v - rows), (0, across * 8 * h - w)), mode="edge") - 128
    pieces, bits, last = [], Bits(), 0
    for unit in range(down * across):
        if interval and unit and unit % interval == 0:
            pieces, bits, last = [*pieces, bits.done()], Bits(), 0
        y, c = divmod(unit, across)
        for k in range(h * v):
            top, left = 8 * (y * v + k // h), 8 * (c * h + k % h)
            last = put(bits, cosine(x[top : top + 8, left : left + 8]), quant, last)
        for _ in range(2 if sampling else 0):
            put(bits, np.zeros((8, 8)), quant, 0)
    pieces.append(bits.done())
    parts = [(1, h, v), (2, 1, 1), (3, 1, 1)] if sampling else [(1, 2, 2)]
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([quant] * 64)) + flat_table(0, range(12), 4) + flat_table(16, range(0xFB), 8)
    head += segment(0xC0, struct.pack(">BHHB", 8, rows, w, len(parts)) + b"".join(bytes([i, a << 4 | b, 0]) for i, a, b in parts))
    if interval:
        head += segment(0xDD, struct.pack(">H", interval))
    scan = bytes([len(parts)]) + b"".join(bytes([i, 0]) for i, *_ in parts) + bytes([0, 63, 0])
    return head + segment(0xDA, scan) + joined(pieces) + b"\xff\xd9"


def picture(rows, w, seed=0):
    y, x = np.mgrid[:rows, :w]
    return np.clip(128 + 90 * np.sin(x / 5) * np.cos(y / 7) + np.random.default_rng(seed).normal(0, 12, (rows, w)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_frames_of_any_table_and_predictor(predictor):
    for samples in (picture(13, 21), np.random.default_rng(1).integers(0, 256, (5, 9)).astype(np.uint8), np.full((1, 1), 255, np.uint8)):
        for rows in (0, 2):
            assert (mjpeg.decode_frame(lossless(samples, predictor, rows)) == samples).all()


@pytest.mark.parametrize("size", [(8, 8), (16, 24), (13, 21), (1, 1)])
def test_baseline_frames(size):
    samples = picture(*size)
    for options in ({}, {"interval": 2}, {"sampling": (2, 2)}, {"sampling": (2, 1), "interval": 1}, {"sampling": (1, 1)}):
        got = mjpeg.decode_frame(baseline(samples, **options))
        assert got.shape == size and np.abs(got.astype(int) - samples).max() <= 2
    rough = mjpeg.decode_frame(baseline(samples, quant=16))
    assert np.abs(rough.astype(int) - samples).mean() < 8


def avi_of(frames, absolute):
    header = mjpeg._chunk(b"LIST", b"hdrl" + mjpeg._chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13))) + mjpeg._chunk(b"JUNK", b"x" * 5)
    start = 12 + len(header) + 8
    movi, index = b"movi", b""
    for f in frames:
        index += b"00db" + struct.pack("<III", 16, len(movi) + (start if absolute else 0), len(f))
        movi += mjpeg._chunk(b"00db", f)
    return mjpeg._chunk(b"RIFF", b"AVI " + header + mjpeg._chunk(b"LIST", movi) + mjpeg._chunk(b"idx1", index))


@pytest.mark.parametrize("absolute", [False, True])
def test_files_of_others(absolute):
    dark, light = np.full((16, 16), 20, np.uint8), np.full((16, 16), 220, np.uint8)
    frames, fps = mjpeg.decode_avi(avi_of([baseline(dark), baseline(dark), baseline(light, sampling=(2, 2)), lossless(light, 4)], absolute))
    assert fps == 25 and [(a, b) for a, b, _ in mjpeg.clip_bounds(frames)] == [(0, 2), (2, 4)]


def test_damage_is_a_value_error():
    whole = [baseline(picture(16, 16)), lossless(picture(4, 6), 2), mjpeg.write_avi(bytes(range(64)))[-200:]]
    for frame in whole[:2]:
        for n in range(0, len(frame) - 1):
            with pytest.raises(ValueError):
                mjpeg.decode_frame(frame[:n])
        half = frame[: len(frame) // 2] + b"\xff\xd9"
        with pytest.raises(ValueError):
            mjpeg.decode_frame(half)
    avi = mjpeg.write_avi(bytes(range(256)) * 24)
    for n in (0, 4, 13, 60, 200, len(avi) - 20):
        with pytest.raises(ValueError):
            mjpeg.decode_avi(avi[:n])
    progressive = whole[0].replace(b"\xff\xc0", b"\xff\xc2", 1)
    with pytest.raises(ValueError):
        mjpeg.decode_frame(progressive)
