"""Baseline JPEG files of 8-bit samples: full chroma, one scan, prefix codes made from each image's own counts."""

from __future__ import annotations

import struct

import numpy as np

from pixelloom.functions.webp import code_lengths

#: Order of the 64 coefficients: along the diagonals, turning at each border.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def quantisers(step: int) -> np.ndarray:
    """Steps that grow with the frequency, in the order of the coefficients' places."""
    y, x = np.divmod(np.arange(64), 8)
    return np.minimum(255, step + (x + y) * step // 4).astype(np.int64)


def _cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def _coefficients(plane: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(blocks, 64) quantised coefficients in zigzag order; borders are repeated to whole blocks."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    c = _cosines()
    found = np.rint((c @ blocks @ c.T).reshape(-1, 64) / q)
    return found.astype(np.int64)[:, ZIGZAG]


def _size(v: int) -> int:
    return abs(v).bit_length()


def _symbols(blocks: np.ndarray) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int, int]]]]:
    """Per block (symbol, bits, value) of its level against the one before, and of its runs of other coefficients."""
    levels, runs = [], []
    before = 0
    for row in blocks.tolist():
        step, before = row[0] - before, row[0]
        n = _size(step)
        levels.append((n, n, step if step >= 0 else step + (1 << n) - 1))
        own, zeros = [], 0
        for v in row[1:]:
            if v == 0:
                zeros += 1
                continue
            while zeros > 15:
                own.append((0xF0, 0, 0))
                zeros -= 16
            n = _size(v)
            own.append((zeros << 4 | n, n, v if v >= 0 else v + (1 << n) - 1))
            zeros = 0
        if zeros:
            own.append((0, 0, 0))
        runs.append(own)
    return levels, runs


def _code(counts: list[int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """Codes of the symbols and the table's bytes; no code is all ones, as one symbol more is counted and left out."""
    lengths = code_lengths([*counts, 1], 16)
    top = max(lengths)
    if lengths[-1] != top:  # the spare symbol gives way only if it has the longest code
        other = max(i for i, n in enumerate(lengths) if n == top)
        lengths[-1], lengths[other] = top, lengths[-1]
    order = sorted((n, s == len(counts), s) for s, n in enumerate(lengths) if n)
    codes, code, before = {}, 0, 0
    for n, spare, s in order:
        code <<= n - before
        if not spare:
            codes[s] = (code, n)
        code, before = code + 1, n
    kept = [(n, s) for n, spare, s in order if not spare]
    return codes, bytes(sum(1 for n, _ in kept if n == i) for i in range(1, 17)) + bytes(s for _, s in kept)


def encode(px: np.ndarray, step: int = 2) -> bytes:
    """A file of a (height, width, channels) image with channels B,G,R (more are ignored) or gray; ``step`` 1 is the finest."""
    px = px.astype(np.float64)
    if px.shape[2] >= 3:
        b, g, r = (px[:, :, i] for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    else:
        planes = [px[:, :, 0]]
    q = quantisers(step)
    parts = [_symbols(_coefficients(p, q)) for p in planes]
    counts = [[0] * 256, [0] * 256]
    for levels, runs in parts:
        for s, _, _ in levels:
            counts[0][s] += 1
        for own in runs:
            for s, _, _ in own:
                counts[1][s] += 1
    if not any(counts[1]):
        counts[1][0] = 1
    (level_codes, level_table), (run_codes, run_table) = _code(counts[0]), _code(counts[1])
    bits: list[tuple[int, int]] = []
    for i in range(len(parts[0][0])):
        for levels, runs in parts:
            s, n, v = levels[i]
            bits += [level_codes[s], (v, n)]
            for s, n, v in runs[i]:
                bits += [run_codes[s], (v, n)]
    value, size = np.array([v for v, _ in bits], dtype=np.int64), np.array([n for _, n in bits], dtype=np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat = (np.repeat(value, size) >> (np.repeat(size, size) - 1 - within) & 1).astype(np.uint8)
    body = np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(mark: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data

    ids = range(1, len(planes) + 1)
    return (
        b"\xff\xd8"
        + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + segment(0xDB, b"\0" + bytes(q[ZIGZAG].tolist()))
        + segment(0xC0, struct.pack(">BHHB", 8, px.shape[0], px.shape[1], len(planes)) + b"".join(bytes([i, 0x11, 0]) for i in ids))
        + segment(0xC4, b"\x00" + level_table)
        + segment(0xC4, b"\x10" + run_table)
        + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i, 0]) for i in ids) + b"\0\x3f\0")
        + body
        + b"\xff\xd9"
    )
