"""Lossless WebP (VP8L): the decoder covers the whole format, the writer stores single-channel images.

Reading: prefix codes (simple and normal), groups of codes chosen by a meta image, back references, the colour cache,
and the predictor, cross-colour, subtract-green and palette transforms.  ``decode`` reads one file of any kind;
``decode_many`` reads many at once: each is a lane, and all lanes take one symbol a step in numpy.  Lanes take prefix
codes of any shape and references; files with a colour cache or a meta image are read one by one.

Writing: ``encode_gray`` stores samples of eight bits as green, from which the subtract-green transform makes gray.  Where few
values occur a palette bundles several pixels in one; repeated stretches become back references; lengths of the prefix
codes follow the counts of each image.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Longest code that the writer makes; the format allows 15.
MOST_BITS = 11
#: Shortest reference that pays, and the longest that the format has.
LEAST_COPY, MOST_COPY = 6, 4096


class Bits:
    """Reads and writes numbers from the lowest bit on."""

    def __init__(self, data: bytes = b""):
        self.data, self.at = data, 0
        self.value = self.size = 0

    def read(self, n: int) -> int:
        first, shift = divmod(self.at, 8)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too soon")
        return int.from_bytes(self.data[first : (self.at + 7) // 8], "little") >> shift & (1 << n) - 1

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


#: For codes of up to n bits: the number whose n bits are the index's in the other order.
_FLIPPED = [np.zeros(1, dtype=np.int64)]
for _n in range(1, 16):
    _FLIPPED.append(np.concatenate([_FLIPPED[-1] * 2, _FLIPPED[-1] * 2 + 1]))
_FLIPPED_LIST = [x.tolist() for x in _FLIPPED]


class Prefix:
    """A canonical prefix code as a table over its longest code: symbol and length; one symbol alone takes no bits."""

    def __init__(self, lengths: list[int]):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.only = used[0][1] if len(used) == 1 else 0 if not used else None
        if self.only is not None:
            self.bits, self.plain = 0, [self.only << 4]
            return
        self.bits = top = used[-1][0]
        ordered: list[int] = []
        for n, s in used:
            ordered += [s << 4 | n] * (1 << top - n)
        if len(ordered) != 1 << top:
            raise ValueError("the code is not complete")
        self.plain = [ordered[i] for i in _FLIPPED_LIST[top]]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        first, shift = divmod(bits.at, 8)
        found = self.plain[int.from_bytes(bits.data[first : first + 3], "little") >> shift & (1 << self.bits) - 1]
        bits.at += found & 15
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends too soon")
        return found >> 4


def _prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = [0] * size
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = Prefix(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, last = [], 8
    table, mask = code.plain, (1 << code.bits) - 1
    # some bytes at a time as one number, which is quicker than number by number
    first, at = bits.at >> 3, bits.at & 7
    part = int.from_bytes(bits.data[first : first + 64], "little")
    while len(lengths) < size and left > 0:
        left -= 1
        if at > 480:
            first, at = first + (at >> 3), at & 7
            part = int.from_bytes(bits.data[first : first + 64], "little")
        found = table[part >> at & mask]
        at += found & 15
        symbol = found >> 4
        if symbol < 16:
            lengths.append(symbol)
            last = symbol or last
            continue
        if symbol == 16:
            n, value = 3 + (part >> at & 3), last
            at += 2
        elif symbol == 17:
            n, value = 3 + (part >> at & 7), 0
            at += 3
        else:
            n, value = 11 + (part >> at & 127), 0
            at += 7
        lengths += [value] * n
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    bits.at = 8 * first + at
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends too soon")
    return Prefix(lengths)


def _extended(symbol: int, bits: Bits) -> int:
    """Length or distance of a back reference: short ones as they are, long ones with extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


@dataclass
class Coded:
    """An entropy-coded image whose codes have been read and whose pixels have not."""

    bits: Bits
    width: int
    height: int
    cache_bits: int
    meta: np.ndarray | None
    shift: int
    codes: list[list[Prefix]]


def _coded(bits: Bits, width: int, height: int, main: bool) -> Coded:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, meta, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = width + (1 << shift) - 1 >> shift
        meta = (_pixels(_coded(bits, across, height + (1 << shift) - 1 >> shift, False)) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    return Coded(bits, width, height, cache_bits, meta, shift, [[_prefix(bits, n) for n in sizes] for _ in range(groups)])


def _distance(near: int, width: int) -> int:
    if near > len(NEAR):
        return near - len(NEAR)
    dx, dy = NEAR[near - 1]
    return max(1, dx + dy * width)


def _pixels(image: Coded) -> np.ndarray:
    """The image as packed A,R,G,B integers, pixel by pixel."""
    bits, width, codes, meta, cache_bits = image.bits, image.width, image.codes, image.meta, image.cache_bits
    total = width * image.height
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    kept = at = 0
    while at < total:
        group = codes[0] if meta is None else codes[int(meta[at // width >> image.shift, at % width >> image.shift])]
        symbol = group[0].read(bits)
        if symbol < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = a << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < 280:
            length, near = _extended(symbol - 256, bits), _extended(group[4].read(bits), bits)
            distance = _distance(near, width)
            if distance > at or at + length > total:
                raise ValueError("a reference outside the image")
            for _ in range(length):
                out[at] = out[at - distance]
                at += 1
        else:
            out[at] = cache[symbol - 280]
            at += 1
        while cache_bits and kept < at:
            cache[(CACHE_MULTIPLIER * out[kept] & 0xFFFFFFFF) >> 32 - cache_bits] = out[kept]
            kept += 1
    return np.array(out, dtype=np.uint32)


#: Steps that lanes with a reference wait at most, and bytes behind the streams that lanes may read into between two checks.
WAIT, SPARE = 4, 512
_EXTRA = np.array([0 if s < 4 else s - 2 >> 1 for s in range(40)], dtype=np.int64)
_BASE = np.array([s + 1 if s < 4 else (2 + (s & 1) << (s - 2 >> 1)) + 1 for s in range(40)], dtype=np.int64)
_DX, _DY = (np.array([n[i] for n in NEAR], dtype=np.int64) for i in (0, 1))


def _lanes(images: list[Coded]) -> list[np.ndarray]:
    """The pixels of many images without cache and meta image: every lane takes one symbol a step."""
    data, start = [], 0
    at_bit = np.zeros(len(images), np.int64)
    for i, image in enumerate(images):
        at_bit[i] = 8 * start + image.bits.at
        data.append(image.bits.data)
        start += len(image.bits.data)
    raw = np.frombuffer(b"".join([*data, bytes(2 * SPARE)]), dtype=np.uint8)
    words = raw.astype(np.uint64)
    for n in (1, 2, 4):
        words = words[:-n] | words[n:] << np.uint64(8 * n)
    most_bit = np.cumsum([8 * len(d) for d in data])
    tables, begin, mask = [], np.zeros((5, len(images)), np.int64), np.zeros((5, len(images)), np.int64)
    size = 0
    for i, image in enumerate(images):
        for c, code in enumerate(image.codes[0]):
            begin[c, i], mask[c, i] = size, (1 << code.bits) - 1
            tables += code.plain
            size += len(code.plain)
    table = np.array(tables, dtype=np.int32)
    del tables
    total = np.array([i.width * i.height for i in images], np.int64)
    width = np.array([i.width for i in images], np.int64)
    base = np.cumsum(total) - total
    gray = bool((mask[1:4] == 0).all())  # red, blue and alpha of one value each
    out = np.zeros(int(total.sum()), dtype=np.uint32)
    constant = (table[begin[3]].astype(np.int64) >> 4) << 24 | (table[begin[1]] >> 4) << 16 | table[begin[2]] >> 4
    copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = base.copy()
    end = base + total
    live = np.nonzero(total > 0)[0]

    def look(lanes: np.ndarray, code: int, bit: np.ndarray) -> np.ndarray:
        peek = (words[bit >> 3] >> (bit & 7).astype(np.uint64)).view(np.int64)
        return table[begin[code, lanes] + (peek & mask[code, lanes])]

    def extended(bit: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        peek = (words[bit >> 3] >> (bit & 7).astype(np.uint64)).view(np.int64)
        return _BASE[symbol] + (peek & (1 << _EXTRA[symbol]) - 1)

    g_begin, g_mask = begin[0], mask[0]
    bit, here, stop, gb, gm, hue = at_bit[live], place[live], end[live], g_begin[live], g_mask[live], constant[live]
    step = 0
    while len(live):
        step += 1
        peek = (words[bit >> 3] >> (bit & 7).astype(np.uint64)).view(np.int64)
        found = table[gb + (peek & gm)]
        symbol = found >> 4
        literal = symbol < 256
        if gray:
            out[here] = symbol << 8 | hue  # where a reference begins, the copy overwrites it
        else:
            on = np.nonzero(literal)[0]
            out[here[on]] = symbol[on] << 8
            bit[on] = _colours(out, here[on], live[on], bit[on] + (found[on] & 15), look)
        # references wait a few steps for others, as handling some costs hardly more than handling one
        if step % WAIT == 0 or not literal.any():
            ref = np.nonzero(~literal)[0]
            lanes, b, code = live[ref], bit[ref] + (found[ref] & 15), symbol[ref] - 256
            length = extended(b, code)
            b = b + _EXTRA[code]
            far = look(lanes, 4, b)
            b = b + (far & 15)
            code = far >> 4
            near = extended(b, code)
            close = np.minimum(near, len(NEAR)) - 1
            distance = np.where(near > len(NEAR), near - len(NEAR), np.maximum(1, _DX[close] + _DY[close] * width[lanes]))
            if (distance > here[ref] - base[lanes]).any() or (here[ref] + length > stop[ref]).any():
                raise ValueError("a reference outside the image")
            copies.append((here[ref], length, distance))
            if gray:
                bit = bit + (found & 15) * literal
            bit[ref] = b + _EXTRA[code]
            here = here + literal
            here[ref] += length
        else:
            if gray:
                bit = bit + (found & 15) * literal
            here = here + literal
        left = here < stop
        if not left.all():
            gone = live[~left]
            if (bit[~left] > most_bit[gone]).any():
                raise ValueError("the stream ends too soon")
            live, bit, here, stop, gb, gm, hue = (x[left] for x in (live, bit, here, stop, gb, gm, hue))
        if step % 16 == 0 and len(live) and int(bit.max()) > 8 * (len(raw) - SPARE):
            raise ValueError("the stream ends too soon")
    if copies:
        begins, length, distance = (np.concatenate(c) for c in zip(*copies, strict=True))
        dest = np.repeat(begins - (np.cumsum(length) - length), length) + np.arange(length.sum())
        source = np.arange(len(out))
        source[dest] = dest - np.repeat(distance, length)
        todo = dest
        while len(todo):  # follow references to references, twice as far each time
            further = source[source[todo]]
            moved = further != source[todo]
            source[todo] = further
            todo = todo[moved]
        out[dest] = out[source[dest]]
    return np.split(out, base[1:])


def _colours(out: np.ndarray, here: np.ndarray, lanes: np.ndarray, bit: np.ndarray, look) -> np.ndarray:
    """Red, blue and alpha of one pixel a lane, which already has its green; the place in the stream after them."""
    value = np.zeros(len(lanes), np.int64)
    for code, shift in ((1, 16), (2, 0), (3, 24)):
        found = look(lanes, code, bit)
        bit = bit + (found & 15)
        value |= (found.astype(np.int64) >> 4) << shift
    out[here] = out[here] & 0xFF00 | value
    return bit


def _split(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _half(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _clamped(parts: Iterator[int]) -> int:
    out = 0
    for p in parts:
        out = out << 8 | min(255, max(0, p))
    return out


def _predicted(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    four = list(zip(_split(left), _split(top), _split(top_left), strict=True))
    if mode == 11:  # whichever neighbour is nearer to left + top - top_left
        to_left = sum(abs(t - c) for _, t, c in four)
        to_top = sum(abs(x - c) for x, _, c in four)
        return left if to_left < to_top else top
    if mode == 12:
        return _clamped(x + t - c for x, t, c in four)
    if mode == 13:
        mean = zip(_split(_half(left, top)), _split(top_left), strict=True)
        return _clamped(m + int((m - c) / 2) for m, c in mean)
    return 0xFF000000


def _unpredict(px: np.ndarray, width: int, height: int, block: np.ndarray, shift: int) -> np.ndarray:
    out = px.tolist()
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not y:
                guess = out[at - 1] if x else 0xFF000000
            elif not x:
                guess = out[at - width]
            else:
                guess = _predicted(int(block[y >> shift, x >> shift]) >> 8 & 15, out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
            value = out[at]
            out[at] = (value & 0xFF00FF00) + (guess & 0xFF00FF00) & 0xFF00FF00 | (value & 0x00FF00FF) + (guess & 0x00FF00FF) & 0x00FF00FF
    return np.array(out, dtype=np.uint32)


def _uncross(px: np.ndarray, width: int, height: int, block: np.ndarray, shift: int) -> np.ndarray:
    own = np.repeat(np.repeat(block, 1 << shift, axis=0), 1 << shift, axis=1)[:height, :width].ravel()
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(px >> 8)
    red = (px >> 16 & 255).astype(np.int32) + (signed(own) * green >> 5) & 255
    blue = (px & 255).astype(np.int32) + (signed(own >> 8) * green >> 5)
    blue = blue + (signed(own >> 16) * signed(red.astype(np.uint32)) >> 5) & 255
    return px & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _add_green(px: np.ndarray) -> np.ndarray:
    green = px >> 8 & 255
    red, blue = (px >> 16) + green & 255, px + green & 255
    return px & np.uint32(0xFF00FF00) | red << 16 | blue


@dataclass
class File:
    """A file read up to the pixels of its main image."""

    image: Coded
    width: int
    height: int
    undo: list[tuple] = field(default_factory=list)


def _opened(data: bytes) -> File:
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo: list[tuple] = []
    full = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            shift = bits.read(3) + 2
            across = width + (1 << shift) - 1 >> shift
            block = _pixels(_coded(bits, across, height + (1 << shift) - 1 >> shift, False)).reshape(-1, across)
            undo.append((kind, width, block, shift))
        elif kind == 2:
            undo.append((kind, width, None, 0))
        else:
            n = bits.read(8) + 1
            table = _pixels(_coded(bits, n, 1, False))
            channels = np.cumsum(np.stack(_split(table)), axis=1).astype(np.uint32) & 255
            colors = np.zeros(256, dtype=np.uint32)
            colors[:n] = channels[0] << 24 | channels[1] << 16 | channels[2] << 8 | channels[3]
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, width, colors, shift))
            width = width + (1 << shift) - 1 >> shift
    return File(_coded(bits, width, height, True), full, height, undo)


def _restored(file: File, px: np.ndarray) -> np.ndarray:
    """The transforms undone, the last first."""
    height = file.height
    for kind, w, extra, shift in reversed(file.undo):
        if kind == 0:
            px = _unpredict(px, w, height, extra, shift)
        elif kind == 1:
            px = _uncross(px, w, height, extra, shift)
        elif kind == 2:
            px = _add_green(px)
        else:
            size = 8 >> shift
            packed = (px >> 8 & 255).reshape(height, -1)
            if shift:
                spread = packed[:, :, None] >> np.arange(1 << shift, dtype=np.uint32) * size & (1 << size) - 1
                packed = spread.reshape(height, -1)[:, :w]
            px = extra[packed.ravel()]
    return px.astype(">u4").view(np.uint8).reshape(height, file.width, 4)


def decode(data: bytes) -> np.ndarray:
    """The samples of one file, shape (height, width, 4), order A,R,G,B."""
    file = _opened(data)
    return _restored(file, _pixels(file.image))


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """What ``decode`` gives for each file."""
    opened = [_opened(f) for f in files]
    together = [i for i, f in enumerate(opened) if not f.image.cache_bits and f.image.meta is None]
    pixels = dict(zip(together, _lanes([opened[i].image for i in together]), strict=True)) if together else {}
    return [_restored(f, pixels[i] if i in pixels else _pixels(f.image)) for i, f in enumerate(opened)]


def container(body: bytes) -> bytes:
    """The file around a VP8L stream (without its signature byte)."""
    size = len(body) + 1
    padded = body + b"\0" * (size & 1)
    return b"RIFF" + (13 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + b"\x2f" + padded


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a prefix code for the counts, ``most`` bits at most; one symbol alone gets length 1."""
    used = [(c, s) for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for _, s in used:
            lengths[s] = 1
        return lengths
    used.sort()
    n = len(used)
    floor = 0
    while True:
        # leaves and inner nodes both come in ascending order, so the two least are at the fronts of two queues
        weight = [c if c > floor else floor for c, _ in used]
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (inner >= node or weight[leaf] <= weight[inner]):
                    total += weight[leaf]
                    parent[leaf] = node
                    leaf += 1
                else:
                    total += weight[inner]
                    parent[inner] = node
                    inner += 1
            weight.append(total)
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if depth[0] <= most and max(depth) <= most:
            break
        floor = 2 * floor or max(1, sum(c for c, _ in used) >> most)  # rarer symbols count as less rare
    for i, (_, s) in enumerate(used):
        lengths[s] = depth[i]
    return lengths


def canonical(lengths: list[int]) -> list[int]:
    """The codes of the lengths, lowest bit first in the stream."""
    codes = [0] * len(lengths)
    code = before = 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        codes[s] = int(_FLIPPED[n][code])
        code, before = code + 1, n
    return codes


def _write_simple(b: Bits, *symbols: int) -> None:
    """A code of one or two symbols below 256."""
    value = 1 | (len(symbols) - 1) << 1 | 4 | symbols[0] << 3
    if len(symbols) > 1:
        value |= symbols[1] << 11
    b.write(value, 3 + 8 * len(symbols))


def _write_code(b: Bits, lengths: list[int]) -> None:
    """A prefix code: as one or two symbols where that will do, else its lengths with runs of zeros."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and (not used or used[-1] < 256):
        _write_simple(b, *(used or [0]))
        return
    marks: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at = 0
    for s in [*used, len(lengths)]:
        zeros = s - at
        while zeros:
            if zeros >= 11:
                run = min(zeros, 138)
                marks.append((18, run - 11, 7))
            elif zeros >= 3:
                run = zeros
                marks.append((17, run - 3, 3))
            else:
                run = 1
                marks.append((0, 0, 0))
            zeros -= run
        if s < len(lengths):
            marks.append((lengths[s], 0, 0))
        at = s + 1
    counts = [0] * 19
    for s, _, _ in marks:
        counts[s] += 1
    own = code_lengths(counts, 7)
    codes = canonical(own)
    n = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    b.write(0, 1)
    b.write(n - 4, 4)
    for s in CODE_LENGTH_ORDER[:n]:
        b.write(own[s], 3)
    b.write(0, 1)
    alone = sum(1 for x in own if x) == 1
    value = size = 0
    for s, more, extra in marks:
        if not alone:
            value |= codes[s] << size
            size += own[s]
        value |= more << size
        size += extra
    b.write(value, size)


def _marked(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra value and number of extra bits of lengths or distances."""
    d = v - 1
    high = np.frexp(np.maximum(d, 1))[1].astype(np.int64) - 1
    extra = np.maximum(high - 1, 0)
    symbol = np.where(d < 2, d, 2 * high + (d >> extra & 1))
    return symbol, d & (1 << extra) - 1, extra


def _copies(px: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of references for the images that lie back to back, first come first served."""
    n = len(px)
    padded = np.concatenate([px, np.zeros(3, np.uint8)]).astype(np.uint32)
    place = np.arange(n, dtype=np.int32)
    four = padded[:n] << 24 | padded[1 : n + 1] << 16 | padded[2 : n + 2] << 8 | padded[3 : n + 3]
    # four samples and their place as one number: sorted, equal samples stand together in the order of their places
    key = four.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
    key.sort()
    order = key.astype(np.uint32).view(np.int32)
    key >>= np.uint64(32)
    same = key[1:] == key[:-1]
    later, earlier = order[1:][same], order[:-1][same]
    image = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    own = (image[later] == image[earlier]) & (later + 4 <= ends.astype(np.int32)[image[later]])
    before = np.full(n + 1, -2, dtype=np.int32)
    before[later[own]] = earlier[own]
    # a stretch of places whose nearest earlier place moves along with them is one long match
    found = before[:-1] >= 0
    goes_on = found & (before[1:] == before[:-1] + 1)
    stretch_end = np.minimum.accumulate(np.where(goes_on, np.int32(n), place)[::-1])[::-1]
    length = np.where(found, np.minimum(stretch_end - place + 4, MOST_COPY), 0)
    good = length >= LEAST_COPY
    following = np.minimum.accumulate(np.where(good, place, np.int32(n))[::-1])[::-1]
    starts: list[int] = []
    begin = 0
    for end in ends.tolist():
        nxt, size = following[begin:end].tolist(), length[begin:end].tolist()
        i = begin
        while i < end:
            i = nxt[i - begin]
            if i >= end:
                break
            starts.append(i)
            i += size[i - begin]
        begin = end
    at = np.array(starts, dtype=np.int64)
    return at, length[at].astype(np.int64), at - before[at]


def encode_gray(images: list[np.ndarray]) -> list[bytes]:
    """Lossless files of (height, width) images of 8-bit samples; every pixel is opaque gray of its sample."""
    if not images:
        return []
    palettes, streams, widths = [], [], []
    for image in images:
        present = np.zeros(256, dtype=bool)
        present[image.ravel()] = True
        values, index = np.nonzero(present)[0], image
        shift = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1 if len(values) <= 16 else 0
        if shift:
            each = 1 << shift
            index = (np.cumsum(present) - 1).astype(np.uint8)[image]
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % each))).reshape(len(index), -1, each)
            index = (index.astype(np.int64) << np.arange(each) * (8 >> shift)).sum(axis=2).astype(np.uint8)
        palettes.append(values.tolist() if shift else [])
        streams.append(index.ravel())
        widths.append(index.shape[1])
    px, width = np.concatenate(streams), np.array(widths)
    ends = np.cumsum([len(s) for s in streams])
    start, length, distance = _copies(px, ends)
    # one token a literal or reference, in the order of the stream
    inside = np.zeros(len(px) + 1, dtype=np.int8)
    inside[start] += 1  # references don't overlap, so no start and no end stands twice
    inside[start + length] -= 1
    token = np.cumsum(inside[:-1], dtype=np.int8) == 0
    token[start] = True
    at = np.nonzero(token)[0]
    image = np.searchsorted(ends, at, side="right")
    green = px[at].astype(np.int64)
    ref = np.searchsorted(at, start)
    symbol, l_extra, l_bits = _marked(length)
    own = width[image[ref]]
    near = np.where(distance == 1, 2, np.where(distance == own, 1, distance + len(NEAR)))
    d_symbol, d_extra, d_bits = _marked(near)
    green[ref] = 256 + symbol
    greens = np.bincount(image * 280 + green, minlength=280 * len(images)).reshape(-1, 280).tolist()
    far = np.bincount(image[ref] * 40 + d_symbol, minlength=40 * len(images)).reshape(-1, 40).tolist()
    heads, codes = [], np.zeros((2, len(images), 280, 2), dtype=np.int64)
    for i, picture in enumerate(images):
        g, d = code_lengths(greens[i], MOST_BITS), code_lengths(far[i], MOST_BITS)
        heads.append(_gray_head(picture.shape[1], picture.shape[0], palettes[i], g, d))
        for c, lengths in ((0, g), (1, d)):
            codes[c, i, : len(lengths), 0] = canonical(lengths)
            if sum(1 for x in lengths if x) > 1:
                codes[c, i, : len(lengths), 1] = lengths
    value, bits = codes[0, image, green, 0], codes[0, image, green, 1]
    value = np.where(bits > 0, value, 0)
    which = image[ref]
    for more, n in ((l_extra, l_bits), (np.where(codes[1, which, d_symbol, 1] > 0, codes[1, which, d_symbol, 0], 0), codes[1, which, d_symbol, 1]), (d_extra, d_bits)):
        value[ref] |= more << bits[ref]
        bits[ref] += n
    # every image's tokens begin in a word of 64 bits of their own, behind the bits of the head's last byte
    cuts = np.searchsorted(image, np.arange(len(images) + 1))
    lead = np.array([h.size & 7 for h in heads])
    before = np.concatenate([[0], np.cumsum(bits)])
    size = before[cuts[1:]] - before[cuts[:-1]] + lead
    base = np.cumsum((size + 63) // 64) - (size + 63) // 64
    at = before[:-1] + (64 * base + lead - before[cuts[:-1]])[image]
    words = _or_into(int(base[-1] + (size[-1] + 63) // 64), at, value.astype(np.uint64))
    raw = words.astype("<u8").tobytes()
    out = []
    for i, head in enumerate(heads):
        whole = head.size >> 3
        front = head.value.to_bytes(whole + 1, "little")
        body = raw[8 * base[i] : 8 * base[i] + (int(size[i]) + 7) // 8]
        joined = bytes([front[whole] | body[0]]) + body[1:] if body else b""
        out.append(container(front[:whole] + (joined or front[whole : whole + (1 if lead[i] else 0)])))
    return out


def _or_into(n: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """n words of 64 bits that hold each value from its bit on; places ascend and values don't overlap."""
    words = np.zeros(n + 1, dtype=np.uint64)
    if len(at):
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.nonzero(np.diff(word, prepend=-1))[0]
        words[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = np.nonzero(shift > 0)[0]
        high = value[over] >> (np.uint64(64) - shift[over])
        over, high = over[high > 0], high[high > 0]
        words[word[over] + 1] |= high  # one value at most runs on from each word
    return words[:n]


def _gray_head(width: int, height: int, values: list[int], green: list[int], far: list[int]) -> Bits:
    """Everything before the pixels: sizes, the transforms, and the five codes.

    Samples are stored as green alone, and the subtract-green transform makes red and blue equal to it.  With ``values`` a
    palette of them comes between, whose pixels are bundled.
    """
    b = Bits()
    b.write(width - 1 | height - 1 << 14 | 1 << 32 | 2 << 33, 35)  # no alpha, version 0; subtract-green
    if values:
        b.write(1 | 3 << 1 | len(values) - 1 << 3, 12)  # the palette, and no cache for it
        steps = [v - w for v, w in zip(values, [0, *values], strict=False)]
        counts = [0] * 280
        for s in steps:
            counts[s] += 1
        lengths = code_lengths(counts, MOST_BITS)
        codes = canonical(lengths)
        alone = sum(1 for n in lengths if n) == 1
        _write_code(b, lengths)
        _write_simple(b, 0)
        _write_simple(b, 0)
        _write_simple(b, *((0, 255) if len(values) > 1 else (255,)))  # alpha: 255, then the difference 0
        _write_simple(b, 0)
        for i, s in enumerate(steps):
            if not alone:
                b.write(codes[s], lengths[s])
            if len(values) > 1:
                b.write(0 if i else 1, 1)
    b.write(0, 3)  # no further transform, no cache, no meta image
    _write_code(b, green)
    for value in (0, 0, 255):
        _write_simple(b, value)
    _write_code(b, far)
    return b
