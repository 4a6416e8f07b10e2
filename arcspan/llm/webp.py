"""Media columns as lossless WebP: a decoder for the whole bitstream, and encoders.

``decode`` reads any still lossless image: prefix codes (simple and normal),
several groups of them, back-references with the distance map, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.
It writes an array of ARGB pixels.

Images of a batch that need neither transforms, nor groups, nor
back-references are decoded in step: numpy reads one pixel of each of them at
a time, their colour caches side by side, so the cost of a step is shared by
all. Which path an image takes depends on its bits alone.

``encode`` is the general encoder (transforms, cache and back-references as
asked for). ``encode_payloads`` stores bytes: four of them are a pixel, 16
pixels a row, one file a payload. Two forms compete for each. The plain one
has fixed codes, with or without a colour cache, so a batch is packed by array
operations. The general one has codes of its own, back-references, a colour
cache and the transform (subtract-green, cross-colour, a predictor, a palette)
that leaves least entropy; it is written where the estimated size is under
``WORTH`` of the plain one's, and kept where it is smaller. A file holds at most
``STRIP`` bytes (the height a format of 14 bits allows); a longer payload is
several files one after another, each of which tells its size.

Defined cases: a null text is an empty one, whose payload is ``UNIT`` zero
bytes; texts of any length are stored whole; equal texts give equal images,
whatever stands beside them in a batch; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, by_batch

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH, LITERALS, LENGTHS, DISTANCES, LONGEST = 0x1E35A7BD, 256, 24, 40, 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

WIDTH, UNIT, STRIP, SLICE = 16, 64, 1 << 20, 1 << 24
WORTH = 0.5
LANES = 24  # fewer images are read one by one


class BadImage(ValueError):
    pass


class Reader:
    """Bits from the lowest of the first byte on; beyond the end there are zeros, which ``check`` reports."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 4 + (n >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value

    def check(self) -> None:
        if self.at > 8 * len(self.data):
            raise BadImage("the bits end early")


def canonical(lengths: list[int]) -> list[int]:
    """Codes of given lengths, their first bit lowest, as they stand in the stream."""
    codes, code, before = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, before = code + 1, n
    return codes


class Code:
    """A prefix code as a table over the next ``bits`` bits; a lone symbol takes none."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            raise BadImage("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.table = 0, [(used[0], 0)]
            return
        if sum(1 << (LONGEST - lengths[s]) for s in used) != 1 << LONGEST:
            raise BadImage("a prefix code that isn't complete")
        self.bits = max(lengths)
        self.table = [(0, 0)] * (1 << self.bits)
        codes = canonical(lengths)
        for s in used:
            for high in range(0, 1 << self.bits, 1 << lengths[s]):
                self.table[high | codes[s]] = (s, lengths[s])

    def read(self, bits: Reader) -> int:
        symbol, n = self.table[bits.peek(self.bits)]
        bits.at += n
        return symbol


def read_lengths(bits: Reader, size: int) -> list[int]:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        for s in [first, bits.read(8)] if two else [first]:
            if s >= size:
                raise BadImage("a symbol outside its alphabet")
            lengths[s] = 1
        return lengths
    outer = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        outer[k] = bits.read(3)
    code = Code(outer)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > size:
                raise BadImage("code lengths beyond the alphabet")
            if s == 16:
                lengths[at : at + n] = [last] * n
            at += n
        bits.check()
    return lengths


def _extended(bits: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read_pixels(bits: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image: groups, cache, literals and copies."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("a colour cache of over 11 bits")
    groups, group_bits = None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        groups = (read_pixels(bits, _blocks(width, group_bits), _blocks(height, group_bits), False) >> 8 & 0xFFFF).reshape(-1).tolist()
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[Code(read_lengths(bits, n)) for n in (LITERALS + LENGTHS + cached, 256, 256, 256, DISTANCES)] for _ in range(max(groups) + 1 if groups else 1)]
    colours, shift = [0] * cached, 32 - cache_bits
    total, across = width * height, _blocks(width, group_bits)
    out: list[int] = []
    green, red, blue, alpha, distance = codes[0]
    put = 0  # pixels that are in the cache
    while len(out) < total:
        at = len(out)
        if groups:
            green, red, blue, alpha, distance = codes[groups[(at // width >> group_bits) * across + (at % width >> group_bits)]]
        s = green.read(bits)
        if s < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTHS:
            n = _extended(bits, s - LITERALS)
            d = _extended(bits, distance.read(bits))
            d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width) if d <= len(NEAR) else d - len(NEAR)
            if d > at or at + n > total:
                raise BadImage("a copy from or to outside the image")
            for k in range(at - d, at - d + n):
                out.append(out[k])
        else:
            for c in out[put:]:
                colours[(HASH * c & 0xFFFFFFFF) >> shift] = c
            put = len(out)
            out.append(colours[s - LITERALS - LENGTHS])
        if cached and len(out) - put > 4096:
            for c in out[put:]:
                colours[(HASH * c & 0xFFFFFFFF) >> shift] = c
            put = len(out)
        bits.check()
    return np.array(out, dtype=np.uint32).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as the last axis, wide enough to calculate with."""
    return np.stack([(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predicted(mode: int, left, top, corner, right) -> list[int]:
    """The prediction from the neighbours (four channels each): left, top, top left, top right."""
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left, to_top = sum(abs(t - c) for t, c in zip(top, corner)), sum(abs(n - c) for n, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(n + t - c) for n, t, c in zip(left, top, corner)]
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner)]


def _walk_predictor(image: np.ndarray, modes: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (sign -1) predictions; they come from the original pixels, which are the result or the input."""
    height, width = image.shape
    given = _channels(image).reshape(-1, 4).tolist()
    mode = (modes >> np.uint32(8) & np.uint32(15)).tolist()
    out: list[list[int]] = []
    known = out if sign > 0 else given
    for at, c in enumerate(given):
        y, x = divmod(at, width)
        if at == 0:
            p = [255, 0, 0, 0]
        elif y == 0:
            p = known[at - 1]
        elif x == 0:
            p = known[at - width]
        else:
            p = _predicted(mode[y >> bits][x >> bits], known[at - 1], known[at - width], known[at - width - 1], known[at - width + 1])
        out.append([(v + sign * q) & 255 for v, q in zip(c, p)])
    return _pixels(np.array(out, dtype=np.int32).reshape(height, width, 4))


def _cross(image: np.ndarray, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    signed = lambda v: ((v & 255) ^ 128) - 128
    c = _channels(image)
    f = np.repeat(np.repeat(_channels(factors), 1 << bits, axis=0), 1 << bits, axis=1)[: c.shape[0], : c.shape[1]]
    moved = lambda factor, v: signed(factor) * signed(v) >> 5
    red = c[..., 1] + sign * moved(f[..., 3], c[..., 2])
    original = red if sign > 0 else c[..., 1]
    blue = c[..., 3] + sign * (moved(f[..., 2], c[..., 2]) + moved(f[..., 1], original))
    return _pixels(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))


def _palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = _palette_bits(len(palette))
    each = 8 >> bits
    index = image >> np.uint32(8) & np.uint32(255)
    parts = [index >> np.uint32(each * k) & np.uint32((1 << each) - 1) for k in range(1 << bits)]
    index = np.stack(parts, axis=-1).reshape(len(image), -1)[:, :width]
    table = np.zeros(256, dtype=np.uint32)
    table[: len(palette)] = palette
    return table[index]


def _chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise BadImage("not a lossless WebP file")
    return data[20 : 20 + int.from_bytes(data[16:20], "little")]


def _size(bits: Reader) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise BadImage("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if bits.read(4) >> 1:
        raise BadImage("an unknown version")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels, rows by columns, of a lossless WebP file."""
    bits = Reader(_chunk(data))
    width, height = _size(bits)
    inner, todo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform that is there twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            todo.append((kind, read_pixels(bits, _blocks(inner, block), _blocks(height, block), False), block))
        elif kind == PALETTE:
            coded = _channels(read_pixels(bits, bits.read(8) + 1, 1, False)[0])
            palette = _pixels(np.cumsum(coded, axis=0))
            todo.append((kind, palette, inner))
            inner = _blocks(inner, _palette_bits(len(palette)))
        else:
            todo.append((kind, None, 0))
    image = read_pixels(bits, inner, height, True)
    for kind, extra, n in reversed(todo):
        if kind == PREDICTOR:
            image = _walk_predictor(image, extra, n, 1)
        elif kind == CROSS_COLOUR:
            image = _cross(image, extra, n, 1)
        elif kind == PALETTE:
            image = _unpalette(image, extra, n)
        else:
            image = _green(image, 1)
    return image


def _green(image: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(image)
    g = c[..., 2]
    return _pixels(np.stack([c[..., 0], c[..., 1] + sign * g, g, c[..., 3] + sign * g], axis=-1))


# --- encoding ---------------------------------------------------------------


class Writer:
    """Bits; whole words move from ``value`` to ``done`` so that adding stays cheap."""

    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 4096:
            self.done += (self.value & (1 << 4096) - 1).to_bytes(512, "little")
            self.value, self.n = self.value >> 4096, self.n - 4096

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")


def huffman(counts: list[int], longest: int = LONGEST) -> list[int]:
    """Code lengths up to ``longest`` for counts; a complete code where two symbols or more are used."""
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used or [0]:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(counts[s], floor), k, [s]) for k, s in enumerate(used)]
        heapq.heapify(heap)
        lengths, k = [0] * len(counts), len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, k, x + y))
            k += 1
        if max(lengths) <= longest:
            return lengths
        floor *= 2  # rare symbols count alike until the tree is flat enough


def write_lengths(to: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used) < 256:
        to.put(1, 1)
        to.put(len(used) - 1, 1)
        wide = used[0] > 1
        to.put(wide, 1)
        to.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            to.put(used[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []
    at = 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at]:
            n += 1
        if lengths[at] == 0 and n >= 3:
            n = min(n, 138)
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif lengths[at] and n >= 4:
            n = min(n, 7)
            tokens += [(lengths[at], 0, 0), (16, n - 4, 2)]
        else:
            n = 1
            tokens.append((lengths[at], 0, 0))
        at += n
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    outer = huffman(counts, 7)
    to.put(0, 1)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if outer[s])
    to.put(max(0, last - 3), 4)
    for s in LENGTH_ORDER[: max(4, last + 1)]:
        to.put(outer[s], 3)
    to.put(0, 1)
    codes, lone = canonical(outer), sum(n > 0 for n in outer) == 1
    for s, extra, n in tokens:
        to.put(codes[s], 0 if lone else outer[s])
        to.put(extra, n)


def _prefix(value: int) -> tuple[int, int, int]:
    """``(prefix, extra bits, how many)`` of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + (v >> extra & 1), v & ((1 << extra) - 1), extra


def write_pixels(to: Writer, image: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    height, width = image.shape
    flat = image.reshape(-1).tolist()
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    colours, shift = [None] * (1 << cache_bits), 32 - cache_bits
    tokens: list[tuple] = []
    last: dict[tuple, int] = {}
    at = 0
    while at < len(flat):
        n, source = 0, last.get(tuple(flat[at : at + 3])) if copies else None
        if source is not None:
            while at + n < len(flat) and n < 4096 and flat[source + n] == flat[at + n]:
                n += 1
        if n >= 3:
            tokens.append(("copy", n, near.get(at - source, at - source + len(NEAR))))
        else:
            n, c = 1, flat[at]
            place = (HASH * c & 0xFFFFFFFF) >> shift if cache_bits else 0
            tokens.append(("cache", place) if cache_bits and colours[place] == c else ("pixel", c))
        for k in range(at, at + n):
            if copies:
                last[tuple(flat[k : k + 3])] = k
            if cache_bits:
                colours[(HASH * flat[k] & 0xFFFFFFFF) >> shift] = flat[k]
        at += n
    counts = [[0] * n for n in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
    coded: list[list[tuple[int, int, int, int]]] = []  # (alphabet, symbol, extra, its bits)
    for kind, *what in tokens:
        if kind == "pixel":
            c = what[0]
            part = [(0, c >> 8 & 255, 0, 0), (1, c >> 16 & 255, 0, 0), (2, c & 255, 0, 0), (3, c >> 24, 0, 0)]
        elif kind == "cache":
            part = [(0, LITERALS + LENGTHS + what[0], 0, 0)]
        else:
            (n, *more), (d, *far) = _prefix(what[0]), _prefix(what[1])
            part = [(0, LITERALS + n, *more), (4, d, *far)]
        for alphabet, s, _, _ in part:
            counts[alphabet][s] += 1
        coded.append(part)
    to.put(1, 1) if cache_bits else to.put(0, 1)
    if cache_bits:
        to.put(cache_bits, 4)
    if main:
        to.put(0, 1)
    lengths = [huffman(c) for c in counts]
    for n in lengths:
        write_lengths(to, n)
    codes = [canonical(n) for n in lengths]
    free = [sum(x > 0 for x in n) == 1 for n in lengths]
    for part in coded:
        for alphabet, s, extra, n in part:
            if not free[alphabet]:
                to.put(codes[alphabet][s], lengths[alphabet][s])
            to.put(extra, n)


def _file(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + padded


def encode(image: np.ndarray, transforms: list[tuple] = (), cache_bits: int = 0, copies: bool = False) -> bytes:
    """A lossless file of ARGB pixels.

    ``transforms``: ``(SUBTRACT_GREEN,)``, ``(PREDICTOR, modes, bits)`` and
    ``(CROSS_COLOUR, factors, bits)`` with one pixel for a block of ``2**bits``
    squared, ``(PALETTE,)`` for at most 256 colours; applied in that order.
    """
    height, width = image.shape
    to = Writer()
    to.put(0x2F, 8)
    to.put(width - 1, 14)
    to.put(height - 1, 14)
    to.put(1, 4)
    for kind, *extra in transforms:
        to.put(1, 1)
        to.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            to.put(extra[1] - 2, 3)
            write_pixels(to, extra[0], False)
            image = _walk_predictor(image, *extra, -1) if kind == PREDICTOR else _cross(image, *extra, -1)
        elif kind == PALETTE:
            palette, index = np.unique(image, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("a palette has 256 colours at most")
            to.put(len(palette) - 1, 8)
            c = _channels(palette)
            write_pixels(to, _pixels(np.diff(c, axis=0, prepend=0))[None, :], False)
            bits = _palette_bits(len(palette))
            index = index.reshape(image.shape).astype(np.uint32)
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << bits))))
            packed = sum(index[:, k :: 1 << bits] << np.uint32(k * (8 >> bits)) for k in range(1 << bits))
            image = np.uint32(0xFF000000) | packed.astype(np.uint32) << np.uint32(8)
        else:
            image = _green(image, -1)
    to.put(0, 1)
    write_pixels(to, image, True, cache_bits, copies)
    return _file(to.bytes())


# --- batches of byte payloads -------------------------------------------------


class Book:
    """Fixed codes for the bytes of all four channels, and for a colour cache, with the bits that announce them."""

    def __init__(self, weights: list[int], cache_bits: int = 0, share: float = 0.2):
        slots = 1 << cache_bits if cache_bits else 0
        lengths = huffman(weights, 14)
        green = huffman(weights + [max(1, int(sum(weights) * share / (1 - share) / slots))] * slots, 14) if slots else lengths
        green, cached = green[:256], sorted(green[256:])
        self.cache_bits = cache_bits
        numbers = lambda x: np.array(x, dtype=np.uint64)
        codes = canonical(green + [0] * LENGTHS + cached)
        self.lengths, self.codes = numbers(lengths), numbers(canonical(lengths))
        self.green_lengths, self.green_codes = numbers(green), numbers(codes[:256])
        self.cache_lengths, self.cache_codes = numbers(cached or [0]), numbers(codes[256 + LENGTHS :] or [0])
        head = Writer()
        head.put(0, 1)  # no transform
        head.put(1 | cache_bits << 1, 5) if slots else head.put(0, 1)
        head.put(0, 1)  # no groups
        write_lengths(head, green + [0] * LENGTHS + cached)
        for _ in range(3):
            write_lengths(head, lengths)
        write_lengths(head, [1] + [0] * (DISTANCES - 1))
        self.n = 8 * len(head.done) + head.n
        self.head = head.value << 8 * len(head.done) | int.from_bytes(head.done, "little")

    def coded(self, pixels: np.ndarray, hits: np.ndarray | None, slots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and sizes of pixels given as rows of four bytes (blue, green, red, alpha); ``hits`` take their slot in the cache."""
        code, size = self.green_codes[pixels[:, 1]], self.green_lengths[pixels[:, 1]]
        for channel in (2, 0, 3):
            code = code | self.codes[pixels[:, channel]] << size
            size = size + self.lengths[pixels[:, channel]]
        if hits is not None:
            code, size = np.where(hits, self.cache_codes[slots], code), np.where(hits, self.cache_lengths[slots], size)
        return code, size


CACHE_BITS = 10
_PLACE = (STRIP // 4 - 1).bit_length()  # bits of a pixel's place in its image


@cache
def books() -> list[Book]:
    """Codes for any bytes alike, for text in Latin script (weights by rule, most frequent letters first), and that with a colour cache."""
    text = [2] * 256
    for k, c in enumerate(b"etaoinsrhldcumpgfbwvykzjxq"):
        text[c], text[c - 32] = int(9000 * 0.87**k) + 20, int(500 * 0.87**k) + 10
    for c in range(0x80, 0xC0):
        text[c] = 40
    for chars, weight in ((b" ", 17000), (b"\n", 900), (b".,", 1500), (b"\xc3", 1500), (b"0123456789", 60), (b"!?'\"()-:;#$%&*|", 60), (b"\0", 500)):
        for c in chars:
            text[c] = weight
    return [Book([1] * 256), Book(text), Book(text, CACHE_BITS)]


def cache_hits(pixels: np.ndarray, image: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a colour cache holds each pixel when it comes, and its slot.

    A slot holds the last pixel of the image that hashed to it, so sorting by
    image, slot and place puts what a slot holds before the pixel that asks.
    """
    slot = (pixels * np.uint32(HASH)) >> np.uint32(32 - bits)
    order = np.sort(image.astype(np.uint64) << np.uint64(32) | slot.astype(np.uint64) << np.uint64(_PLACE) | place.astype(np.uint64))
    first = np.concatenate([[0], np.nonzero(np.diff(image))[0] + 1])
    at = first[(order >> np.uint64(32)).astype(np.int64)] + (order & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    hit = np.zeros(len(pixels), dtype=bool)
    hit[at[1:]] = (order[1:] >> np.uint64(_PLACE) == order[:-1] >> np.uint64(_PLACE)) & (pixels[at[1:]] == pixels[at[:-1]])
    return hit, slot.astype(np.int64)


def _packed(codes: np.ndarray, sizes: np.ndarray, at: np.ndarray, words: np.ndarray) -> None:
    """Adds codes of at most 60 bits to an array of 64-bit words at ascending bit places."""
    word, shift = at >> np.uint64(6), at & np.uint64(63)
    first = np.nonzero(np.diff(word, prepend=np.uint64(2**63)))[0]
    words[word[first]] |= np.bitwise_or.reduceat(codes << shift, first)
    over = np.nonzero(shift + sizes > 64)[0]
    words[word[over] + np.uint64(1)] |= codes[over] >> (np.uint64(64) - shift[over])


def _slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of at most so much together, or of one."""
    out, a, total = [], 0, 0
    for k, size in enumerate(sizes):
        if k > a and total + size > most:
            out.append((a, k))
            a, total = k, 0
        total += size
    return [*out, (a, len(sizes))] if sizes else out


def _uniform(height: int, value: int) -> tuple[np.ndarray, int]:
    """One predictor mode or set of factors for a whole image of ``WIDTH`` columns, and the bits of its blocks."""
    return np.full((_blocks(height, 9), 1), value, dtype=np.uint32), 9


#: By name: the transforms that the general form may take, for an image of that height.
TRIED = {
    "none": lambda h: [],
    "green": lambda h: [(SUBTRACT_GREEN,)],
    "cross": lambda h: [(CROSS_COLOUR, *_uniform(h, 32 << 16))],  # blue less red
    "left": lambda h: [(PREDICTOR, *_uniform(h, 1 << 8))],
    "top": lambda h: [(PREDICTOR, *_uniform(h, 2 << 8))],
    "palette": lambda h: [(PALETTE,)],
}


def _entropies(pixels: np.ndarray, image: np.ndarray, many: int) -> np.ndarray:
    """Of each image the bits of its pixels under codes of its own, with about what announcing those costs."""
    bits = np.zeros(many)
    for channel in range(4):
        counts = np.bincount(image * 256 + pixels[:, channel], minlength=many * 256).reshape(many, 256)
        total = np.maximum(counts.sum(axis=1), 1)
        bits += total * np.log2(total) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1) + 5 * (counts > 0).sum(axis=1)
    return bits


def estimates(data: np.ndarray, image: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """For each image about how many bits the general form takes, and by which transform."""
    many, pixels = len(first) - 1, data.reshape(-1, 4)  # blue, green, red, alpha
    place = np.arange(len(pixels)) - first[image]
    shifted = lambda by, inside: np.where(inside[:, None], pixels - np.roll(pixels, by, axis=0), pixels)
    green, cross = pixels.copy(), pixels.copy()
    green[:, (0, 2)] -= pixels[:, 1:2]
    cross[:, 0] -= pixels[:, 2]
    cost = {"none": pixels, "green": green, "cross": cross, "left": shifted(1, place % WIDTH > 0), "top": shifted(WIDTH, place >= WIDTH)}
    bits = {k: _entropies(v, image, many) for k, v in cost.items()}
    # palettes: different pixels and how often each stands
    whole = data.view("<u4").astype(np.uint64)
    values, counts = np.unique(image.astype(np.uint64) << np.uint64(32) | whole, return_counts=True)
    owner = (values >> np.uint64(32)).astype(np.int64)
    colours, size = np.bincount(owner, minlength=many), np.diff(first)
    bits["palette"] = np.where(colours <= 256, size * np.log2(np.maximum(size, 1)) - np.bincount(owner, counts * np.log2(counts), many) + 25 * colours, np.inf)
    # what copies save: runs of three pixels that stood before in the image
    three = image.astype(np.uint64) << np.uint64(40) ^ whole * np.uint64(0x9E3779B97F4A7C15)
    three[:-2] += whole[1:-1] * np.uint64(0xD6E8FEB86659FD93) + whole[2:] * np.uint64(0xA0761D6478BD642F)
    again = np.ones(len(three), dtype=bool)
    again[np.unique(three, return_index=True)[1]] = False
    again &= place < size[image] - 2  # not into the next image
    share = 0.9 * np.bincount(image, again, many) / np.maximum(size, 1)
    names = list(bits)
    table = np.stack([bits[k] for k in names])
    best = table.argmin(axis=0)
    return table.min(axis=0) * (1 - share) + 160, [names[k] for k in best]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """For each payload (a positive multiple of ``UNIT`` bytes) its image files, one after another."""
    strips = [(k, p[a : a + STRIP]) for k, p in enumerate(payloads) for a in range(0, len(p), STRIP)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in _slices([len(s) for _, s in strips], SLICE // 2):
        part = strips[a:b]
        data = np.frombuffer(b"".join(s for _, s in part), dtype=np.uint8)
        n = np.array([len(s) for _, s in part], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(n // 4)])
        pixels = data.reshape(-1, 4)
        image = np.repeat(np.arange(len(part)), n // 4)
        hits, slots = cache_hits(data.view("<u4"), image, np.arange(len(pixels)) - first[image], CACHE_BITS)
        tried = [b.coded(pixels, hits if b.cache_bits else None, slots) for b in books()]
        cost = np.stack([np.add.reduceat(size, first[:-1]) for _, size in tried]).astype(np.int64) + np.array([[b.n] for b in books()])
        chosen = cost.argmin(axis=0)
        which = chosen[image]
        whole, bits = (np.choose(which, [t[k] for t in tried]) for k in (0, 1))
        heads = np.array([40 + b.n for b in books()], dtype=np.int64)[chosen]
        total = 40 + cost.min(axis=0)
        base = np.concatenate([[0], np.cumsum((total + 63) // 64 + 1)]) * 64
        before = np.cumsum(bits) - bits
        at = before + (base[:-1] + heads - before[first[:-1]].astype(np.int64)).astype(np.uint64)[image]
        words = np.zeros(base[-1] // 64 + 1, dtype="<u8")
        _packed(whole, bits, at, words)
        raw = words.view(np.uint8)
        expected, transform = estimates(data, image, first)
        general = expected < WORTH * total
        for j, (k, s) in enumerate(part):
            if general[j]:
                rows = np.frombuffer(s, dtype="<u4").reshape(-1, WIDTH)
                other = encode(rows, TRIED[transform[j]](len(rows)), 4 if transform[j] == "none" else 0, True)
                if 8 * len(other) < total[j]:
                    out[k].append(other)
                    continue
            b = books()[chosen[j]]
            head = 0x2F | WIDTH - 1 << 8 | len(s) // UNIT - 1 << 22 | 1 << 36 | b.head << 40
            stream = bytearray(raw[base[j] // 8 : base[j] // 8 + (total[j] + 7) // 8])
            known = (40 + b.n + 7) // 8
            stream[:known] = (int.from_bytes(stream[:known], "little") | head).to_bytes(known, "little")
            out[k].append(_file(bytes(stream)))
    return [b"".join(x) for x in out]


def files(media: bytes) -> list[bytes]:
    """The image files that stand one after another."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + n])
        at += n
    return out


BITS = LONGEST
_plain: dict[bytes, tuple[int, int, int, tuple]] = {}  # leading bytes: (bits of the head, mask of the last byte, its value, tables and cache bits)


def _plain_head(stream: bytes) -> tuple[int, tuple[np.ndarray, int]] | None:
    """Where the pixels begin, the four tables and the cache's bits, if an image has literals and cache hits only; heads seen before are known by their bits."""
    for lead, (n, mask, value, tables) in _plain.items():
        if stream[5 : 5 + len(lead)] == lead and stream[5 + len(lead)] & mask == value:
            return n, tables
    bits = Reader(stream, 40)
    if bits.read(1):
        return None
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1) or cache_bits > 11:
        return None
    lengths = [read_lengths(bits, LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0))]
    if any(lengths[0][LITERALS : LITERALS + LENGTHS]):
        return None
    lengths += [read_lengths(bits, n) for n in (256, 256, 256, DISTANCES)]
    tables = np.zeros((4, 1 << BITS), dtype=np.int64)
    for k, one in enumerate(lengths[:4]):
        code = Code(one)
        tables[k] = np.tile(np.array([s | n << 16 for s, n in code.table], dtype=np.int64), 1 << (BITS - code.bits))
    bits.check()
    lead, rest = stream[5 : bits.at >> 3], bits.at & 7
    if len(_plain) >= 64:
        _plain.clear()
    _plain[lead] = bits.at, (1 << rest) - 1, stream[bits.at >> 3] & ((1 << rest) - 1) if rest else 0, (tables, cache_bits)
    return bits.at, (tables, cache_bits)


def decode_batch(images: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels of each file; those with literals and cache hits only are read in step."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[int, list] = {}
    sizes = [int(np.prod(_size(Reader(_chunk(image))))) for image in images]
    most = sorted(sizes)[-LANES] + 4096 if len(sizes) >= LANES else 0  # a few longer ones would be alone for most steps
    for k, image in enumerate(images):
        stream = _chunk(image)
        width, height = _size(Reader(stream))
        if sizes[k] <= most and (found := _plain_head(stream)):
            at, (tables, cache_bits) = found
            groups.setdefault(cache_bits, []).append((width * height, k, width, stream, at, tables))
        else:
            out[k] = decode(image)
    for cache_bits, lanes in groups.items():
        _in_step(lanes, cache_bits, out)
    return out


def _in_step(lanes: list[tuple], cache_bits: int, out: list) -> None:
    """Reads a pixel of every image (``lanes``: size, place in ``out``, width, bits, start, tables) at a time."""
    lanes.sort(key=lambda x: -x[0])
    known = {id(x[5]): x[5] for x in lanes}
    number = {i: k for k, i in enumerate(known)}
    n = np.array([x[0] for x in lanes])
    starts = np.concatenate([[0], np.cumsum([len(x[3]) for x in lanes])])
    data = np.frombuffer(b"".join(x[3] for x in lanes) + bytes(16), dtype=np.uint8)
    view = np.ndarray((len(data) - 8,), dtype="<i8", buffer=data, strides=(1,))
    at = starts[:-1] * 8 + np.array([x[4] for x in lanes])
    ends = starts[1:] * 8
    table = np.concatenate([t.reshape(-1) for t in known.values()])
    book = np.array([number[id(x[5])] for x in lanes]) * (4 << BITS)
    mask = (1 << BITS) - 1
    first = np.concatenate([[0], np.cumsum(n)])
    pixels = np.zeros(first[-1], dtype=np.uint32)
    colours, lane = np.zeros(len(lanes) << cache_bits if cache_bits else 0, dtype=np.uint32), np.arange(len(lanes)) << cache_bits
    alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # lanes with so many pixels
    last = len(view) - 1
    for t in range(n[0]):
        k = alive[t]
        p, b = at[:k], book[:k]
        v = view[np.minimum(p >> 3, last)] >> (p & 7)
        g = table[b + (v & mask)]
        v >>= g >> 16
        r = table[b + (v & mask) + (1 << BITS)]
        v >>= r >> 16
        q = p + (g >> 16) + (r >> 16)
        v = view[np.minimum(q >> 3, last)] >> (q & 7)
        e = table[b + (v & mask) + (2 << BITS)]
        v >>= e >> 16
        a = table[b + (v & mask) + (3 << BITS)]
        q += (e >> 16) + (a >> 16)
        pixel = ((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | e & 255).astype(np.uint32)
        if cache_bits:
            slot = (g & 0xFFFF) - (LITERALS + LENGTHS)
            hit = slot >= 0
            pixel = np.where(hit, colours[lane[:k] + np.maximum(slot, 0)], pixel)
            q = np.where(hit, p + (g >> 16), q)
            colours[lane[:k] + (pixel * np.uint32(HASH) >> np.uint32(32 - cache_bits))] = pixel
        at[:k] = q
        pixels[first[:k] + t] = pixel
    if (at > ends).any():
        raise BadImage("the bits end early")
    for j, (_, k, width, *_) in enumerate(lanes):
        out[k] = pixels[first[j] : first[j + 1]].reshape(-1, width)


def decode_payloads(media: list[bytes]) -> list[bytes]:
    """What :func:`encode_payloads` stored, or the pixels of any lossless files as bytes blue, green, red, alpha."""
    images = [files(m) for m in media]
    flat = decode_batch([x for one in images for x in one])
    out, at = [], 0
    for one in images:
        out.append(b"".join(x.astype("<u4").tobytes() for x in flat[at : at + len(one)]))
        at += len(one)
    return out


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def feature(payload: bytes) -> str:
    """Rows, mean and entropy (bits a sample) of the samples, and the share of the commonest."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = int(counts @ np.arange(256)) / len(payload)
    return f"{len(payload) // UNIT}x{UNIT};{mean:.4f};{abs(float(-(p * np.log2(p)).sum())):.4f};{int(counts.argmax())}:{p.max():.4f}"


def with_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, media``: every whole text (null: empty) as lossless images."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column(1))
        return {key: batch.column(0), "n_bytes": list(map(len, texts)), "media": encode_payloads(list(map(padded, texts)))}

    return by_batch(docs.select(key, text), run, f"{key} {kind}, n_bytes long, media binary")


def with_pixels(rows: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``payload``, the samples read back from a media column; a null stays null."""
    names = [f"c{k}" for k in range(len(rows.columns))]
    place = rows.columns.index(media)

    def run(batch: pa.RecordBatch) -> dict:
        stored = batch.column(place).to_pylist()
        read = iter(decode_payloads([m for m in stored if m is not None]))
        return {n: batch.column(k) for k, n in enumerate(names)} | {"payload": [None if m is None else next(read) for m in stored]}

    fields = [f"{n} {rows.schema[k].dataType.simpleString()}" for k, n in enumerate(names)]
    return by_batch(rows.toDF(*names), run, ", ".join([*fields, "payload binary"])).toDF(*rows.columns, "payload")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: what was stored, and what was read back from it.

    Stored and read in one step of a task, so the images need not travel.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        texts = as_bytes(batch.column(1))
        for a, b in _slices(list(map(len, texts)), SLICE):
            part = texts[a:b]
            media = encode_payloads(list(map(padded, part)))
            for raw, stored, payload in zip(part, media, decode_payloads(media)):
                for name, value in (("n_bytes", len(raw)), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-UNIT:])), ("media_bytes", len(stored)), ("media_sha256", hashlib.sha256(stored).hexdigest()), ("feature", feature(payload))):
                    out[name].append(value)
        return out | {key: batch.column(0)}

    return by_batch(docs.select(key, text), run, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
