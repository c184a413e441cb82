"""The lossless WebP (VP8L) bit stream: a complete decoder and an encoder.

Pixels are flat lists or arrays of 32-bit ARGB numbers. The decoder reads simple and normal
prefix codes, meta prefix codes, back-references, the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Fixed values of the format.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
HASH = 0x1E35A7BD
#: Near distances: offsets of the 120 nearest earlier pixels, nearest first.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)


class FormatError(ValueError):
    """The bytes are not a valid lossless WebP image."""


# --- bits -----------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        v = self.peek() & ((1 << n) - 1)
        self.at += n
        return v


class Writer:
    def __init__(self):
        self.bits, self.n = 0, 0
        self.out = bytearray()

    def put(self, value: int, n: int) -> None:
        self.bits |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.bits & 255)
            self.bits >>= 8
            self.n -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.bits]) if self.n else b"")


# --- prefix codes ---------------------------------------------------------------------


def canonical(lengths) -> list[tuple[int, int]]:
    """(bit-reversed code, length) of each symbol; a lone symbol has length 0."""
    used = [s for s, n in enumerate(lengths) if n]
    out = [(0, 0)] * len(lengths)
    if len(used) < 2:
        return out
    code, last = 0, 0
    for n, s in sorted((lengths[s], s) for s in used):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    if code != 1 << last:
        raise FormatError("prefix code is not complete")
    return out


class Code:
    """Lookup table of a prefix code: ``table[low bits] = symbol << 4 | length``."""

    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            used = [0]
        self.width = max(lengths, default=0) if len(used) > 1 else 0
        self.table = np.zeros(1 << self.width, np.int64)
        if len(used) == 1:
            self.table[0] = used[0] << 4
        else:
            for s, (code, n) in enumerate(canonical(lengths)):
                if n:
                    self.table[code :: 1 << n] = s << 4 | n
        self._list = self.table.tolist()
        self._mask = (1 << self.width) - 1

    def read(self, r: Reader) -> int:
        v = self._list[r.peek() & self._mask]
        r.at += v & 15
        return v >> 4


def read_lengths(r: Reader, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if r.take(1):  # simple: one or two symbols
        two = r.take(1)
        lengths[r.take(8 if r.take(1) else 1)] = 1
        if two:
            lengths[r.take(8)] = 1
        return lengths
    first = [0] * 19
    for i in range(4 + r.take(4)):
        first[ORDER[i]] = r.take(3)
    code = Code(first)
    left = 2 + r.take(2 + 2 * r.take(3)) if r.take(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        bits, least = {16: (2, 3), 17: (3, 3), 18: (7, 11)}[s]
        n = least + r.take(bits)
        if at + n > alphabet:
            raise FormatError("code lengths run past the alphabet")
        lengths[at : at + n] = [before if s == 16 else 0] * n
        at += n
    return lengths


def write_lengths(w: Writer, lengths) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    w.put(0, 1)
    first = [4] * 16 + [0] * 3  # sixteen literal lengths, four bits each
    top = max(i for i, s in enumerate(ORDER) if first[s]) + 1
    w.put(top - 4, 4)
    for s in ORDER[:top]:
        w.put(first[s], 3)
    w.put(0, 1)
    codes = canonical(first)
    for n in lengths:
        w.put(*codes[n])


def huffman(weights, limit: int = 15) -> list[int]:
    """Length-limited code lengths: weights are flattened until the depth fits."""
    live = [(w, s) for s, w in enumerate(weights) if w]
    lengths = [0] * len(weights)
    if len(live) == 1:
        lengths[live[0][1]] = 1
        return lengths
    floor = 1
    while live:
        heap = [(max(w, floor), i, (s,)) for i, (w, s) in enumerate(live)]
        heapq.heapify(heap)
        depth = dict.fromkeys((s for _, s in live), 0)
        tick = len(live)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
            tick += 1
        if max(depth.values()) <= limit:
            for s, n in depth.items():
                lengths[s] = n
            break
        floor *= 2
    return lengths


def prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, extra value) of a length or distance of at least 1."""
    x = value - 1
    if x < 4:
        return x, 0, 0
    top = x.bit_length() - 1
    return 2 * top + (x >> (top - 1) & 1), top - 1, x & ((1 << (top - 1)) - 1)


def _value(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.take(extra) + 1


# --- entropy-coded images -------------------------------------------------------------


def _read_group(r: Reader, cache: int) -> list[Code]:
    return [Code(read_lengths(r, n)) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]


def _read_image(r: Reader, width: int, height: int, main: bool) -> list[int]:
    cache = r.take(4) if r.take(1) else 0
    if cache > 11:
        raise FormatError("colour cache too large")
    meta, bits, across = None, 0, 0
    groups = 1
    if main and r.take(1):
        bits = r.take(3) + 2
        across = (width + (1 << bits) - 1) >> bits
        down = (height + (1 << bits) - 1) >> bits
        meta = [p >> 8 & 0xFFFF for p in _read_image(r, across, down, False)]
        groups = max(meta) + 1
    codes = [_read_group(r, cache) for _ in range(groups)]
    recent = [0] * (1 << cache) if cache else None
    shift = 32 - cache
    out: list[int] = []
    total = width * height
    group = codes[0]
    while len(out) < total:
        at = len(out)
        if meta:
            group = codes[meta[(at // width >> bits) * across + (at % width >> bits)]]
        s = group[0].read(r)
        if s < 256:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _value(s - 256, r)
            d = _value(group[4].read(r), r)
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > total:
                raise FormatError("back-reference outside the image")
            new = (out[-d:] * (length // d + 1))[:length] if d <= length else out[at - d : at - d + length]
        else:
            new = [recent[s - 280]]
        out += new
        if cache:
            for p in new:
                recent[(HASH * p & 0xFFFFFFFF) >> shift] = p
    return out


# --- transforms -----------------------------------------------------------------------


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of int32: alpha, red, green, blue."""
    a = np.asarray(argb, np.int64)
    return np.stack([a >> 24 & 255, a >> 16 & 255, a >> 8 & 255, a & 255], -1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_right, top_left):
    """Prediction from (n, 4) or (4,) channel arrays."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    mean = lambda a, b: (a + b) >> 1
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:  # the neighbour nearer to left + top - top_left
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        d = m - top_left
        return np.clip(m + (np.abs(d) >> 1) * np.sign(d), 0, 255)
    return np.array([255, 0, 0, 0], np.int32)


def _neighbours(c: np.ndarray, y: int, x: int, width: int):
    """left, top, top-right, top-left; top-right of the last column is this row's first pixel."""
    flat = c.reshape(-1, 4)
    at = y * width + x
    return flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1]


def _predictions(c, modes, bits, width, height, add: bool, out) -> None:
    across = (width + (1 << bits) - 1) >> bits
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = np.array([255, 0, 0, 0], np.int32) if x == 0 else out[0, x - 1] if add else c[0, x - 1]
            elif x == 0:
                p = (out if add else c)[y - 1, 0]
            else:
                p = predict(modes[(y >> bits) * across + (x >> bits)], *_neighbours(out if add else c, y, x, width))
            out[y, x] = (c[y, x] + p if add else c[y, x] - p) & 255


def _signed(v):
    v = np.asarray(v) & 255
    return v - 256 * (v > 127)


def _cross(c: np.ndarray, elements, bits: int, add: bool) -> np.ndarray:
    h, w, _ = c.shape
    across = (w + (1 << bits) - 1) >> bits
    e = np.asarray(elements, np.int64).reshape(-1, across)
    e = e[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    to = lambda t, v: (_signed(t) * _signed(v)) >> 5
    r2b, g2b, g2r = e >> 16, e >> 8, e
    red, green, blue = (c[..., i].astype(np.int64) for i in (1, 2, 3))
    out = c.copy()
    if add:
        red = (red + to(g2r, green)) & 255
        blue = blue + to(g2b, green) + to(r2b, red)
    else:
        blue = blue - to(g2b, green) - to(r2b, red)
        red = red - to(g2r, green)
    out[..., 1], out[..., 3] = red & 255, blue & 255
    return out


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# --- containers -----------------------------------------------------------------------


def split(data: bytes) -> list[bytes]:
    """The VP8L payloads of the RIFF files that follow one another in ``data``."""
    out, at = [], 0
    while at < len(data):
        riff, size, kind, chunk, n = struct.unpack_from("<4sI4s4sI", data, at)
        if riff != b"RIFF" or kind != b"WEBP" or chunk != b"VP8L":
            raise FormatError("not a lossless WebP file")
        out.append(data[at + 20 : at + 20 + n])
        at += 8 + size
    return out


def wrap(payload: bytes) -> bytes:
    pad = b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(payload) + len(pad), b"WEBP", b"VP8L", len(payload)) + payload + pad


def dimensions(payload: bytes) -> tuple[int, int]:
    if payload[:1] != b"\x2f":
        raise FormatError("no VP8L signature")
    v = int.from_bytes(payload[1:5], "little")
    if v >> 29:
        raise FormatError("unknown version")
    return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1


def decode(payload: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels) of a VP8L payload."""
    width, height = dimensions(payload)
    r, xsize, todo = Reader(payload, 40), width, []
    while r.take(1):
        kind = r.take(2)
        if kind in (PREDICTOR, CROSS):
            bits = r.take(3) + 2
            size = ((xsize + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits)
            todo.append((kind, bits, _read_image(r, *size, False), xsize))
        elif kind == GREEN:
            todo.append((kind, 0, None, xsize))
        else:
            n = r.take(8) + 1
            table = _joined(np.cumsum(_channels(_read_image(r, n, 1, False)), axis=0))
            bits = _bundle(n)
            todo.append((kind, bits, table, xsize))
            xsize = (xsize + (1 << bits) - 1) >> bits
    c = _channels(_read_image(r, xsize, height, True)).reshape(height, xsize, 4)
    for kind, bits, table, was in reversed(todo):
        if kind == PREDICTOR:
            out = np.zeros_like(c)
            _predictions(c, [p >> 8 & 15 for p in table], bits, was, height, True, out)
            c = out
        elif kind == CROSS:
            c = _cross(c, table, bits, True)
        elif kind == GREEN:
            c = c.copy()
            c[..., 1] = (c[..., 1] + c[..., 2]) & 255
            c[..., 3] = (c[..., 3] + c[..., 2]) & 255
        else:
            each = 8 >> bits
            index = c[..., 2]
            if bits:
                lanes = (index[..., None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)
                index = lanes.reshape(height, -1)[:, :was]
            full = np.zeros(256, np.int64)
            full[: len(table)] = table
            c = _channels(full[index])
    return width, height, _joined(c).reshape(-1)


def _write_image(w: Writer, px: list[int], width: int, main: bool, cache: int) -> None:
    """Greedy back-references over a hash of pixel pairs, then one group of prefix codes."""
    w.put(1, 1) if cache else w.put(0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(0, 1)
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    recent, shift = [None] * (1 << cache), 32 - cache
    seen: dict = {}
    tokens, i = [], 0
    while i < len(px):
        j = seen.get(tuple(px[i : i + 3]))
        n = 0
        while j is not None and i + n < len(px) and n < 4096 and px[j + n] == px[i + n]:
            n += 1
        slot = (HASH * px[i] & 0xFFFFFFFF) >> shift if cache else 0
        if n >= 3:
            tokens.append((256, n, i - j))
        elif cache and recent[slot] == px[i]:
            tokens.append((280 + slot, 0, 0))
            n = 1
        else:
            tokens.append((px[i] >> 8 & 255, px[i], 0))
            n = 1
        for k in range(i, i + n):
            seen[tuple(px[k : k + 3])] = k
            if cache:
                recent[(HASH * px[k] & 0xFFFFFFFF) >> shift] = px[k]
        i += n
    counts = [[0] * n for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]
    flat = []
    for s, a, d in tokens:
        if s == 256:
            ls, le, lv = prefix_of(a)
            ds, de, dv = prefix_of(near.get(d, d + 120))
            flat += [(0, 256 + ls), (None, le, lv), (4, ds), (None, de, dv)]
        elif s >= 280:
            flat.append((0, s))
        else:
            flat += [(0, s), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)]
    for x in flat:
        if x[0] is not None:
            counts[x[0]][x[1]] += 1
    codes = []
    for c in counts:
        lengths = huffman(c) if any(c) else [1] + [0] * (len(c) - 1)
        write_lengths(w, lengths)
        codes.append(canonical(lengths))
    for x in flat:
        w.put(*(codes[x[0]][x[1]] if x[0] is not None else (x[2], x[1])))


def encode(px, width: int, height: int, *, transforms=(), bits: int = 3, modes=None, elements=None, cache: int = 0) -> bytes:
    """A VP8L payload; ``transforms`` are applied in order. ``modes``/``elements`` are per block."""
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    c = _channels(np.asarray(px)).reshape(height, width, 4)
    xsize = width
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS):
            w.put(bits - 2, 3)
            across, down = (xsize + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            n = across * down
            given = modes if kind == PREDICTOR else elements
            block = [int(given[i % len(given)]) for i in range(n)]
            _write_image(w, [m << 8 for m in block] if kind == PREDICTOR else block, across, False, 0)
            if kind == PREDICTOR:
                out = np.zeros_like(c)
                _predictions(c, block, bits, xsize, height, False, out)
                c = out
            else:
                c = _cross(c, block, bits, False)
        elif kind == GREEN:
            c = c.copy()
            c[..., 1] = (c[..., 1] - c[..., 2]) & 255
            c[..., 3] = (c[..., 3] - c[..., 2]) & 255
        else:
            table, index = np.unique(_joined(c), return_inverse=True)
            if len(table) > 256:
                raise ValueError("the palette transform takes at most 256 colours")
            w.put(len(table) - 1, 8)
            step = np.diff(_channels(table), axis=0, prepend=0)
            _write_image(w, _joined(step).tolist(), len(table), False, 0)
            pack = _bundle(len(table))
            index = index.reshape(height, xsize)
            xsize_ = (xsize + (1 << pack) - 1) >> pack
            wide = np.zeros((height, xsize_ << pack), np.int64)
            wide[:, :xsize] = index
            lanes = wide.reshape(height, xsize_, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))
            c = np.zeros((height, xsize_, 4), np.int32)
            c[..., 0], c[..., 2] = 255, lanes.sum(-1)
            xsize = xsize_
    w.put(0, 1)
    _write_image(w, _joined(c).reshape(-1).tolist(), xsize, True, cache)
    return w.done()
