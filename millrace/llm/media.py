"""Media columns: texts as lossless WebP pixel arrays and back.

A payload is UTF-8 text padded with spaces to whole rows of 64 RGB pixels. It is stored as
consecutive WebP files of at most ``ROWS`` rows, and all files of a batch are encoded together,
each step for all of them at once:

* back-references to the nearest earlier place with the same three pixels, at any distance;
* a colour cache of one of the sizes in ``CACHES``, or none;
* one of the transforms in ``FORMS``: none, subtract green, predictor with a mode for each block,
  both, cross-colour with multipliers for each block, or palette. Modes are searched where pixels
  are nearer to their neighbours than to the mean, multipliers where channels follow each other;
* prefix codes of the file's own counts, their lengths packed by codes of their own.

Cache and transform are those of least estimated size (entropy of the symbols plus headers, in
integers, so that equal texts give equal bytes). Files with a predictor, cross-colour or palette
are written by ``webp.encode``. They seldom pay on text; so that what is read back has every part
of the format, files of one row take the form in ``ONE_ROW`` that their checksum picks.

The decoder reads the prefix codes of all files in step and then walks their pixels in step. A
file that uses what this walk lacks (other transforms, larger caches, meta codes, longer codes)
goes to ``webp.decode``, which has all.

Defined results: null text is empty; every text has at least one row; a text of any length is
files of at most ``ROWS`` rows; repeated rows repeat, and ties do not arise; the query ignores
further columns of any name; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import webp
from millrace.llm import words as W
from millrace.llm.arrow import map_batches

WIDTH = 64
UNIT = 3 * WIDTH
ROWS = 64
#: Stored values that are read in step.
READ_ROWS = 3000
#: Longest prefix code of a file and of its code lengths (the format's own limit there).
DEPTH, LENGTH_DEPTH = 11, 7
#: Shortest back-reference; bits of the colour caches that are tried.
MATCH = 3
CACHES = (0, 5, 8)
#: Blocks of transforms are 8 by 8 pixels.
BLOCK = 3
#: Cross-colour multipliers that are tried, in 1/32.
MULTIPLIERS = (0, *(s * k for k in range(8, 72, 8) for s in (1, -1)))
#: Transforms that are tried; the first two are written here, the others by ``webp.encode``.
FORMS = ((), (webp.GREEN,), (webp.PREDICTOR,), (webp.GREEN, webp.PREDICTOR), (webp.CROSS,), (webp.PALETTE,))
#: How files of one row are written: options of ``webp.encode``, or None for no transform.
ONE_ROW = (None, {"cache": 4}, {"transforms": (webp.PALETTE,)}, {"transforms": (webp.PREDICTOR,)}, {"transforms": (webp.CROSS,)}, {"transforms": (webp.CROSS, webp.GREEN, webp.PREDICTOR), "cache": 2})

ALPHABETS = (280, 256, 256, 256, 40)
_PIXELS = WIDTH * ROWS
#: 256 * n * log2(n), in integers
_N_LOG = np.rint(256 * np.arange(_PIXELS + 1) * np.log2(np.maximum(np.arange(_PIXELS + 1), 1))).astype(np.int64)
_HEAD = 256 * 5  # what a used symbol costs in the header
_PREFIX = np.array([(0, 0, 0), *(webp.prefix_of(v) for v in range(1, _PIXELS + 121))], np.int64)
_NEAR = np.arange(_PIXELS + 1) + 120
for _i, (_x, _y) in reversed(list(enumerate(webp.NEAR))):
    _NEAR[max(1, _x + _y * WIDTH)] = _i + 1
_FAR = np.array([0, *(max(1, x + y * WIDTH) for x, y in webp.NEAR)], np.int64)


def _reversals(bits: int) -> np.ndarray:
    v = np.arange(1 << bits)
    return sum((v >> k & 1) << (bits - 1 - k) for k in range(bits))


_REVERSED = {d: _reversals(d) for d in (DEPTH, LENGTH_DEPTH)}


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded payload, bytes of the text)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


# --- prefix codes of many files -------------------------------------------------------


def huffman_rows(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of every row of symbol counts; as ``webp.huffman`` flattens weights until the depth fits."""
    out = np.zeros(counts.shape, np.int64)
    row, symbol = np.nonzero(counts)
    n = np.bincount(row, minlength=len(counts))
    todo = np.flatnonzero(n > 1)
    single = n[row] == 1
    out[row[single], symbol[single]] = 1
    floor = 1
    while len(todo):
        todo = todo[np.argsort(-n[todo], kind="stable")]  # the rows still at work come first
        place = np.full(len(counts), -1)
        place[todo] = np.arange(len(todo))
        mine = place[row] >= 0
        r, s = place[row[mine]], symbol[mine]
        w = np.maximum(counts[row[mine], s], floor)
        order = np.lexsort((s, w, r))
        r, s, w = r[order], s[order], w[order]
        size = n[todo]
        m = int(size[0])
        at = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
        weight = np.full((len(todo), 2 * m + 1), 1 << 40, np.int64)  # leaves, then inner nodes, by rising weight
        weight[r, at] = w
        up = np.zeros((len(todo), 2 * m), np.int64)
        leaf, inner = np.zeros(len(todo), np.int64), np.full(len(todo), m)
        leaf_end = size.copy()
        live = np.searchsorted(-size, -np.arange(2, m + 1), side="right")
        index = np.arange(len(todo))
        for k in range(m - 1):
            rows = index[: live[k]]
            total = 0
            for _ in (0, 1):
                a, b = leaf[: live[k]], inner[: live[k]]
                wa = np.where(a < leaf_end[: live[k]], weight[rows, a], 1 << 41)
                wb = weight[rows, b]
                is_leaf = wa <= wb
                up[rows, np.where(is_leaf, a, b)] = k
                total = total + np.where(is_leaf, wa, wb)
                a += is_leaf
                b += ~is_leaf
            weight[: live[k], m + k] = total
        depth = np.zeros((len(todo), m), np.int64)
        for k in range(m - 3, -1, -1):
            rows = index[: live[k + 1]]  # those where node k is not the root
            depth[rows, k] = depth[rows, up[rows, m + k]] + 1
        length = depth[r, up[r, at]] + 1
        out[todo[r], s] = length
        todo = np.unique(todo[r[length > limit]])
        floor *= 2
    return out


def _canonical(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(row, symbol, length, share of the codes of ``bits`` bits) in order of the codes, and which rows are complete."""
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    size[np.bincount(row, minlength=len(lengths))[row] == 1] = 0  # a lone symbol
    order = np.argsort(row << 20 | size << 12 | symbol)
    row, symbol, size = row[order], symbol[order], size[order]
    span = np.where(size <= bits, 1 << np.maximum(bits - size, 0), 2 << bits)
    good = np.bincount(row, weights=span, minlength=len(lengths)) == 1 << bits
    if not good.all():
        keep = good[row]
        row, symbol, size, span = row[keep], symbol[keep], size[keep], span[keep]
    return row, symbol, size, span, good


def codes_of(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit-reversed codes, their lengths) of rows of code lengths up to ``bits``; a lone symbol has length 0."""
    row, symbol, size, span, _ = _canonical(lengths, bits)
    code, length = np.zeros(lengths.shape, np.uint64), np.zeros(lengths.shape, np.int64)
    code[row, symbol] = _REVERSED[bits][(np.cumsum(span) - span) & ((1 << bits) - 1)]
    length[row, symbol] = size
    return code, length


def tables_of(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(``symbol << 4 | length`` of every ``bits`` bits, the first bit read on top; which rows are complete codes)."""
    _, symbol, size, span, good = _canonical(lengths, bits)
    table = np.zeros((len(lengths), 1 << bits), np.uint16)
    table[good] = np.repeat((symbol << 4 | size).astype(np.uint16), span).reshape(-1, 1 << bits)
    return table, good


# --- encoder --------------------------------------------------------------------------


def one_row(rgb: np.ndarray) -> bytes | None:
    """The file of one row of 24-bit pixels in the form that its checksum picks; None for no transform."""
    mark = zlib.crc32(rgb.astype("<u4").tobytes())
    form = ONE_ROW[mark % len(ONE_ROW)]
    if form is None:
        return None
    mark //= len(ONE_ROW)
    px = (rgb.astype(np.int64) | 0xFF000000).tolist()
    return webp.encode(px, WIDTH, 1, bits=3, modes=[mark % 14, mark // 14 % 14], elements=[mark & 0xFFFFFF], **form)


def _before(key: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element with the same key of at most 40 bits, or -1."""
    bits = max(1, int(len(key)).bit_length())
    both = np.sort(key.astype(np.uint64) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    at = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    key = both >> np.uint64(bits)
    out = np.full(len(key), -1)
    same = key[1:] == key[:-1]
    out[at[1:][same]] = at[:-1][same]
    return out


def matches(px: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of back-references to the nearest earlier place of ``MATCH`` equal pixels."""
    n = len(px) - MATCH + 1
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    key = np.zeros(n, np.uint64)  # without the file, so that it doesn't matter what else is in the batch
    for k in range(MATCH):
        key = (key ^ px[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    old = _before(key >> np.uint64(24))
    at = np.flatnonzero((old >= 0) & (tile[:n] == tile[MATCH - 1 :]))
    src = old[at]
    ok = (tile[src] == tile[at]) & np.logical_and.reduce([px[src + k] == px[at + k] for k in range(MATCH)])
    at, src = at[ok], src[ok]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    far = at - src
    first = np.r_[True, (at[1:] != at[:-1] + 1) | (far[1:] != far[:-1]) | (tile[at[1:]] != tile[at[:-1]])]
    begin, last = at[first], at[np.r_[first[1:], True]]
    end = last + MATCH
    begin_free = np.maximum(begin, np.r_[0, end[:-1]])  # an earlier reference covers what it reaches
    size = end - begin_free
    keep = size >= MATCH
    return begin_free[keep], size[keep], far[first][keep]


def _counts(tile: np.ndarray, symbol: np.ndarray, n: int, alphabet: int) -> np.ndarray:
    return np.bincount(tile * alphabet + symbol, minlength=n * alphabet).reshape(n, alphabet)


def _size(counts: np.ndarray) -> np.ndarray:
    """Estimated size in 1/256 bits of each row's symbols and of their code."""
    return _N_LOG[counts.sum(1)] - _N_LOG[counts].sum(1) + _HEAD * (counts > 0).sum(1)


def _shifted(plane: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(plane)
    out.reshape(-1)[by:] = plane.reshape(-1)[:-by]
    return out


def _predictors(planes: np.ndarray):
    """The prediction of each mode for planes of bytes in rows of ``WIDTH``."""
    left, top, right, corner = (np.stack([_shifted(p, k) for p in planes]) for k in (1, WIDTH, WIDTH - 1, WIDTH + 1))
    mean = lambda a, b: (a & b) + ((a ^ b) >> 1)
    yield np.zeros_like(left)
    yield from (left, top, right, corner)
    yield mean(mean(left, right), top)
    yield from (mean(left, corner), mean(left, top), mean(corner, top), mean(top, right))
    yield mean(mean(left, corner), mean(top, right))
    gap = lambda a, b: _sum3(np.maximum(a, b) - np.minimum(a, b))
    yield np.where(gap(top, corner) < gap(left, corner), left, top)
    d = corner.astype(np.int16)
    yield np.clip(left.astype(np.int16) + top - d, 0, 255).astype(np.uint8)
    m = mean(left, top).astype(np.int16)
    d = m - d
    yield np.clip(m + (np.abs(d) >> 1) * np.sign(d), 0, 255).astype(np.uint8)


def _sum3(planes: np.ndarray) -> np.ndarray:
    out = planes[0].astype(np.uint16)
    for p in planes[1:]:
        out += p
    return out


class Bands:
    """Images in rows of ``WIDTH``, each filled up to whole blocks, and the best options of their blocks."""

    def __init__(self, sizes: np.ndarray):
        rows = sizes // WIDTH
        bands = (rows + (1 << BLOCK) - 1) >> BLOCK
        first = (np.cumsum(bands) - bands) << BLOCK
        self.row = np.repeat(first - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
        self.n = int(bands.sum()) << BLOCK
        self.first = first
        self.filled = np.setdiff1d(np.arange(self.n), self.row, assume_unique=True)
        self.blocks = bands * (WIDTH >> BLOCK)

    def planes(self, c: np.ndarray) -> np.ndarray:
        out = np.zeros((3, self.n, WIDTH), np.uint8)
        out[:, self.row] = c.reshape(3, -1, WIDTH)
        return out

    def pixels(self, planes: np.ndarray) -> np.ndarray:
        return planes[:, self.row].reshape(3, -1)

    def _best(self, tries, planes: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which try has the least residuals in each block, the residuals)."""
        side = 1 << BLOCK
        least = pick = out = None
        for k, residual in enumerate(tries):
            w = _sum3(np.minimum(residual, -residual))
            w[skip] = 0
            cost = np.add.reduce(w.reshape(-1, side, WIDTH), axis=1, dtype=np.uint16).reshape(-1, WIDTH // side, side).sum(-1)
            if out is None:
                least, pick, out = cost, np.zeros(cost.shape, np.int64), residual.copy()
                continue
            better = cost < least
            least[better], pick[better] = cost[better], k
            where = np.repeat(better, side, axis=1)[:, None, :]
            for have, new in zip(out, residual):
                np.copyto(have.reshape(-1, side, WIDTH), new.reshape(-1, side, WIDTH), where=where)
        return pick.reshape(-1), out

    def aligned(self, c: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Which of ``n`` images have red or blue that follow another channel inside blocks, so that cross-colour may pay."""
        side = 1 << BLOCK
        total = lambda v: np.add.reduce(v.reshape(-1, side, WIDTH), axis=1, dtype=np.int32).reshape(-1, side).sum(-1).astype(float)
        planes = [p.view(np.int8).astype(np.int16) for p in self.planes(c)]
        real = np.zeros((self.n, WIDTH), np.int16)
        real[self.row] = 1
        many, sums = np.maximum(total(real), 1), [total(p) for p in planes]
        of = lambda i, j: total(planes[i].astype(np.int32) * planes[j]) - sums[i] * sums[j] / many
        own = [of(k, k) for k in range(3)]
        told = lambda i, j: np.divide(of(i, j) ** 2, own[i], out=np.zeros(len(many)), where=own[i] > 0)
        image = lambda v: np.bincount(owner, weights=v, minlength=n)
        return (2 * image(told(1, 0)) > image(own[0])) | (2 * image(np.maximum(told(1, 2), told(0, 2))) > image(own[2]))

    def modes(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predictor mode of each block, residuals)."""
        planes = self.planes(c)
        left, top = (np.stack([_shifted(p, k) for p in planes]) for k in (1, WIDTH))
        left[:, :, 0] = 0
        row, column = (planes - left)[:, self.first], (planes - top)[:, :, 0]

        def tries():
            for p in _predictors(planes):
                residual = planes - p
                residual[:, :, 0] = column
                residual[:, self.first] = row
                yield residual

        pick, out = self._best(tries(), planes, self.filled)
        return pick, self.pixels(out)

    def elements(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cross-colour element of each block, residuals)."""
        red, green, blue = planes = self.planes(c)

        def search(target: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = by.view(np.int8).astype(np.int16)
            tries = (target[None] - (t * by >> 5).astype(np.uint8)[None] for t in MULTIPLIERS)
            pick, out = self._best(tries, planes, self.filled)
            return np.array(MULTIPLIERS)[pick] & 255, out[0]

        g2r, new_red = search(red, green)
        g2b, new_blue = search(blue, green)
        r2b, new_blue = search(new_blue, red)
        return r2b << 16 | g2b << 8 | g2r, self.pixels(np.stack([new_red, green, new_blue]))


def _length_code(file: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray, order: int) -> list[tuple]:
    """(file, order, value, bits) of what writes the rows of code lengths, each within its alphabet."""
    n = (lengths > 0).sum(1)
    simple = (n <= 2) & (lengths[:, 256:] == 0).all(1)
    first = np.argmax(lengths > 0, axis=1)
    second = lengths.shape[1] - 1 - np.argmax(lengths[:, ::-1] > 0, axis=1)
    value = 1 | (n == 2) << 1 | 1 << 2 | first << 3 | np.where(n == 2, second << 11, 0)
    parts = [(file[simple], np.full(simple.sum(), order), value[simple], np.where(n == 2, 19, 11)[simple])]
    if simple.all():
        return parts
    file, alphabet = file[~simple], alphabet[~simple]
    m = len(file)
    marked = np.zeros((m, lengths.shape[1] + 1), np.int64)
    marked[:, :-1] = lengths[~simple]
    marked[np.arange(m), alphabet] = -1  # the end
    row, column = np.nonzero(marked)
    length = marked[row, column]
    gap = column - np.r_[0, np.where(row[1:] == row[:-1], column[:-1] + 1, 0)]  # zeros before a length or the end
    whole, rest = gap // 138, gap % 138
    zeros = whole + np.where(rest >= 3, 1, rest)
    pieces = zeros + (length > 0)
    item = np.repeat(np.arange(len(row)), pieces)
    k = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    left = np.where(k < whole[item], 138, rest[item])
    symbol = np.where(k == zeros[item], length[item], np.where(left >= 11, 18, np.where(left >= 3, 17, 0)))
    extra = np.where(symbol == 18, left - 11, np.where(symbol == 17, left - 3, 0))
    more = np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))
    r = row[item]
    small = huffman_rows(_counts(r, symbol, m, 19), LENGTH_DEPTH)
    code, size = codes_of(small, LENGTH_DEPTH)
    value = sum(small[:, s] << 3 * i for i, s in enumerate(webp.ORDER))
    parts += [(file, np.full(m, order), np.full(m, 15 << 1), np.full(m, 5)), (file, np.full(m, order + 1), value, np.full(m, 57)), (file, np.full(m, order + 2), np.zeros(m, np.int64), np.full(m, 1))]
    parts.append((file[r], np.full(len(r), order + 3), code[r, symbol].astype(np.int64) | extra << size[r, symbol], size[r, symbol] + more))
    return parts


def _put(buffer: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
    """Sets values of at most 57 bits at rising bit positions."""
    w, off = pos >> 6, (pos & 63).astype(np.uint64)
    cut = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    buffer[w[cut]] |= np.bitwise_or.reduceat(value << off, cut)
    spill = np.where(off > 0, value >> (np.uint64(64) - np.maximum(off, 1)), np.uint64(0))
    buffer[w[cut] + 1] |= np.bitwise_or.reduceat(spill, cut)


def _greened(c: np.ndarray) -> np.ndarray:
    return np.stack([c[0] - c[1], c[1], c[2] - c[1]])


def _joined(c: np.ndarray) -> np.ndarray:
    return c[0].astype(np.uint32) << 16 | c[1].astype(np.uint32) << 8 | c[2]


def _slots(px: np.ndarray, cache) -> np.ndarray:
    """Places of 24-bit pixels, which are opaque, in a colour cache."""
    return ((px | np.uint32(0xFF000000)) * np.uint32(webp.HASH)) >> (np.uint32(32) - np.asarray(cache, np.uint32))


def _hits(px: np.ndarray, tile: np.ndarray, cache) -> np.ndarray:
    """Which pixels are in their file's colour cache, which holds the latest pixel of each place."""
    old = _before(tile << max(CACHES) | _slots(px, cache))
    return (old >= 0) & (px[old] == px)


def _smooth(c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which images differ clearly less from their left or upper neighbours than from their mean, so that predictors may pay."""
    begin = np.cumsum(sizes) - sizes
    total = lambda v: np.add.reduceat(v, begin, dtype=np.int64)
    own, left, top = (np.zeros(len(sizes), np.int64) for _ in range(3))
    row = (begin[:, None] + np.arange(WIDTH)).reshape(-1)  # first rows have no upper neighbours
    for p in c:
        v = p.view(np.int8)
        middle = (total(v) // sizes).astype(np.int8)
        for out, other, edge in ((own, np.repeat(middle, sizes), row[:0]), (left, np.r_[v[:1], v[:-1]], begin), (top, np.r_[v[:WIDTH], v[:-WIDTH]], row)):
            d = (v - other).view(np.uint8)
            d[edge] = 0
            out += total(np.minimum(d, -d))
    return (5 * np.minimum(left, top) < 4 * own) & (sizes > WIDTH)


def encode_tiles(rgb: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """VP8L payloads of images of ``sizes`` pixels (three planes), each in the form of least estimated size."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    tile = np.repeat(np.arange(n), sizes)
    bands = Bands(sizes)
    blocks = bands.blocks
    block0 = np.cumsum(blocks) - blocks
    place, size, far = matches(_joined(rgb), tile)
    cover = np.zeros(len(tile) + 1, np.int64)
    cover[place] += 1
    cover[place + size] -= 1
    is_lit = np.cumsum(cover[:-1]) == 0
    lit = np.flatnonzero(is_lit)
    length_code, far_code = _PREFIX[size], _PREFIX[_NEAR[far]]
    length_counts, far_counts = _counts(tile[place], length_code[:, 0], n, 24), _counts(tile[place], far_code[:, 0], n, 40)
    copies = _size(far_counts) + 256 * np.bincount(tile[place], weights=length_code[:, 1] + far_code[:, 1], minlength=n).astype(np.int64)
    # every form's estimated size
    kinds = [*((f, k) for f in FORMS[:2] for k in CACHES), *((f, 0) for f in FORMS[2:])]
    cost = np.full((len(kinds), n), 1 << 60)
    forms = {(): rgb, (webp.GREEN,): _greened(rgb)}

    def direct(form: tuple, cache: int, which: np.ndarray) -> None:
        on = slice(None) if which.all() else which[tile]
        c, t, at = forms[form][:, on], tile[on], np.flatnonzero(is_lit[on])
        hit = _hits(_joined(c), t, cache)[at] if cache else None
        red, green, blue = (np.bincount(v, minlength=n << 8).reshape(n, 256) for v in (t[at] << 8 | c[:, at] if hit is None else t[at[~hit]] << 8 | c[:, at[~hit]]))
        green = [green, length_counts]
        if cache:
            green.append(_counts(t[at[hit]], _slots(_joined(c[:, at[hit]]), cache).astype(np.int64), n, 1 << cache))
        size = copies + _size(np.concatenate(green, 1)) + _size(red) + _size(blue)
        cost[kinds.index((form, cache)), which] = size[which]

    every = np.ones(n, bool)
    for cache in CACHES:
        direct((), cache, every)
    direct((webp.GREEN,), 0, every)
    near = 20 * cost[kinds.index(((webp.GREEN,), 0))] < 21 * cost[kinds.index(((), 0))]  # a cache finds alike in both
    for cache in CACHES[1:]:
        if near.any():
            direct((webp.GREEN,), cache, near)
    given = {}
    smooth = _smooth(rgb, sizes) | _smooth(forms[webp.GREEN,], sizes)
    for which, some in ((smooth, FORMS[2:4]), (bands.aligned(rgb, np.repeat(np.arange(n), blocks), n), FORMS[4:5])):
        if not which.any():
            continue
        on, mine = which[tile], np.repeat(which, blocks)
        part, row, owner = Bands(sizes[which]), tile[on] << 8, np.repeat(np.arange(n), blocks)[mine]
        for form in some:
            values, residual = part.elements(rgb[:, on]) if form == (webp.CROSS,) else part.modes(forms[form[:-1]][:, on])
            size = sum(_size(np.bincount(row | v, minlength=n << 8).reshape(n, 256)) for v in residual)
            size += sum(_size(_counts(owner, values >> k & 255, n, 256)) for k in ((0, 8, 16) if form == (webp.CROSS,) else (0,)))
            cost[kinds.index((form, 0)), which] = size[which]
            whole = np.zeros(len(mine), np.int64)
            whole[mine] = values
            given[form] = {"elements" if form == (webp.CROSS,) else "modes": whole}
    colour = np.sort(tile[lit].astype(np.uint64) << np.uint64(24) | _joined(rgb[:, lit]))
    first = np.flatnonzero(np.r_[True, colour[1:] != colour[:-1]])
    owner, many = (colour[first] >> np.uint64(24)).astype(np.int64), np.diff(np.r_[first, len(colour)])
    held = np.bincount(owner, minlength=n)
    table = 256 * 24 * held + _HEAD * held
    index = _N_LOG[np.bincount(owner, weights=many, minlength=n).astype(np.int64)] - np.bincount(owner, weights=_N_LOG[many], minlength=n).astype(np.int64)
    cost[-1] = np.where(held <= 256, copies + _size(length_counts) + table + index, 1 << 60)
    cost[np.ix_([bool(k[0]) for k in kinds], sizes == WIDTH)] = 1 << 60  # the form of one row is picked
    pick = np.argmin(cost, axis=0)
    # the forms that are written here
    here = np.array([k[0] in forms for k in kinds])[pick]
    cache = np.array([k[1] for k in kinds])[pick]
    greened = np.array([k[0] == (webp.GREEN,) for k in kinds])[pick]
    c = np.where(greened[tile], forms[webp.GREEN,], rgb) if greened.any() else rgb
    px = _joined(c)
    hit = _hits(px, tile, cache[tile]) & (cache > 0)[tile]
    begins = np.zeros(len(px), bool)
    begins[place] = True
    token = np.flatnonzero(is_lit | begins)
    is_copy = begins[token]
    mine = here[tile[token]]
    copied = here[tile[place]]
    token, is_copy = token[mine], is_copy[mine]
    length_code, far_code = length_code[copied], far_code[copied]
    t = tile[token]
    is_hit = hit[token] & ~is_copy
    literal = ~is_copy & ~is_hit
    g = c[1, token].astype(np.int64)
    g[is_copy] = 256 + length_code[:, 0]
    g[is_hit] = 280 + _slots(px[token[is_hit]], cache[t[is_hit]])
    r, b = c[0, token], c[2, token]
    wide = 280 + (1 << max(CACHES))
    lengths = [
        huffman_rows(_counts(t, g, n, wide), DEPTH),
        *np.split(huffman_rows(np.concatenate([_counts(t[literal], v[literal], n, 256) for v in (r, b)]), DEPTH), 2),
        huffman_rows(_counts(t[is_copy], far_code[:, 0], n, 40), DEPTH),
    ]
    (gc, gl), (rc, rl), (bc, bl), (dc, dl) = (codes_of(x, DEPTH) for x in lengths)
    value, bits = gc[t, g], gl[t, g]
    v = t[literal]
    i, j = r[literal], b[literal]
    value[literal] |= rc[v, i] << bits[literal].astype(np.uint64) | bc[v, j] << (bits[literal] + rl[v, i]).astype(np.uint64)
    bits[literal] += rl[v, i] + bl[v, j]
    v, s, u = t[is_copy], far_code[:, 0], bits[is_copy]
    more = length_code[:, 2] | dc[v, s].astype(np.int64) << length_code[:, 1] | far_code[:, 2] << (length_code[:, 1] + dl[v, s])
    value[is_copy] |= more.astype(np.uint64) << u.astype(np.uint64)
    bits[is_copy] += length_code[:, 1] + dl[v, s] + far_code[:, 1]
    # headers
    file = np.flatnonzero(here)
    head = 0x2F | (WIDTH - 1) << 8 | (sizes[file] // WIDTH - 1) << 22 | np.where(greened[file], 5 << 40, 0)
    used = np.where(greened[file], 44, 41)
    head |= np.where(cache[file] > 0, 1 | cache[file] << 1, 0) << used
    parts = [(file, np.zeros(len(file), np.int64), head, used + np.where(cache[file] > 0, 6, 2))]
    alphabet = 280 + np.where(cache[file] > 0, 1 << cache[file], 0)
    for k, x in enumerate(lengths):
        parts += _length_code(file, x[file], alphabet if k == 0 else np.full(len(file), ALPHABETS[(0, 1, 2, 4)[k]]), (10, 20, 30, 50)[k])
    parts.append((file, np.full(len(file), 40), np.full(len(file), 1 | 1 << 2 | 255 << 3), np.full(len(file), 11)))  # alpha is 255
    who, order, head, many = (np.concatenate(p).astype(np.int64) for p in zip(*parts))
    sort = np.argsort(who << 8 | order, kind="stable")
    who, head, many = who[sort], head[sort], many[sort]
    head_bits = np.bincount(who, weights=many, minlength=n).astype(np.int64)
    total = head_bits + np.bincount(t, weights=bits, minlength=n).astype(np.int64)
    words = (total + 63) // 64 + 1
    word0 = np.cumsum(words) - words
    buffer = np.zeros(int(words.sum()) + 1, np.uint64)
    for owner, v, m, skip in ((who, head.astype(np.uint64), many, np.zeros(n, np.int64)), (t, value, bits, head_bits)):
        if len(owner):
            run = np.cumsum(m) - m
            begin = run[np.minimum(np.searchsorted(owner, np.arange(n)), len(run) - 1)]
            _put(buffer, (word0 * 64 + skip - begin)[owner] + run, v)
    raw = buffer.view(np.uint8)
    out = []
    for k in range(n):
        if here[k]:
            out.append(raw[8 * word0[k] : 8 * word0[k] + (total[k] + 7) // 8].tobytes())
            continue
        form = kinds[pick[k]][0]
        options = {name: v[block0[k] : block0[k] + blocks[k]].tolist() for name, v in given.get(form, {}).items()}
        whole = _joined(rgb[:, ends[k] - sizes[k] : ends[k]]).astype(np.int64) | 0xFF000000
        out.append(webp.encode(whole.tolist(), WIDTH, int(sizes[k]) // WIDTH, transforms=form, bits=BLOCK, **options))
    return out


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    if not payloads:
        return []
    px = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3).T.copy()
    each = [[min(ROWS, len(p) // UNIT - k) * WIDTH for k in range(0, len(p) // UNIT, ROWS)] for p in payloads]
    sizes = np.array([n for e in each for n in e], np.int64)
    ends = np.cumsum(sizes)
    files = [one_row(_joined(px[:, e - n : e])) if n == WIDTH else None for n, e in zip(sizes.tolist(), ends.tolist())]
    rest = np.array([f is None for f in files])
    if rest.any():
        made = iter(encode_tiles(px[:, np.repeat(rest, sizes)], sizes[rest]))
        files = [next(made) if f is None else f for f in files]
    cuts = np.cumsum([0] + [len(e) for e in each])
    return [b"".join(map(webp.wrap, files[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


# --- decoder --------------------------------------------------------------------------


def _window(view: np.ndarray, bp: np.ndarray) -> np.ndarray:
    """The 57 bits, at least, from each bit position."""
    return (view[bp >> 3] >> (bp & 7).astype(np.uint64)).view(np.int64)


def _read_lengths(view: np.ndarray, bp: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code lengths, next bit position, which rows could be read) of a prefix code of each file."""
    n = len(bp)
    out, ok, bp = np.zeros((n, max(256, int(alphabet.max()))), np.int64), np.ones(n, bool), bp.copy()
    w = _window(view, bp)
    row = np.flatnonzero(w & 1)
    v = w[row]
    two, wide = v >> 1 & 1, v >> 2 & 1
    first, used = v >> 3 & np.where(wide, 255, 1), 4 + 7 * wide
    second = np.where(two, v >> used & 255, first)
    out[row, first] = out[row, second] = 1
    ok[row] = np.maximum(first, second) < alphabet[row]
    bp[row] += used + 8 * two
    row = np.flatnonzero(~w & 1)
    if not len(row):
        return out, bp, ok
    many = 4 + (w[row] >> 1 & 15)
    v = _window(view, bp[row] + 5)
    small = np.zeros((len(row), 19), np.int64)
    for i, s in enumerate(webp.ORDER):
        small[:, s] = np.where(i < many, v >> 3 * i & 7, 0)
    table, good = tables_of(small, LENGTH_DEPTH)
    at_bit = bp[row] + 5 + 3 * many
    v = _window(view, at_bit)
    given, size = v & 1, 2 + 2 * (v >> 1 & 7)
    left = np.where(given, 2 + (v >> 4 & (1 << size) - 1), 1 << 20)
    at_bit += np.where(given, 4 + size, 1)
    at, before, top = np.zeros(len(row), np.int64), np.full(len(row), 8), alphabet[row]
    live = np.flatnonzero(good & (left > 0))
    extra, least = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])
    while len(live):
        v = _window(view, at_bit[live])
        e = table[live, _REVERSED[LENGTH_DEPTH][v & 127]].astype(np.int64)
        s, used = e >> 4, e & 15
        step = least[s] + (v >> used & (1 << extra[s]) - 1)
        a = at[live]
        good[live] &= a + step <= top[live]
        one = good[live] & (s < 16)
        out[row[live[one]], a[one]] = s[one]
        before[live[one & (s > 0)]] = s[one & (s > 0)]
        for k in np.flatnonzero(good[live] & (s == 16)).tolist():
            out[row[live[k]], a[k] : a[k] + step[k]] = before[live[k]]
        at[live] += step
        at_bit[live] += used + extra[s]
        left[live] -= 1
        live = live[good[live] & (at[live] < top[live]) & (left[live] > 0)]
    ok[row], bp[row] = good, at_bit
    return out, bp, ok


def _walk(files: list[bytes], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(24-bit pixels of all files, one after the other, which files could be read)."""
    start = np.cumsum([0] + [len(f) for f in files[:-1]], dtype=np.int64)
    joined = b"".join(files) + bytes(1 << 12)
    view = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    n = len(files)
    bp = start * 8 + 40
    w = _window(view, bp)
    greened = (w & 7) == 1 | webp.GREEN << 1
    bp += 3 * greened
    w = _window(view, bp)
    cached = w >> 1 & 1
    cache = np.where(cached, w >> 2 & 15, 0)
    ok = (w & 1 == 0) & (cache <= max(CACHES)) & (cached == (cache > 0)) & (w >> np.where(cached, 6, 2) & 1 == 0)
    bp += np.where(cached, 7, 3)
    cache = np.where(ok, cache, 0)
    tables = []
    for k, size in enumerate(ALPHABETS):
        alphabet = size + (np.where(cache > 0, 1 << cache, 0) if k == 0 else np.zeros(n, np.int64))
        bp = np.where(ok, bp, start * 8)
        lengths, bp, good = _read_lengths(view, bp, alphabet)
        ok &= good
        if k == 3:
            ok &= (lengths > 0).sum(1) == 1
            ok &= lengths[:, 255] > 0
            continue
        table, good = tables_of(lengths, DEPTH)
        empty = ~lengths.any(1)  # no symbol: the first
        ok &= good | empty
        tables.append(table.reshape(-1))
    green, red, blue, far = tables
    out = np.zeros(int(count.sum()), np.uint32)
    o = np.cumsum(count) - count
    begin, end = o.copy(), o + count
    live = np.flatnonzero(ok)
    live = live[np.argsort(-count[live], kind="stable")]
    o, begin, end, bp, base, shift = o[live], begin[live], end[live], bp[live], live << DEPTH, 32 - cache[live]
    wide = 1 << max(CACHES)
    recent = np.zeros(n * wide, np.uint32)
    slot0 = live * wide
    mask, turn = np.int64((1 << DEPTH) - 1), _REVERSED[DEPTH]
    caches = bool(cache[live].any())
    with np.errstate(over="ignore"):
        while len(o):
            w = _window(view, bp)
            e = green[base + turn[w & mask]].astype(np.int64)
            used, g = e & 15, e >> 4
            w >>= used
            r = red[base + turn[w & mask]]
            m = r & 15
            b = blue[base + turn[w >> m & mask]]
            px = (r >> 4).astype(np.uint32) << 16 | g.astype(np.uint32) << 8 | b >> 4
            n_bits = used + m + (b & 15)
            other = g > 255
            if (some := other.any()):
                hit = np.flatnonzero(other)
                sym = g[hit]
                if caches and (of_cache := sym >= 280).any():
                    found = hit[of_cache]
                    px[found] = recent[slot0[found] + sym[of_cache] - 280]
                    n_bits[found] = used[found]
                    hit = hit[~of_cache]
            if some and len(hit):
                sym, v = g[hit] - 256, w[hit]
                extra = np.where(sym > 3, (sym - 2) >> 1, 0)
                size = np.where(sym < 4, sym, ((2 + (sym & 1)) << extra) + (v & (1 << extra) - 1)) + 1
                v >>= extra
                e = far[base[hit] + turn[v & mask]].astype(np.int64)
                sym = e >> 4
                v >>= e & 15
                more = np.where(sym > 3, (sym - 2) >> 1, 0)
                d = np.where(sym < 4, sym, ((2 + (sym & 1)) << more) + (v & (1 << more) - 1)) + 1
                d = np.where(d > 120, d - 120, _FAR[np.minimum(d, 120)])
                n_bits[hit] = used[hit] + extra + (e & 15) + more
                if (d > o[hit] - begin[hit]).any() or (size > end[hit] - o[hit]).any():
                    raise webp.FormatError("back-reference outside the image")
                for i, k, far_back in zip(hit.tolist(), size.tolist(), d.tolist()):
                    a = int(o[i])
                    new = out[a - far_back : a - far_back + k] if far_back >= k else np.resize(out[a - far_back : a], k)
                    out[a : a + k] = new
                    if shift[i] < 32:
                        recent[slot0[i] + _slots(new, 32 - shift[i])] = new  # of equal places the last one stays
                    o[i] += k - 1
                px[hit] = out[o[hit]]
            out[o] = px
            if caches:
                place = np.where(shift < 32, ((px | np.uint32(0xFF000000)) * np.uint32(webp.HASH)).astype(np.int64) >> shift, 0)
                recent[slot0 + place] = px
            o += 1
            bp += n_bits
            if (done := o >= end).any():
                keep = ~done
                o, begin, end, bp, base, shift, slot0 = (a[keep] for a in (o, begin, end, bp, base, shift, slot0))
    turned = np.repeat(greened & ok, count)
    if turned.any():
        p = out[turned]
        g = p >> 8 & 255
        out[turned] = ((p >> 16) + g & 255) << 16 | g << 8 | p + g & 255
    return out, ok


def decode_batch(media: list[bytes]) -> list[np.ndarray]:
    """(rows, 64, 3) uint8 pixel array of each stored value."""
    if not media:
        return []
    files = [webp.split(m) for m in media]
    flat = [f for fs in files for f in fs]
    shape = [webp.dimensions(f) for f in flat]
    walked = [i for i, (w, _) in enumerate(shape) if w == WIDTH]  # near distances depend on the width
    px: list[np.ndarray] = [None] * len(flat)  # type: ignore[list-item]
    if walked:
        count = np.array([shape[i][0] * shape[i][1] for i in walked], np.int64)
        got, ok = _walk([flat[i] for i in walked], count)
        cut = np.r_[0, np.cumsum(count)]
        for k, i in enumerate(walked):
            if ok[k]:
                px[i] = got[cut[k] : cut[k + 1]]
    for i, f in enumerate(flat):
        if px[i] is None:
            px[i] = webp.decode(f)[2].astype(np.int64)
    out, at = [], 0
    for fs in files:
        p = np.concatenate(px[at : at + len(fs)])
        rgb = np.stack([p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype(np.uint8)
        out.append(rgb.reshape(-1, shape[at][0], 3))
        at += len(fs)
    return out


def features(pixels: np.ndarray) -> str:
    """Rows, channel sums and the number of horizontal edges."""
    sums = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    edges = int((pixels[:, 1:] != pixels[:, :-1]).any(axis=-1).sum())
    return f"rows={len(pixels)};rgb={sums[0]},{sums[1]},{sums[2]};edges={edges}"


# --- on Spark -------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as stored lossless WebP."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload_of(t) for t in batch.column("text").to_pylist()]
        media = encode_batch([p for p, _ in made])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of the pixel arrays that the stored bytes hold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = batch.column("media").to_pylist()
        rows = []
        for m, px in zip(media, decode_batch(media)):
            raw = px.tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(px)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(stored, run, schema, READ_ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(W.documents(spark, sf_dir, "doc_id", "text")))
