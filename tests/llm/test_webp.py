import base64
import random

import numpy as np
import pytest

from millrace.llm import media, webp


def image(w, h, colours=None, seed=0):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 1 << 32, colours)
        return table[rng.integers(0, colours, w * h)].tolist()
    base = np.cumsum(rng.integers(-3, 4, (h * w, 4)), axis=0) & 255
    base[rng.random(h * w) < 0.3] = base[0]
    return webp._joined(base).tolist()


CASES = [
    {},
    {"cache": 6},
    {"transforms": (webp.GREEN,)},
    {"transforms": (webp.CROSS,), "elements": [0x00102030, 0x00FF80C0]},
    {"transforms": (webp.CROSS, webp.GREEN, webp.PREDICTOR), "elements": [0x00112233], "modes": [11], "cache": 3},
    *({"transforms": (webp.PREDICTOR,), "modes": [m]} for m in range(14)),
]


@pytest.mark.parametrize("options", CASES)
@pytest.mark.parametrize("size", [(1, 1), (13, 9), (64, 5)])
def test_round_trip(options, size):
    px = image(*size)
    w, h, back = webp.decode(webp.encode(px, *size, **options))
    assert (w, h) == size and back.tolist() == px


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette_round_trip(colours):
    px = image(21, 11, colours)
    assert webp.decode(webp.encode(px, 21, 11, transforms=(webp.PALETTE,)))[2].tolist() == px


def test_near_distances():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


def test_containers_split():
    a, b = webp.encode([1], 1, 1), webp.encode([2, 3], 2, 1)
    assert webp.split(webp.wrap(a) + webp.wrap(b)) == [a, b]
    with pytest.raises(webp.FormatError):
        webp.split(b"RIFX" + webp.wrap(a)[4:])


def test_foreign_files():
    """Two files of another encoder, long used in browser tests: one transparent and one white pixel."""
    for text, pixel in (("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", 0), ("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", 0xFFFFFFFF)):
        (file,) = webp.split(base64.b64decode(text))
        assert webp.decode(file)[:2] == (1, 1) and webp.decode(file)[2].tolist() == [pixel]


def test_short_texts_use_the_whole_format():
    """Short texts are stored in every form, and all come back."""
    rng = random.Random(2)
    texts = ["", "a", *("".join(rng.choice("abcde \nÄ") for _ in range(rng.randint(0, 150))) for _ in range(300)), "long " * 4000]
    payloads = [media.payload_of(t)[0] for t in texts]
    stored = media.encode_batch(payloads)
    assert [p.tobytes() for p in media.decode_batch(stored)] == payloads
    assert media.encode_batch(payloads[::-1]) == stored[::-1]
    first, cached = set(), 0
    for f in (f for m in stored for f in webp.split(m)):
        r = webp.Reader(f, 40)
        if r.take(1):
            first.add(r.take(2))
        else:
            cached += r.take(1)
    assert first == {webp.PALETTE, webp.PREDICTOR, webp.CROSS} and cached > 20


def transforms(file):
    """The transforms of a file in the order in which they were applied."""
    r, out = webp.Reader(file, 40), []
    width, height = webp.dimensions(file)
    while r.take(1):
        out.append(r.take(2))
        if out[-1] in (webp.PREDICTOR, webp.CROSS):
            bits = r.take(3) + 2
            webp._read_image(r, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
        elif out[-1] == webp.PALETTE:
            webp._read_image(r, r.take(8) + 1, 1, False)
            break  # the width changes
    return out


def kind(file):
    """The transforms of a file, and the bits of its colour cache where it has no other than subtract green."""
    r, kinds = webp.Reader(file, 40), []
    while r.take(1):
        kinds.append(r.take(2))
        if kinds[-1] != webp.GREEN:
            return tuple(kinds), None
    return tuple(kinds), r.take(4) if r.take(1) else 0


def test_long_texts_use_the_whole_format():
    """Files of several rows have codes of their own and the transform and cache that make them small."""
    rng = np.random.default_rng(5)
    n = 64 * 24
    green = rng.integers(0, 256, n)
    signed = green.astype(np.uint8).view(np.int8).astype(np.int64)
    walk = np.cumsum(rng.integers(-2, 3, (24, 64, 3)), axis=1) + np.cumsum(rng.integers(-2, 3, (24, 1, 3)), axis=0)
    rough = walk + np.cumsum(rng.integers(-40, 41, (24, 64, 1)), axis=1)
    words = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8).reshape(-1, 3)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), k)) for k in rng.integers(2, 9, 300)]
    images = [
        rng.integers(0, 256, (n, 3)),
        np.repeat(green[:, None], 3, axis=1),
        walk,
        rough,
        np.stack([signed * 24 >> 5, green, signed * -40 >> 5], 1),
        words[rng.integers(0, 12, n)],
        np.tile(rng.integers(0, 256, (100, 3)), (16, 1))[:n],
        np.where(rng.random((n, 1)) < 0.6, rng.integers(0, 256, (60, 3))[rng.integers(0, 60, n)], rng.integers(0, 256, (n, 3))),
    ]
    payloads = [x.astype(np.uint8).tobytes() for x in images] + [" ".join(rng.choice(vocabulary, 3000)).encode()[: 192 * 40]]
    stored = media.encode_batch(payloads)
    assert [p.tobytes() for p in media.decode_batch(stored)] == payloads
    assert media.encode_batch(payloads[::-1]) == stored[::-1]
    assert [media.encode_batch([p])[0] for p in payloads] == stored
    files = [webp.split(m)[0] for m in stored]
    for f, p in zip(files, payloads):  # the general decoder reads the same
        px = np.frombuffer(p, np.uint8).reshape(-1, 3).astype(np.int64)
        assert webp.decode(f)[2].tolist() == (0xFF000000 | px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]).tolist()
    kinds = [kind(f) for f in files]
    assert [k[0][0] for k in kinds[1:6]] == [webp.GREEN, webp.PREDICTOR, webp.GREEN, webp.CROSS, webp.PALETTE]
    assert webp.PREDICTOR in transforms(files[3])
    assert any(k[1] for k in kinds)
    size = [len(m) / len(p) for m, p in zip(stored, payloads)]
    assert size[0] < 1.15 and max(size[1:3]) < 0.5 and size[4] < 0.5 and size[5] < 0.3 and size[6] < 0.15  # references reach 100 pixels back


def test_codes_of_many_files_are_those_of_one():
    rng = np.random.default_rng(1)
    counts = (rng.random((60, 300)) ** 8 * 2000).astype(np.int64) * (rng.random((60, 300)) < rng.random((60, 1)))
    counts[0], counts[1, :], counts[2] = 0, 0, np.r_[np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987]), np.zeros(284)]
    counts[1, 7] = 5
    lengths = media.huffman_rows(counts, 11)
    used = counts > 0
    assert ((lengths > 0) == used).all() and lengths.max() <= 11
    for c, got in zip(counts, lengths):
        want = webp.huffman(c.tolist(), 11)
        assert int((c * got).sum()) == int((c * want).sum())
        if (c > 0).sum() > 1:
            assert sum(2.0 ** -k for k in got[got > 0]) == 1
            code, size = media.codes_of(got[None], 11)
            assert list(zip(code[0].tolist(), size[0].tolist())) == webp.canonical(got.tolist())
