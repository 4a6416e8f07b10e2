import base64
import hashlib
import zlib

import numpy as np
import pytest

from arcspan.llm import webp


def images():
    rng = np.random.default_rng(3)
    yield rng.integers(0, 2**32, (9, 13), dtype=np.uint32)
    yield rng.choice(rng.integers(0, 2**32, 5, dtype=np.uint32), (20, 33))
    yield np.cumsum(rng.integers(0, 3, (17, 31)), axis=1).astype(np.uint32) * np.uint32(0x01010101)
    yield np.full((1, 1), 7, dtype=np.uint32)
    yield np.tile(rng.integers(0, 2**32, (1, 16), dtype=np.uint32), (40, 1))


def blocks(image, bits, top, rng):
    return rng.integers(0, top, (webp._blocks(image.shape[0], bits), webp._blocks(image.shape[1], bits))).astype(np.uint32)


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("copies", [False, True])
def test_every_feature_round_trips(cache_bits, copies):
    rng = np.random.default_rng(5)
    for image in images():
        modes, factors = blocks(image, 2, 14, rng) << np.uint32(8), blocks(image, 3, 2**24, rng)
        cases = [[], [(webp.SUBTRACT_GREEN,)], [(webp.PREDICTOR, modes, 2)], [(webp.CROSS_COLOUR, factors, 3)], [(webp.PREDICTOR, modes, 2), (webp.CROSS_COLOUR, factors, 3), (webp.SUBTRACT_GREEN,)]]
        if len(np.unique(image)) <= 256:
            cases.append([(webp.PALETTE,)])
        for transforms in cases:
            data = webp.encode(image, transforms, cache_bits, copies)
            assert (webp.decode(data) == image).all()
            assert (webp.decode_batch([data])[0] == image).all()


def test_predictors_as_defined():
    left, top, corner, right = [10, 20, 30, 250], [12, 18, 33, 200], [9, 25, 31, 240], [100, 0, 5, 7]
    assert webp._predicted(0, left, top, corner, right) == [255, 0, 0, 0]
    assert [webp._predicted(k, left, top, corner, right) for k in (1, 2, 3, 4)] == [left, top, right, corner]
    assert webp._predicted(7, left, top, corner, right) == [11, 19, 31, 225]
    assert webp._predicted(12, left, top, corner, right) == [13, 13, 32, 210]
    assert webp._predicted(13, left, top, corner, right) == [12, 16, 31, 218]


def test_payloads_both_ways():
    rng = np.random.default_rng(1)
    assert {b.cache_bits for b in webp.books()} == {0, webp.CACHE_BITS}
    payloads = [webp.padded(x) for x in (b"", b"the cat and the dog " * 900, b"a", b"x" * 64, "Ein Text über Öl.\n".encode() * 50, bytes(rng.integers(0, 256, 200_000, dtype=np.uint8)), bytes(range(256)) * 3, b"\0" * webp.STRIP + b"z")]
    media = webp.encode_payloads(payloads)
    assert webp.decode_payloads(media) == payloads
    assert [len(webp.files(m)) for m in media] == [-(-len(p) // webp.STRIP) for p in payloads]
    for m in media:  # the step-wise reader and the general one agree
        for f in webp.files(m):
            assert (webp.decode(f) == webp.decode_batch([f])[0]).all()


def test_general_form_is_used_where_it_pays():
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    ramp = (np.arange(30000) * 3 // 64 % 200 + np.arange(30000) % 64).astype(np.uint8).tobytes()
    line = letters(64)
    payloads = [webp.padded(x) for x in (b"", letters(64) * 200, (letters(997) + b"\n") * 40, ramp, b"ab" * 5000, letters(3000), b"the quick brown fox " * 40)]
    payloads += [webp.padded(b"".join(bytes([(g + 3) & 255, g, (g + 7) & 255, rng.integers(4)]) for g in rng.integers(0, 256, 4000).tolist())), webp.padded(b"".join(bytes([(r + 1) & 255, 5, r, rng.integers(4)]) for r in rng.integers(0, 256, 4000).tolist()))]
    media = webp.encode_payloads(payloads)
    assert webp.decode_payloads(media) == payloads
    assert all(webp.encode_payloads([p]) == [m] for p, m in zip(payloads, media))  # whatever stands beside it
    assert len(media[1]) < 300 and len(media[2]) < len(payloads[2]) / 10 and len(line) == 64
    kinds = set()
    for m in media:
        bits = webp.Reader(webp._chunk(m), 40)
        kinds.add(bits.read(3) >> 1 if bits.peek(1) else None)
    assert {webp.PALETTE, webp.PREDICTOR, webp.SUBTRACT_GREEN, webp.CROSS_COLOUR} <= kinds and None in kinds


def by_hand(width, height, bits):
    """A file from bits as the format's description writes them: fields of ``(value, size)``, lowest bit first."""
    text = "".join(format(v, f"0{n}b")[::-1] if n else "" for v, n in [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), *bits])
    text += "0" * (-len(text) % 8)
    body = bytes(int(text[k : k + 8][::-1], 2) for k in range(0, len(text), 8))
    body_padded = body + b"\0" * (len(body) % 2)
    return b"RIFF" + (12 + len(body_padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body_padded


def simple(*symbols):
    """A simple code of one or two symbols of eight bits."""
    return [(1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)]


def test_files_made_by_hand():
    # a file in wide use to see whether a browser reads lossless images: one transparent black pixel
    known = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(known).tolist() == [[0]]
    # no transform, no cache, no groups; green is 10 or 200, red 1, blue 2, alpha 255
    plain = [(0, 1), (0, 1), (0, 1), *simple(10, 200), *simple(1), *simple(2), *simple(255), *simple(0), (0, 1), (1, 1), (1, 1), (0, 1)]
    assert webp.decode(by_hand(2, 2, plain)).tolist() == [[0xFF010A02, 0xFF01C802], [0xFF01C802, 0xFF010A02]]
    # subtract-green: 10 and 200 are added to red 1 and blue 2
    green = [(1, 1), (2, 2), *plain]
    assert webp.decode(by_hand(2, 2, green)).tolist() == [[0xFF0B0A0C, 0xFFC9C8CA], [0xFFC9C8CA, 0xFF0B0A0C]]
    # one predictor (2: top) for all: the first pixel adds to opaque black, its row to the left, the others to the top
    top = [(1, 1), (0, 2), (0, 3), (0, 1), *simple(2), *simple(0), *simple(0), *simple(255), *simple(0), *plain]
    assert webp.decode(by_hand(2, 2, top)).tolist() == [[0xFE010A02, 0xFD02D204], [0xFD02D204, 0xFC03DC06]]
    # a palette of two colours, eight pixels in one: 0xFF000000 and, 0x00FF0000 further, 0xFFFF0000; indices 0, 1, 1
    palette = [(1, 1), (3, 2), (1, 8), (0, 1), *simple(0), *simple(0, 255), *simple(0), *simple(0, 255), *simple(0), (0, 1), (1, 1), (1, 1), (0, 1)]
    assert webp.decode(by_hand(3, 1, [*palette, (0, 1), (0, 1), (0, 1), *simple(6), *simple(0), *simple(0), *simple(255), *simple(0)])).tolist() == [[0xFF000000, 0xFFFF0000, 0xFFFF0000]]


def test_mixed_batches():
    rng = np.random.default_rng(2)
    general = [webp.encode(i, cache_bits=4, copies=True) for i in images()]
    plain = webp.encode_payloads([webp.padded(bytes(rng.integers(97, 120, n, dtype=np.uint8))) for n in (10, 500, 3000)])
    order = [general[0], plain[2], general[1], plain[0], general[2], plain[1]]
    assert all((a == webp.decode(f)).all() for a, f in zip(webp.decode_batch(order), order))


def test_broken_files():
    good = webp.encode_payloads([webp.padded(b"some text " * 40)])[0]
    cut = good[:16] + (40).to_bytes(4, "little") + good[20:60]
    for bad in (b"RIFF", cut, good.replace(b"VP8L", b"VP8X")):
        with pytest.raises(webp.BadImage):
            webp.decode(bad)
    with pytest.raises(webp.BadImage):
        webp.decode_batch([cut])


def test_documents(odd, empty, odd_rows):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in webp.digests(odd).collect()}
    want = set()
    for k, t, *_ in odd_rows:
        p = webp.padded((t or "").encode())
        want.add((k, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == want
    assert webp.digests(empty).collect() == []
    back = webp.with_pixels(webp.with_media(odd)).collect()
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in back) == sorted(hashlib.sha256(webp.padded((r[1] or "").encode())).hexdigest() for r in odd_rows)
