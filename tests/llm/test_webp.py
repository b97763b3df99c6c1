import hashlib
import zlib

import numpy as np
import pytest

from segmenta.llm import webp as W

rng = np.random.default_rng(0)


def image(h, w, k):
    return rng.choice(rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32), (h, w))


def test_distance_map():
    assert len(W.NEAR) == 120 and W.NEAR[:5] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2)] and W.NEAR[-2:] == [(8, 6), (8, 7)]


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (13, 17), (40, 33)])
@pytest.mark.parametrize("colours", [1, 2, 3, 7, 17, 200, 100000])
def test_round_trips(shape, colours):
    im = image(*shape, colours)
    tiles = -(-shape[0] >> 2), -(-shape[1] >> 2)
    ok = lambda **k: (W.decode(W.encode(im, **k)) == im).all()
    assert ok() and ok(cache_bits=3) and ok(cache_bits=11) and ok(transforms=[(W.SUBTRACT_GREEN,)])
    assert len(np.unique(im)) > 256 or ok(transforms=[(W.PALETTE,)])
    for mode in range(14):
        assert ok(transforms=[(W.PREDICTOR, 2, np.full(tiles, mode))]), mode
    cross = rng.integers(0, 1 << 32, (-(-shape[0] >> 3), -(-shape[1] >> 3)), dtype=np.uint64).astype(np.uint32)
    assert ok(transforms=[(W.PREDICTOR, 2, rng.integers(0, 14, tiles)), (W.CROSS_COLOUR, 3, cross), (W.SUBTRACT_GREEN,)], cache_bits=5, tiles=(2, rng.integers(0, 3, tiles)))


def test_back_references():
    im = np.tile(image(4, 32, 50), (8, 1))
    assert (W.decode(W.encode(im, matches=[(128, 128, 100), (256, 128, 700)])) == im).all()
    assert (W.decode(W.encode(im, cache_bits=4, matches=[(128, 128, 100), (256, 128, 700)])) == im).all()
    flat = np.full((10, 10), 5, np.uint32)
    assert (W.decode(W.encode(flat, matches=[(1, 1, 99)])) == flat).all()


def test_a_file_by_hand():
    """One pixel, written bit by bit: simple codes for 0x12 green, 0x34 red, 0x56 blue, 0xff alpha."""
    bits = f"{0:014b}"[::-1] + f"{0:014b}"[::-1] + "1" + "000" + "0" + "0" + "0"
    for s in (0x12, 0x34, 0x56, 0xFF):
        bits += "1" + "0" + "1" + f"{s:08b}"[::-1]
    bits += "1" + "0" + "0" + "0"
    body = b"\x2f" + np.packbits([int(b) for b in bits], bitorder="little").tobytes()
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    assert W.decode(data).tolist() == [[0xFF341256]]


def test_damaged_files_are_errors():
    good = W.encode_samples(bytes(range(97, 123)) * 64)
    for bad in (b"", good[:30], good[:-20], good.replace(b"VP8L", b"VP8 ")):
        with pytest.raises((ValueError, IndexError)):
            W.decode(bad)


def test_large_samples():
    p = bytes(rng.integers(97, 120, 64 * 20000, dtype=np.uint8))
    assert W.decode_samples(W.encode_samples(p)).tobytes()[: len(p)] == p


def test_rows(odd, none, small):
    for docs in (odd, small):
        want = []
        for r in docs.select("doc_id", "text").collect():
            n, p = W.payload_of(r["text"])
            want.append(str((r["doc_id"], n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))))
        got = W.digests(W.decode_media(W.encode_media(docs))).collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want)
        assert all(r["media_bytes"] > 0 and r["feature"] for r in got)
    assert W.decode_media(W.encode_media(none)).count() == 0


def test_payloads_beyond_one_image_are_several_files():
    for n in (64, 640, 704, 1984):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        media = W.encode_samples(payload, frame=640)
        assert media.count(b"WEBPVP8L") == -(-n // 640)
        assert W.decode_samples(media).tobytes()[:n] == payload
    assert W.FRAME == np.prod(W.shape_of(W.FRAME))
