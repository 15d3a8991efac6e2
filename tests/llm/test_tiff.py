import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import tiff


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_over_a_full_table():
    for data in (bytes(np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8)), bytes(np.random.default_rng(1).integers(0, 2, 200_000, dtype=np.uint8))):
        assert tiff.unlzw(tiff.lzw(data), len(data)) == data


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("planar", [1, 2])
def test_pages(kind, predictor, tile, order, planar):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 9, (70, 45), dtype=np.uint8), rng.integers(0, 60000, (33, 50, 3)).astype(np.uint16), np.zeros((1, 1), np.uint8)]
    found = list(tiff.read(tiff.write(images, kind, predictor, tile, rows=13, order=order, planar=planar)))
    assert [p for p, _, _ in found] == [0, 1, 2]
    for (_, x, error), y in zip(found, images):
        assert error is None and (x == (y[:, :, None] if y.ndim == 2 else y)).all()


def test_faults():
    good = tiff.write([np.ones((4, 4), np.uint8)] * 2)
    assert list(tiff.read(None)) == list(tiff.read(b"")) == []
    assert "header" in list(tiff.read(b"nothing at all"))[0][2]
    assert list(tiff.read(good[:-40]))[-1][2]
    first = struct.unpack_from("<I", good, 4)[0]
    ring = bytearray(good)
    n = struct.unpack_from("<H", good, first)[0]
    struct.pack_into("<I", ring, first + 2 + 12 * n, first)
    assert "ring" in list(tiff.read(bytes(ring)))[-1][2]


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("fill", [1, 2])
def test_other_samples(kind, tile, order, fill):
    rng = np.random.default_rng(5)
    whole = lambda *a, **k: [x for _, x, e in tiff.read(tiff.write(*a, kind=kind, tile=tile, order=order, fill=fill, **k))]
    for dtype, predictors in ((np.uint32, (1, 2)), (np.int16, (1, 2)), (np.int32, (1, 2)), (np.float32, (1, 3)), (np.float16, (1, 3)), (np.float64, (1, 3))):
        for shape in ((21, 37), (40, 20, 3)):
            x = (rng.normal(0, 300, shape)).astype(dtype)
            for predictor in predictors:
                for planar in (1, 2):
                    (y,) = whole([x], predictor=predictor, planar=planar, rows=9)
                    assert y.dtype == x.dtype and (y == x.reshape(y.shape)).all()
    for bits in (1, 2, 4):
        x = rng.integers(0, 1 << bits, (19, 37, 3), dtype=np.uint8)
        for planar in (1, 2):
            assert (whole([x], bits=bits, planar=planar, rows=5)[0] == x).all()


def test_no_changed_byte_leaves_a_fault_unsaid():
    """Every byte of a header, a directory and its values, set to odd values: rows or an error, and no large array."""
    rng = np.random.default_rng(7)
    image = rng.integers(0, 9, (20, 33), dtype=np.uint8)
    for kind, tile in ((tiff.DEFLATE, None), (tiff.LZW, (16, 16)), (tiff.PACKBITS, None), (tiff.NONE, (16, 16))):
        good = tiff.write([image, image], kind, 2, tile, rows=7)
        for at in range(len(good)):
            for value in {0, 1, 2, 5, 127, 128, 255, good[at] ^ 1, good[at] ^ 128}:
                bad = bytearray(good)
                bad[at] = value
                rows = list(tiff.read(bytes(bad)))
                assert all((x is None) == (e is not None) for _, x, e in rows) and all(x is None or x.nbytes <= 4096 * 4 * len(good) for _, x, _ in rows)
    for n in range(len(good)):
        list(tiff.read(good[:n]))


@pytest.mark.parametrize("tag", [tiff.STRIP_ROWS, tiff.WIDTH, tiff.LENGTH, tiff.SAMPLES, tiff.BITS, tiff.COMPRESSION])
def test_fields_of_zero(tag):
    good = tiff.write([np.ones((4, 4), np.uint8)])
    at = good.index(struct.pack("<HH", tag, 3 if tag in (tiff.SAMPLES, tiff.BITS, tiff.COMPRESSION) else 4))
    bad = good[: at + 8] + b"\0\0\0\0" + good[at + 12 :]
    assert list(tiff.read(bad))[0][2]
    assert list(tiff.read(tiff.write([np.ones((4, 4), np.uint8)], tiff.LZW).replace(tiff.lzw(b"\1" * 16), b"\xff" * len(tiff.lzw(b"\1" * 16)))))[0][2]


def test_texts_are_dealt_to_all_decoders():
    found = set()
    for k in range(3000):
        text = f"{k} some words of a text that has a few rows ".encode() * 9
        tags = list(tiff.directories(media := tiff.of_text(text)))
        found.add((tags[0][tiff.COMPRESSION][0], tiff.TILE_AT in tags[0], tags[0][tiff.PREDICTOR][0], len(tags)))
        assert b"".join(x.tobytes() for _, x, _ in tiff.read(media)).rstrip(b"\0") == text
    assert len(found) == 3 * 2 * 2 * 3


def test_rows(spark):
    files = spark.createDataFrame([(1, bytearray(tiff.write([np.arange(12, dtype=np.uint8).reshape(3, 4)] * 2)), "x"), (2, None, "y"), (3, bytearray(b"junk"), "z")], "id long, content binary, page string")
    rows = {(r.key, r.page): r for r in tiff.pages(files, "id", "content").collect()}
    assert set(rows) == {(1, 0), (1, 1), (3, 0)} and rows[3, 0].error
    assert (rows[1, 1].width, rows[1, 1].height, bytes(rows[1, 1].pixels)) == (4, 3, bytes(range(12)))


def test_texts(awkward, empty):
    rows = tiff.text_features(awkward).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, r.text)
    assert len(rows) == awkward.count()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        full = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        media = tiff.of_text(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert tiff.text_features(empty).count() == 0
