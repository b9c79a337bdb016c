"""Media columns: round trips of formats, exact area resize, features."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from factloom.llm import media, registry


def test_formats():
    draw = np.random.default_rng(1)
    grey, colour = draw.integers(0, 256, (5, 7), np.uint8), draw.integers(0, 256, (3, 5, 3), np.uint8)
    assert (media.decode(media.write_bmp(grey)) == grey).all() and (media.decode(media.write_bmp(colour)) == colour).all()
    assert (media.decode(b"P6 # a comment\n5 3\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(media.write_pgm(grey.tobytes(), 7)) == grey).all()
    data = bytearray(media.write_bmp(grey))
    struct.pack_into("<i", data, 22, -5)  # rows from the top
    assert (media.decode(bytes(data)) == grey[::-1]).all()
    for bad in (b"", b"GIF", b"P5\n9 9\n255\n", b"P5\nx", b"P5\n1 1\n65535\n00"):
        with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
            media.decode(bad)


@pytest.mark.parametrize("shape", [(1, 64), (8, 9), (13, 64), (100, 37)])
def test_area_resize(shape):
    image = np.random.default_rng(2).integers(0, 256, shape, np.uint8)
    rows, columns = media.TILE
    big = np.kron(image.astype(float), np.ones((rows, columns)))  # every cell is a whole number of samples
    want = big.reshape(rows, shape[0], columns, shape[1]).mean((1, 3))
    assert np.allclose(media.area_resize(image), want)
    assert len(media.difference_hash(want)) == 16 and (np.load(io.BytesIO(media.npy_bytes(want))) == want.astype("f4")).all()


def test_operator(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "x" * 65, "long " * 40_000, "a"]
    docs = spark.createDataFrame([(None if i == 4 else i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in media.features(media.to_media(docs)).collect()}
    for i, t in enumerate(texts):
        r, raw = rows[None if i == 4 else i], (t or "").encode()
        assert bytes(r.payload) == raw + b"\0" * (-len(raw) % 64 if raw else 64) and r.n_bytes == len(raw)
    assert rows[2].dhash == rows[7].dhash and bytes(rows[0].media) == bytes(rows[1].media)
    assert media.to_media(docs.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, 3, b"GIF"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r.payload for r in media.features(broken).collect()] == [None, None]


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in registry.queries()["op6_media"](spark, "/root/testdata/sf0.001").collect():
        full = docs[r.doc_id] + b"\0" * (-len(docs[r.doc_id]) % 64 if docs[r.doc_id] else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.write_pgm(full)).hexdigest()
