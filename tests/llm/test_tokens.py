"""Operators on token ids: packing, token files, byte-level BPE, and the cached tokenizer below them."""

import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import bpe, packing, token_file, tokens
from factloom.llm._common import fresh_path
from factloom.llm.tokens import PieceTokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "   ", "a", "a  b \n c ", "é, ç. ß! ×÷", "<|endoftext|> x", "a <|endoftext|> b", "end  <|endoftext|><|endoftext|>word. <|endof", "text|>", "don't ''s", "日本 語　x", "🎉 🎉", "x" * 5000, "one two " * 900, "\x1c \x1f a", "tie", "tie"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def pieces():
    return PieceTokenizer(JSON)


def ids_of(pieces, texts):
    return [ids[a:b].tolist() for _, ids, ends in pieces.blocks(pa.array(texts, pa.string())) for a, b in zip(ends, ends[1:])]


def frame(spark, texts=ODD):
    rows = [(None if i == 3 else i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "a", ".", "é", "word "]), max_size=8).map("".join), max_size=5))
def test_added_tokens(pieces, library, texts):
    assert ids_of(pieces, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t.,'!aeZé×÷ßñ1|s日🎉\xa0 ")), max_size=40), max_size=6))
def test_pieces_give_the_ids_of_the_whole(pieces, library, texts):
    assert ids_of(pieces, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts(pieces, library):
    assert ids_of(pieces, ODD) == [library.encode(t or "", add_special_tokens=False).ids for t in ODD]


def test_forgetting(pieces, library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 200)
    texts = [f"the word of {i % 7} and {i} the more, é{i % 3}" for i in range(300)]
    for _ in range(2):
        assert ids_of(pieces, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert pieces.n_slots < 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_pool(lengths):
    window = 64
    made = packing.pack_pool(lengths, window)
    covered = defaultdict(list)
    for sequence in made:
        size = sum(n for _, _, n in sequence)
        assert size == window or size & (size - 1) == 0
        for piece, start, n in sequence:
            covered[piece].append((start, n))
    for piece, n in enumerate(lengths):
        at = 0
        for start, m in sorted(covered[piece]):
            assert start == at
            at += m
        assert at == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing(lengths):
    bins, capacity = [], []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(c, k) for k, c in enumerate(capacity) if c >= lengths[piece]]
        if fits:
            tightest = min(c for c, _ in fits)
            capacity[next(k for c, k in fits if c == tightest)] -= lengths[piece]
        else:
            capacity.append(64 - lengths[piece])
    bins = packing.best_fit_decreasing(lengths, 64)
    assert sorted(64 - sum(lengths[p] for p in b) for b in bins) == sorted(capacity)


def test_packing(spark, library):
    rows = packing.pack(frame(spark), JSON, pool=5).collect()
    want = {None if i == 3 else i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(ODD)}
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        full = want[r.doc_id]
        assert r.doc_tokens == len(full) and np.frombuffer(r.ids, "<u4").tolist() == full[r.start : r.start + r.length]
        own[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [*((v, len(want[k])) for k, v in own.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 1024
    assert own.keys() == want.keys()
    assert packing.pack(frame(spark).limit(0), JSON).count() == 0


def test_token_files(spark, library):
    docs = frame(spark)
    manifest = token_file.write_token_files(docs, JSON, fresh_path(spark, "ids"), end_id=2)
    rows = sorted(token_file.read_token_files(manifest).collect(), key=lambda r: r.start)
    want = {None if i == 3 else i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(ODD)}
    assert [r.doc_id for r in rows] == sorted(want, key=lambda k: -1 if k is None else k)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(want[r.doc_id]), want[r.doc_id])
        at += r.n_tokens
    assert token_file.read_token_files(token_file.write_token_files(docs.limit(0), JSON, fresh_path(spark, "ids"), 2)).count() == 0


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_seek(id_bytes):
    draw = np.random.default_rng(1)
    docs = [draw.integers(0, 60_000, n) for n in (3, 0, 500, 1, 2000, 40)]
    out = io.BytesIO()
    writer = token_file.TokenFileWriter(out, id_bytes, frame_ids=100)
    for key, ids in enumerate(docs):
        writer.add(key or None, ids)
    size = writer.close()
    assert size == len(out.getvalue())
    reader = token_file.TokenFileReader(out, size)
    assert reader.keys == [None, 1, 2, 3, 4, 5] and len(reader.table) > 2
    for k in (4, 0, 5, 2, 1, 3):
        assert reader.document(k).tolist() == docs[k].tolist()
    raw = bytearray(out.getvalue())
    raw[5] ^= 1
    with pytest.raises(ValueError, match="frame 0"):
        token_file.TokenFileReader(io.BytesIO(bytes(raw)), size).document(0)
    with pytest.raises(ValueError):
        token_file.TokenFileReader(io.BytesIO(b"x" * 100), 100)


def test_bpe(spark):
    encoding = bpe.rank_encoding(RANKS)
    rows = {r.doc_id: r for r in bpe.round_trip(frame(spark), RANKS).collect()}
    for i, t in enumerate(ODD):
        r = rows[None if i == 3 else i]
        assert list(r.ids) == encoding.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
    assert [list(r.ids) for r in bpe.encode(frame(spark), RANKS).orderBy("doc_id").collect()][1:] == [list(rows[k].ids) for k in sorted(k for k in rows if k is not None)]
    again = bpe.decode(bpe.encode(frame(spark), RANKS), RANKS)
    assert {r.doc_id: bytes(r.decoded) for r in again.collect()} == {k: bytes(r.decoded) for k, r in rows.items()}
    assert bpe.round_trip(frame(spark).limit(0), RANKS).count() == 0


def test_long_texts_are_cut_safely():
    encoding = bpe.rank_encoding(RANKS)
    text = " word, and  \n more é 12's" * 50
    assert len(list(bpe.text_parts(text, 100))) > 5
    assert [i for p in bpe.text_parts(text, 100) for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
    assert list(bpe.text_parts("x" * 300, 100)) == ["x" * 300]


def test_queries(spark, library):
    from factloom.llm import registry

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    found = registry.queries()
    for r in found["op8_bpe"](spark, "/root/testdata/sf0.001").collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    at = 0
    for r in found["op7_token_file"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect():
        full = ids[r.doc_id] + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(full), zlib.crc32(np.array(full, "<u4").tobytes()))
        at += len(full)
    for r in found["op1_packing"](spark, "/root/testdata/sf0.001").collect():
        assert r.ids_crc32 == zlib.crc32(np.array((ids[r.doc_id] + [0])[r.start : r.start + r.length], "<u4").tobytes())
