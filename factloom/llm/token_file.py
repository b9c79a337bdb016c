"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order of doc_id. Layout, all little-endian:

* frames: each the zstandard frame of the ids of some whole documents, unsigned 16-bit if the
  vocabulary allows it, else 32-bit, at most about ``FRAME_IDS`` ids (a longer document has its own);
* index: one zstandard frame of the documents' int64 doc_id, uint8 "doc_id is null", int64 number of ids;
* seek table: per frame uint64 first byte, uint32 compressed size, uint32 crc32 of the compressed
  bytes, uint64 number of documents before it, uint64 number of ids before it;
* footer (48 bytes): uint64 place of the index, uint64 its size, uint64 number of documents, uint64
  number of ids, uint32 frames, uint32 bytes per id, uint32 crc32 of index and seek table, magic "FLT1".

A reader needs footer, table and index once, then decompresses only frames that it is asked for.

Defined cases: a null text is empty, that is one end id; rows of one doc_id stay together in the order
of their texts' hashes; a null doc_id comes first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._common import filesystem, fresh_path, materialize, tidy

FRAME_IDS = 1 << 16
LEVEL = 1
_ENTRY = struct.Struct("<QIIQQ")
_FOOTER = struct.Struct("<QQQQIII4s")
_MAGIC = b"FLT1"


class TokenFileWriter:
    """Writes documents' ids to a binary stream."""

    def __init__(self, stream, id_bytes: int = 4, frame_ids: int = FRAME_IDS):
        self.stream, self.frame_ids = stream, frame_ids
        self.kind = np.dtype("<u2" if id_bytes == 2 else "<u4")
        self.coder = zstandard.ZstdCompressor(level=LEVEL)
        self.at = self.n_ids = 0
        self.table: list[bytes] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.held and self.n_held + len(ids) > self.frame_ids:
            self._frame()
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.keys.append(key)
        self.counts.append(len(ids))

    def _frame(self) -> None:
        if self.held:
            data = self.coder.compress(np.concatenate(self.held).tobytes())
            self.table.append(_ENTRY.pack(self.at, len(data), zlib.crc32(data), len(self.keys) - len(self.held), self.n_ids))
            self.stream.write(data)
            self.at += len(data)
            self.n_ids += self.n_held
            self.held, self.n_held = [], 0

    def close(self) -> int:
        """Write the trailing parts; the file's size."""
        self._frame()
        nulls = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        index = self.coder.compress(keys.tobytes() + nulls.tobytes() + np.array(self.counts, "<i8").tobytes())
        table = b"".join(self.table)
        footer = _FOOTER.pack(self.at, len(index), len(self.keys), self.n_ids, len(self.table), self.kind.itemsize, zlib.crc32(index + table), _MAGIC)
        self.stream.write(index + table + footer)
        return self.at + len(index) + len(table) + len(footer)


class TokenFileReader:
    """Reads a seekable binary stream; decompresses only the frames that are asked for."""

    def __init__(self, stream, size: int):
        self.stream = stream
        self.coder = zstandard.ZstdDecompressor()
        stream.seek(size - _FOOTER.size)
        at, n_index, n_docs, self.n_ids, n_frames, id_bytes, crc, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        stream.seek(at)
        index = stream.read(n_index)
        table = stream.read(n_frames * _ENTRY.size)
        if zlib.crc32(index + table) != crc:
            raise ValueError("the token file's index is damaged")
        self.kind = np.dtype(f"<u{id_bytes}")
        raw = self.coder.decompress(index)
        nulls = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.keys = [None if null else int(key) for key, null in zip(np.frombuffer(raw, "<i8", n_docs), nulls)]
        self.counts = np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)
        self.starts = np.cumsum(self.counts) - self.counts
        self.table = [_ENTRY.unpack_from(table, i * _ENTRY.size) for i in range(n_frames)]
        self.frame_docs = np.array([e[3] for e in self.table] + [n_docs])

    def frame(self, number: int) -> np.ndarray:
        """All ids of a frame, after a check of its checksum."""
        at, size, crc, _, _ = self.table[number]
        self.stream.seek(at)
        data = self.stream.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(self.coder.decompress(data), self.kind)

    def document(self, position: int) -> np.ndarray:
        """The ids of the document at a position of the file, from its frame alone."""
        number = int(np.searchsorted(self.frame_docs, position, side="right")) - 1
        at = int(self.starts[position]) - self.table[number][4]
        return self.frame(number)[at : at + int(self.counts[position])].astype(np.uint32)

    def documents(self):
        """(doc_id, ids before it in this file, ids) of all documents, frame by frame."""
        for number, entry in enumerate(self.table):
            ids = self.frame(number).astype("<u4")
            for k in range(self.frame_docs[number], self.frame_docs[number + 1]):
                at = int(self.starts[k]) - entry[4]
                yield self.keys[k], int(self.starts[k]), ids[at : at + int(self.counts[k])]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write files in ascending order of doc_id.

    Returns the manifest, one row per file: shard, path, bytes, n_docs, n_ids, first_id (the ids of all
    files before it). A repeated task writes the same file again; files appear by a rename.
    """

    def run(batches):
        from factloom.llm.tokens import loaded

        tokenizer = loaded(tokenizer_path)
        shard = TaskContext.get().partitionId()
        store, base = filesystem(folder)
        final = f"{base}/ids-{shard:06d}.flt"
        work = f"{base}/.{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        stream = writer = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if keys and not writer:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(work)
                writer = TokenFileWriter(stream, 2 if max(tokenizer.vocab_size, end_id + 1) <= 1 << 16 else 4)
            for row, ids, ends in tokenizer.blocks(batch.column(1)):
                for k in range(len(ends) - 1):
                    writer.add(keys[row + k], np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)))
        if writer:
            size = writer.close()
            stream.close()
            store.move(work, final)
            n_docs, n_ids = len(writer.keys), writer.n_ids
            row = [[shard], [f"{folder}/ids-{shard:06d}.flt"], [size], [n_docs], [n_ids]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["shard", "path", "bytes", "n_docs", "n_ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = chosen.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = named.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    files = materialize(ordered, "manifest", through=run, schema="shard long, path string, bytes long, n_docs long, n_ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids little-endian unsigned 32-bit) of all documents of the files."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = filesystem(path)
                with store.open_input_file(place) as stream:
                    rows, held = [], 0
                    for key, start, ids in TokenFileReader(stream, stream.size()).documents():
                        rows.append((key, first + start, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held >= 1 << 20:
                            yield make(rows)
                            rows, held = [], 0
                    if rows:
                        yield make(rows)

    files = manifest.select("path", "first_id", "shard")
    spread = files.repartition(max(1, manifest.count()), "shard").select("path", "first_id")
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def op7_token_file(spark, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the written files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "ids")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
