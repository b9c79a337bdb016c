"""Byte-level BPE encoding and raw-byte decoding with the tiktoken library and a local rank file.

Texts longer than ``PART_CHARS`` are cut before a space that a visible character follows: the split
pattern always starts a new match there, so the parts' ids, joined, are the ids of the whole text and
the library never sees a text of unbounded length (a text without such a place stays whole).

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are coded each on
its own; a null id is passed on; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import tidy

#: Characters of a text that are encoded at a time, and rows of a returned batch.
PART_CHARS = 1 << 16
BATCH_IDS = 1 << 20
_CUT = re.compile(r"(?= [!-~])")
_LOADED: dict[str, tiktoken.Encoding] = {}


def rank_encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once in each worker, with the public split pattern."""
    if path not in _LOADED:
        import public_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED[path] = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def text_parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut where the split pattern starts anew."""
    at = 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text as int32."""
    parts = [encoding.encode_to_numpy(part, allowed_special=set(), disallowed_special=()) for part in text_parts(text)]
    return np.concatenate(parts).astype(np.int32)


def _rows(batches, columns: dict[str, pa.DataType], row):
    """Batches of bounded size of what ``row`` makes of each input row: (size, values)."""
    out, held = [], 0
    schema = pa.schema(list(columns.items()))
    for batch in batches:
        for values in zip(*(batch.column(i) for i in range(batch.num_columns))):
            n, made = row(*values)
            out.append(made)
            held += n
            if held >= BATCH_IDS:
                yield _batch(out, schema)
                out, held = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field, values in zip(schema, zip(*rows)):
        if pa.types.is_list(field.type):
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values))))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""

    def run(batches):
        encoding = rank_encoding(path)

        def row(key, text):
            ids = encode_text(encoding, text.as_py() or "")
            return len(ids) + 1, (key.as_py(), ids)

        yield from _rows(batches, {id_col: pa.int64(), "ids": pa.list_(pa.int32())}, row)

    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return chosen.mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the raw bytes of every list of ids; a null list gives no bytes."""

    def run(batches):
        encoding = rank_encoding(path)

        def row(key, ids):
            raw = encoding.decode_bytes(ids.as_py() or [])
            return len(raw) + 1, (key.as_py(), raw)

        yield from _rows(batches, {id_col: pa.int64(), "decoded": pa.binary()}, row)

    chosen = coded.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col))
    return chosen.mapInArrow(tidy(run), f"`{id_col}` long, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass: :func:`encode`, then :func:`decode` of the ids."""

    def run(batches):
        encoding = rank_encoding(path)

        def row(key, text):
            ids = encode_text(encoding, text.as_py() or "")
            return len(ids) + 1, (key.as_py(), ids, encoding.decode_bytes(ids.tolist()))

        yield from _rows(batches, {id_col: pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}, row)

    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return chosen.mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>, decoded binary")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
