"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized, tiled and hashed.

A payload is stored losslessly as 8-bit samples of a binary PGM image 64 wide (:func:`write_pgm`); the
reader also takes PPM and uncompressed 8- or 24-bit BMP. An integral image gives the mean of any
rectangle in four look-ups, hence an exact area resize to a 9 x 8 tile, kept as NPY bytes; the signs of
the differences of neighbours in its rows are the 64-bit difference hash.

Defined cases: a null text is empty, whose payload is 64 zero bytes; equal texts have equal values; a
null doc_id is passed on; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._common import materialize, tidy

WIDTH = 64
TILE = (8, 9)
BATCH_BYTES = 4 << 20


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def write_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """A binary PGM image whose samples are the given bytes."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def _netpbm(data: bytes) -> np.ndarray:
    kind, fields, at = data[:2], [], 2
    while len(fields) < 3:  # white space and comments may stand between the numbers
        if data[at : at + 1].isspace():
            at += 1
        elif data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
        else:
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end == at:
                raise ValueError("damaged Netpbm header")
            fields.append(int(data[at:end]))
            at = end
    width, height, most = fields
    if not 0 < most < 256:
        raise ValueError("only 8-bit samples are read")
    bands = {b"P5": 1, b"P6": 3}[kind]
    image = np.frombuffer(data, np.uint8, width * height * bands, at + 1)
    return image.reshape(height, width) if bands == 1 else image.reshape(height, width, 3)


def _bmp(data: bytes) -> np.ndarray:
    at, head, width, height, _, depth, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing or depth not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits is read")
    bands, rows = depth // 8, abs(height)
    stride = (width * bands + 3) // 4 * 4
    image = np.frombuffer(data, np.uint8, stride * rows, at).reshape(rows, stride)[:, : width * bands]
    image = image if height < 0 else image[::-1]
    if bands == 3:
        return image.reshape(rows, width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, 4 * ((at - 14 - head) // 4), 14 + head).reshape(-1, 4)
    grey = (palette[:, :3] == np.arange(len(palette))[:, None]).all() if len(palette) else True
    return image if grey else palette[image][:, :, 2::-1]


def write_bmp(image: np.ndarray) -> bytes:
    """An 8-bit grey or 24-bit colour BMP of an array."""
    rows, width = image.shape[:2]
    bands = 1 if image.ndim == 2 else 3
    stride = (width * bands + 3) // 4 * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, : width * bands] = (image if bands == 1 else image[:, :, ::-1]).reshape(rows, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if bands == 1 else np.zeros((0, 4), np.uint8)
    at = 54 + palette.size
    head = struct.pack("<2sIHHI IiiHHIIiiII", b"BM", at + body.size, 0, 0, at, 40, width, rows, 1, 8 * bands, 0, body.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + body[::-1].tobytes()


def decode(data: bytes) -> np.ndarray:
    """The samples of a PGM, PPM or BMP image: height x width, or height x width x 3."""
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither binary Netpbm nor BMP")


def area_resize(image: np.ndarray, shape: tuple[int, int] = TILE) -> np.ndarray:
    """Means over the rectangles of a grid (fractions of samples count as such), by an integral image."""
    grey = image if image.ndim == 2 else image.astype(np.float64).mean(2)
    rows, columns = grey.shape
    y, x = np.linspace(0, rows, shape[0] + 1), np.linspace(0, columns, shape[1] + 1)
    down = np.zeros((rows + 1, columns))  # sums over rows first: whole numbers, hence exact
    np.cumsum(grey, 0, dtype=np.float64, out=down[1:])
    low = np.minimum(y.astype(np.int64), rows - 1)
    lines = down[low] + (y - low)[:, None] * (down[low + 1] - down[low])
    bands = np.zeros((shape[0], columns + 1))
    np.cumsum(np.diff(lines, axis=0), 1, out=bands[:, 1:])
    left = np.minimum(x.astype(np.int64), columns - 1)
    sums = bands[:, left] + (x - left) * (bands[:, left + 1] - bands[:, left])
    return np.diff(sums, axis=1) / ((rows / shape[0]) * (columns / shape[1]))


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits: whether each mean of an 8 x 9 tile exceeds its left neighbour."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy_bytes(tile: np.ndarray) -> bytes:
    """The tile as an NPY file."""
    out = io.BytesIO()
    np.save(out, tile.astype("<f4"), allow_pickle=False)
    return out.getvalue()


def _rows(fields: list[tuple[str, pa.DataType]], row):
    arrow = pa.schema(fields)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for values in zip(*(batch.column(i) for i in range(batch.num_columns))):
                made = row(*(v.as_py() for v in values))
                rows.append(made)
                held += 256 + sum(len(v) for v in made if isinstance(v, (bytes, str)))
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return run


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (doc_id, n_bytes, media): every whole text's payload as a PGM image."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    make = _rows([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())], lambda key, text: (key, len((text or "").encode()), write_pgm(payload(text))))
    return materialize(chosen, "media", through=make, schema="doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media, tile as NPY, dhash) of stored images.

    Bytes that are no readable image (or null) have a null payload, tile and hash.
    """

    def row(key, n, data):
        try:
            image = decode(data or b"")
        except (ValueError, KeyError, IndexError, struct.error):
            return key, n, None, data, None, None
        tile = area_resize(image)
        return key, n, image.tobytes(), data, npy_bytes(tile), difference_hash(tile)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("tile", pa.binary()), ("dhash", pa.string())]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_rows(fields, row)), "doc_id long, n_bytes long, payload binary, media binary, tile binary, dhash string")


def op6_media(spark, sf_dir: str) -> DataFrame:
    """Digests of the stored images of all documents, read back from the table that holds them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = features(to_media(docs))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("dhash"), F.sha2("tile", 256).substr(1, 16)).alias("feature"),
    )
