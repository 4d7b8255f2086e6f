"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG of 576 columns, under the SHA-256 of the payload as its name,
in tar shards in a shared folder. Rows carry digest, shard, offset and length only. Metadata columns are filled
by reading the 33 bytes of the image's header at the row's offset; features by reading all its bytes.

Each task appends to shards of its own, whose names are unique for each attempt, and stores a payload
once per shard; so no text is shuffled, a hot text costs one entry a shard, and a task that is run again after a
lost executor leaves at most an unreferenced shard behind. The index is written as a table once all shards are.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrel.llm.common import shared_folder, stored

WIDTH, PAD, HEADER = 576, b"\xff", 33
SHARD_BYTES = 256 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of the text, then bytes 255 up to a positive multiple of 576."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + PAD * (max(WIDTH, -(-len(b) // WIDTH) * WIDTH) - len(b))


def encode(samples: bytes) -> bytes:
    """Samples, a multiple of 576, as a grey PNG with unfiltered rows."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type from the first 33 bytes of a PNG."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def decode(stored_bytes: bytes) -> bytes:
    width, height, bits, colour = header(stored_bytes)
    if (bits, colour) != (8, 0):
        raise ValueError("not an 8-bit grey image")
    at, body = 8, []
    while at < len(stored_bytes):
        (n,) = struct.unpack(">I", stored_bytes[at : at + 4])
        kind, data = stored_bytes[at + 4 : at + 8], stored_bytes[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", stored_bytes[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Rows, mean, deviation, entropy of the grey values, and mean step between neighbours."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values, n = np.arange(256), len(x)
    mean = float(counts @ values) / n
    sd = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    step = float(np.abs(np.diff(x.astype(np.int16))).sum()) / n
    return f"rows={n // WIDTH};mean={mean:.4f};sd={sd:.4f};entropy={-float((p * np.log2(p)).sum()):.4f};step={step:.4f}"


def _writer(folder: str, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, name, at, here = None, "", 0, {}
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if out is None or at >= shard_bytes:
                        if out is not None:
                            out.write(b"\0" * 1024)
                            out.close()
                        name, at, here = f"shard-{uuid.uuid4().hex}.tar", 0, {}
                        out = store.open_output_stream(f"{path}/{name}")
                    text = text.as_py()
                    p = payload(text)
                    digest = hashlib.sha256(p).hexdigest()
                    if digest not in here:
                        image = encode(p)
                        info = tarfile.TarInfo(digest + ".png")
                        info.size = len(image)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT if len(image) < 8 << 30 else tarfile.GNU_FORMAT))
                        out.write(image)
                        out.write(b"\0" * (-len(image) % 512))
                        here[digest] = (at + 512, len(image))
                        at += 512 + len(image) + -len(image) % 512
                    rows.append((doc_id, len((text or "").encode("utf-8", "surrogatepass")), digest, name, *here[digest]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), INDEX, strict=True)], schema=INDEX)
        finally:
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()

    return write


def store_media(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Writes the payloads of ``docs`` to tar shards; returns the index table and the folder.

    The index has doc_id, n_bytes, digest, shard, offset and length. A null text counts as empty; any number of rows may
    share a doc_id; other columns are ignored; an empty table gives an empty index.
    """
    folder = folder or shared_folder(docs.sparkSession, "media")
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    store.create_dir(path, recursive=True)
    index = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_writer(folder, shard_bytes), "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return stored(index, "media-index"), folder


def _reader(folder: str, read, names: list[str], types: list[pa.DataType]):
    """Maps index rows by ``read(file, offset, length)``; a shard is opened once for a run of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        file, name, seen = None, None, OrderedDict()
        for batch in batches:
            made = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    file, name = store.open_input_file(f"{path}/{shard}"), shard
                    seen.clear()
                if (got := seen.get(offset)) is None:
                    got = seen[offset] = read(file, offset, length)
                    if len(seen) > 4096:
                        seen.popitem(last=False)
                made.append(got)
            if made:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))], names=[*batch.schema.names, *names])

    return run


def media_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bits, from range reads of the 33 header bytes alone."""
    read = lambda f, offset, length: header(f.read_at(HEADER, offset))[:3]
    return index.mapInArrow(_reader(folder, read, ["width", "height", "bits"], [pa.int32()] * 3), "doc_id long, n_bytes long, digest string, shard string, offset long, length long, width int, height int, bits int")


def _whole(file, offset: int, length: int) -> tuple:
    width, height, bits, _ = header(file.read_at(HEADER, offset))
    image = file.read_at(length, offset)
    samples = decode(image)
    return width, height, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)


def media_features(index: DataFrame, folder: str) -> DataFrame:
    """The index with the columns that reading back the stored bytes gives."""
    names = ["width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return index.mapInArrow(_reader(folder, _whole, names, types), "doc_id long, n_bytes long, digest string, shard string, offset long, length long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
