"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is what stands between two line feeds. It is hashed to a wide vector, and a document's state is the sum of its paragraphs' vectors,
lane by lane modulo a power of two. So the state does not depend on paragraph order, and a paragraph can be inserted or
deleted by adding or subtracting its vector, without the rest of the document.

The vector has two blocks:

* ``LANES`` lanes of 16 bits drawn from SHAKE-128 of the paragraph. They decide equality: two different multisets of paragraphs that nobody has chosen
  to that end have equal lanes with probability 2^-2048. Against chosen paragraphs the sum is as hard as finding a short combination of so many lanes; who
  must withstand that should raise ``LANES`` to 1024.
* ``SKETCH`` lanes of 32 bits, the signed count sketch of the paragraph's windows of ``WINDOW`` bytes.
  The sketch is linear too, and the squared distance of two sketches estimates the number of windows that only one of the two documents has. They give
  the likeness. A text has less than 2^31 bytes, so no lane of a text wraps, however often a window recurs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrel.llm.common import shuffle_partitions

LANES, SKETCH, WINDOW = 128, 256, 8
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIRST, _LOW = -(2**63), np.uint32(0xFFFF)
#: Bytes of a long text that are sketched at a time.
SEGMENT = 1 << 20
#: Bytes of text in a range of ids, and the most ranges, which bound what the driver holds of their limits.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
#: A random odd-ish value for each byte; 255 never occurs in UTF-8 and stands for the end of a paragraph.
_BYTE = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[255] = 0


def paragraphs(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def state(items: Iterable[bytes]) -> np.ndarray:
    """The sum of the vectors of ``items``: ``LANES`` lanes modulo 2^16 and ``SKETCH`` modulo 2^32."""
    items = list(items)
    out = np.zeros(LANES + SKETCH, np.uint32)
    if not items:
        return out
    for at in range(0, len(items), 4096):
        digests = b"".join(hashlib.shake_128(p).digest(2 * LANES) for p in items[at : at + 4096])
        out[:LANES] += np.frombuffer(digests, "<u2").reshape(-1, LANES).sum(0, dtype=np.uint32)
    out[:LANES] &= _LOW
    gap = b"\xff" * WINDOW
    data = np.frombuffer(gap.join(items) + gap, np.uint8)
    for at in range(0, len(data), SEGMENT):
        out[LANES:] += _sketch(data[at : at + SEGMENT + WINDOW - 1], min(SEGMENT, len(data) - at)).astype(np.uint32)
    return out


def _sketch(data: np.ndarray, starts: int) -> np.ndarray:
    """The count sketch of the windows that start at the first ``starts`` bytes."""
    h, step = _BYTE[data], 1
    while step < WINDOW:
        nxt = h * np.uint64(pow(_BASE, step, 2**64))
        nxt[:-step] += h[step:]
        h, step = nxt, step * 2
    h = h[:starts][data[:starts] != 255]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    slot = (h >> np.uint64(55)).astype(np.int64)
    counts = np.bincount(slot, minlength=2 * SKETCH)
    return counts[0::2] - counts[1::2]


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of the paragraphs of both."""
    out = a + b
    out[:LANES] &= _LOW
    return out


def deleted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of the paragraphs of ``a`` without those of ``b``."""
    out = a - b
    out[:LANES] &= _LOW
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edited_state(text: str, own: np.ndarray, following: str) -> np.ndarray:
    """The edited text's state from that of ``text``: only the paragraphs from the first changed one on are hashed."""
    k = len(text) // 4
    if not k:
        return own
    cut = len(text) - k
    at = text.rfind("\n", 0, cut) + 1
    return inserted(deleted(own, state(paragraphs(text[at:]))), state(paragraphs(text[at:cut] + following[:k])))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of windows in common, 0 to 1; 1 for equal states."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (s[LANES:].view(np.int32).astype(np.float64) for s in (a, b))
    d = x - y
    norm = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1.0 - float(d @ d) / norm)) if norm else 0.0


def text_of(s: np.ndarray) -> str:
    return base64.b64encode(s[:LANES].astype("<u2").tobytes() + s[LANES:].astype("<u4").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    b = base64.b64decode(s)
    return np.concatenate((np.frombuffer(b[: 2 * LANES], "<u2").astype(np.uint32), np.frombuffer(b[2 * LANES :], "<u4").astype(np.uint32)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    before = None
    for batch in batches:
        rows = []
        for doc_id, tail, text in zip(batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            own = state(paragraphs(text))
            if before is not None:
                i, t, s = before
                e = edited_state(t, s, text)
                rows.append((i, len(t), hashlib.sha256(edited(t, text).encode("utf-8", "surrogatepass")).hexdigest(), text_of(s), text_of(e), likeness(s, e), likeness(s, own)))
            before = None if tail else (doc_id, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and likenesses.

    The edit needs the next document by ascending ``doc_id`` (after the last: the first). The
    ids are cut at quantiles into ranges, each range is sorted and read as a stream, and
    the first document of a range is also sent to the range before it. Texts are shuffled
    once, and no task holds more than one Arrow batch. There are as many ranges as texts of ``RANGE_BYTES``, but at least as many as shuffle partitions.

    A null text counts as empty. Rows with a null ``doc_id`` come first, in the order of their hashes, so that many of them are many ranges. Rows that share a ``doc_id``
    follow one another in the order of their texts. One document alone is its own next. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.lit(_FIRST) + F.shiftrightunsigned(F.xxhash64(text), 33)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("key"))
    first, size = rows.agg(F.min("key"), F.sum(F.octet_length("text"))).first()
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    n = partitions or min(MOST_RANGES, max(shuffle_partitions(spark), -(-size // RANGE_BYTES)))
    inner = rows.select(F.col("key").cast("double").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    cuts = sorted({int(c) for c in inner if c is not None and int(c) > first})
    if cuts:
        # Quantiles of doubles may miss ids beyond 2^53: take the first id at or after each cut.
        cuts = sorted(r[0] for r in rows.where(F.col("key") >= cuts[0]).groupBy(_range(F.col("key"), cuts).alias("r")).agg(F.min("key")).select("min(key)").collect())
    ranged = rows.select(_range(F.col("key"), cuts).alias("pid"), "key", "doc_id", F.lit(0).alias("tail"), "text")
    heads = spark.createDataFrame([(first, len(cuts)), *((c, i) for i, c in enumerate(cuts))], "key long, pid int")
    starts = rows.join(F.broadcast(heads), "key").groupBy("key", "pid").agg(F.min("text").alias("text"))
    starts = starts.select("pid", "key", F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("tail"), "text")
    dealt = ranged.unionByName(starts).repartitionByRange(max(n, 1), "pid").sortWithinPartitions("pid", "tail", "key", "text")
    return dealt.select("doc_id", "tail", "text").mapInArrow(_pairs, SCHEMA)


def _range(key, cuts: list[int]):
    """How many of the sorted ``cuts`` are at most ``key``, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    held = F.lit(cuts).cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= key, at + s).otherwise(at))
