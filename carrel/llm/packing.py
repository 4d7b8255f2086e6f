"""Packing token sequences by harmonic classes.

With capacity C, class k holds the documents of C/(k+1) < length <= C/k, whole, and a bin of the class is closed when it has its k documents. There are fewer
than 2 * sqrt(C) classes. Cutting is free, so the gap that they leave is filled with a piece of a document that is longer than C and must be cut anyway; such documents
wait in line, the first of them being cut to measure, and what is in the line beyond ``RESERVE`` sequences is cut to full ones. Where
no long document comes, at most ``MOST_WAITING`` closed bins wait for one; then the next documents go into the line, whatever their length.
So a document of up to C is whole but for these, and for those at a worker's end. Classes share nothing and each worker numbers its own bins, so no row is shuffled.

At a worker's end what is open, waiting and in line is laid end to end and cut at C; what remains of that is cut at powers of two, which need no padding. So no sequence has any.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END = 2048, 1
RESERVE, MOST_WAITING = 4, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    A byte-level vocabulary whose ids are its merge ranks is read into ``tiktoken``, which gives the same ids several times
    faster; texts that hold an added token, and other vocabularies, go through ``tokenizers`` itself.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = lambda text: exact.encode(text, add_special_tokens=False).ids
    added = [t["content"] for t in spec.get("added_tokens") or []]
    ranks = _ranks(spec, set(added))
    if ranks is None:
        _ENCODERS[path] = slow
        return slow
    # The split that byte-level vocabularies of this kind use.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("carrel", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
    #: Runs so long that the splitter's or the merger's work grows faster than the text.
    long_run = re.compile(r"\S{20000}|\s{20000}")

    def encode(text: str) -> list[int]:
        if special.search(text) or long_run.search(text):
            return slow(text)
        return fast.encode_ordinary(text)

    _ENCODERS[path] = encode
    return encode


def _ranks(spec: dict, added: set[str]) -> dict[bytes, int] | None:
    """Bytes to ids of a byte-level BPE whose merges follow its ids and which adds nothing to the text, else None."""
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab.get("".join(m)) for m in merges]
    if made != sorted(set(x for x in made if x is not None)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}


class Packer:
    """One worker's bins. ``add`` returns the rows of bins that are full; ``close`` those of the rest."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, reserve: int = RESERVE, most_waiting: int = MOST_WAITING):
        self.next, self.capacity, self.reserve, self.most_waiting = first_id, capacity, reserve, most_waiting
        # Pieces are (doc_id, start, ids, ids of the document).
        self.open: dict[int, list[tuple[int, int, np.ndarray, int]]] = {}
        self.waiting: deque[list] = deque()  # bins with their count of documents
        self.line: deque[tuple[int, int, np.ndarray, int]] = deque()
        self.left = 0  # ids in line

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        n = len(ids)
        if not n:
            return []
        if n > self.capacity or len(self.waiting) >= self.most_waiting:
            self.line.append((doc_id, 0, ids, n))
            self.left += n
        else:
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append((doc_id, 0, ids, n))
            if len(held) == k:
                self.waiting.append(self.open.pop(k))
        return self._full()

    def _full(self) -> list[tuple]:
        rows = []
        while self.waiting and (gap := self.capacity - sum(len(p[2]) for p in self.waiting[0])) <= self.left:
            rows += self._bin(self.waiting.popleft() + self._cut(gap))
        while self.left >= (self.reserve + 1) * self.capacity:
            rows += self._bin(self._cut(self.capacity))
        return rows

    def _cut(self, size: int) -> list[tuple[int, int, np.ndarray, int]]:
        """The next ``size`` ids of the line, as pieces."""
        out = []
        self.left -= size
        while size:
            doc_id, at, ids, total = self.line.popleft()
            out.append((doc_id, at, ids[:size], total))
            if len(ids) > size:
                self.line.appendleft((doc_id, at + size, ids[size:], total))
            size -= min(size, len(ids))
        return out

    def _bin(self, held) -> list[tuple]:
        rows, offset = [], 0
        for doc_id, at, ids, total in held:
            rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return rows

    def close(self) -> list[tuple]:
        for held in (*self.waiting, *(self.open[k] for k in sorted(self.open))):
            self.line.extend(held)
            self.left += sum(len(p[2]) for p in held)
        self.waiting.clear()
        self.open.clear()
        rows = []
        while self.left:
            rows += self._bin(self._cut(self.capacity if self.left >= self.capacity else 1 << (self.left.bit_length() - 1)))
        return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty, so its document is the end id alone. Every row is a document of its own, also where
    rows share a doc_id. A text of any length is cut to as many pieces as it takes. Other columns are ignored. An empty
    table gives no rows. ``sequence_id`` is the worker's partition times 2^40 plus its count. ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(vocabulary), [] if end is None else [end]
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += packer.add(doc_id, np.array(encode(text.as_py() or "") + tail, "<u4"))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
        rows += packer.close()
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)
