import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from carrel.llm import packing as pk
from carrel.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


TEXTS = ["", " ", "Hello world's 123!", "it's\n\n\n  we'll", "éàü ß 字😀", "a" * 30_000, " " * 25_000, "x<|endoftext|>y", "\r\n\t\x0b", "don't DON'T", "ab " * 5_000, "   　x"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(tokenizer, text):
    assert pk.encoder(vocabulary())(text) == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, ids_of):
    """Each id lies in one piece, sequences are gapless and at most 2048."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for k, ids in ids_of.items():
        at = 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / total


def test_pack(spark, duck, tokenizer):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in rows}
    out = pk.pack(d, vocabulary()).collect()
    assert check(out, ids) < 0.01
    assert sorted(map(str, out)) == sorted(map(str, pk.pack(d, vocabulary()).collect()))


def packed(lengths, **options):
    p, rows = pk.Packer(0, **options), []
    for i, n in enumerate(lengths):
        rows += p.add(i, np.zeros(n, "<u4"))
        assert all(2048 // len(x[2]) == k and len(held) < k for k, held in p.open.items() for x in held)
    before = len(rows)
    return rows + p.close(), before, p.next


def test_classes_have_fixed_counts():
    r = np.random.default_rng(3)
    lengths = np.where(r.random(6000) < 0.3, r.integers(2049, 9000, 6000), r.integers(1, 2049, 6000)).tolist()
    rows, before, bins = packed(lengths)
    held, pieces = {}, {}
    for row in rows[:before]:
        held.setdefault(row[5], []).append(row)
    for row in rows:
        pieces.setdefault(row[0], []).append(row[2])
    assert [sum(pieces[i]) for i in range(6000)] == lengths
    # Bins hold whole documents of one class, as many as the class says, and pieces of longer ones in the gap.
    for rs in held.values():
        whole = [x[2] for x in rs if x[2] == x[4] <= 2048]
        assert sum(x[2] for x in rs) == 2048 and len({2048 // n for n in whole}) <= 1 and (not whole or len(whole) == 2048 // whole[0])
    cut = sum(len(pieces[i]) > 1 for i, n in enumerate(lengths) if n <= 2048)
    assert cut < 0.02 * len(lengths) and bins < sum(lengths) / 2048 + 12


def test_without_long_documents_few_are_cut():
    lengths = np.random.default_rng(4).integers(1, 2049, 8000).tolist()
    rows, _, bins = packed(lengths)
    pieces = {}
    for row in rows:
        pieces.setdefault(row[0], []).append(row[2])
    assert [sum(pieces[i]) for i in range(8000)] == lengths and bins < sum(lengths) / 2048 + 12
    assert sum(len(v) > 1 for v in pieces.values()) < 0.4 * len(lengths)


def test_one_document_of_any_length():
    for n in (1, 2047, 2048, 2049, 1_000_003):
        rows, _, _ = packed([n])
        assert sum(r[2] for r in rows) == n


def test_oddities(spark, docs, empty, tokenizer):
    d = docs.dropDuplicates(["doc_id", "text"])
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in d.collect()}
    check(pk.pack(d, vocabulary()).collect(), ids)
    total = sum(r.length for r in pk.pack(docs, vocabulary()).collect())
    assert total == sum(len(ids[r.doc_id]) for r in docs.collect())
    assert pk.pack(empty, vocabulary()).count() == 0
    with pytest.raises(ValueError):
        pk.pack(docs, vocabulary(), capacity=1000)
