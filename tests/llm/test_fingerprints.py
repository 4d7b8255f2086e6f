import collections
import hashlib
import random

import numpy as np

from carrel.llm import fingerprints as fp


def test_homomorphic():
    a, b, c = ([x.encode() for x in s] for s in (("one", "two"), ("two", "one"), ("one", "two", "three")))
    assert (fp.state(a) == fp.state(b)).all()
    assert (fp.deleted(fp.state(c), fp.state([b"three"])) == fp.state(a)).all()
    assert (fp.inserted(fp.state(a), fp.state([b"three"])) == fp.state(c)).all()
    assert not (fp.state(a) == fp.state([b"one", b"one", b"two"])).all()
    assert (fp.from_text(fp.text_of(fp.state(c))) == fp.state(c)).all()
    assert (fp.state([]) == 0).all()


def test_edit_reuses_unchanged_paragraphs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("ab\n é") for _ in range(r.randint(0, 60))) for _ in range(2))
        s = fp.state(fp.paragraphs(a))
        assert (fp.edited_state(a, s, b) == fp.state(fp.paragraphs(fp.edited(a, b)))).all()


def test_likeness():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    a, b = (" ".join(word() for _ in range(400)) for _ in range(2))
    s, t = fp.state(fp.paragraphs(a)), fp.state(fp.paragraphs(b))
    e = fp.state(fp.paragraphs(fp.edited(a, b)))
    assert fp.likeness(s, s) == 1.0 and 0.6 < fp.likeness(s, e) < 0.9 and fp.likeness(s, t) < 0.25


def test_rows(spark, docs, empty):
    out = {}
    for r in fp.fingerprints(docs, 3).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == docs.count()
    order = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    for i, (k, text) in enumerate(order):
        e = fp.edited(text, order[(i + 1) % len(order)][1])
        want = hashlib.sha256(e.encode()).hexdigest()
        assert any(r.edited_sha256 == want and r.n_chars == len(text) and r.edited_fingerprint == fp.text_of(fp.state(fp.paragraphs(e))) for r in out[None if k < 0 else k])
    assert out[2][0].fingerprint == out[3][0].fingerprint and out[1][0].fingerprint == out[4][0].fingerprint
    assert fp.fingerprints(empty).count() == 0
    one = fp.fingerprints(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_same_for_any_partitions(spark, docs):
    a, b = (sorted(map(str, fp.fingerprints(docs, n).collect())) for n in (1, 7))
    assert a == b


def windows(text):
    b = [p for p in text.encode().split(b"\n")]
    return collections.Counter((p + b"\xff" * fp.WINDOW)[i : i + fp.WINDOW] for p in b for i in range(len(p)))


def share(a, b):
    """The likeness, counted."""
    x, y = windows(a), windows(b)
    return 1 - sum((x[w] - y[w]) ** 2 for w in x | y) / (sum(v * v for v in x.values()) + sum(v * v for v in y.values()))


def test_likeness_against_counting():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    for changed in (3, 40, 200, 500):
        a = " ".join(words[:600])
        b = " ".join(words[changed : 600 + changed])
        assert abs(fp.likeness(fp.state(fp.paragraphs(a)), fp.state(fp.paragraphs(b))) - share(a, b)) < 0.12


def test_long_texts_of_one_window():
    for n in (20_000, 40_000, 65_543, 300_000, 3_000_000):
        s = fp.state([b"a" * n])
        assert fp.likeness(s, fp.state([b"a" * (n - 1) + b"b"])) > 0.999
        other = "unlike words of another kind " * 10
        text = "a" * n
        assert 0.9 < fp.likeness(s, fp.edited_state(text, s, other)) <= 1
    assert (fp.state([b"xy" * (fp.SEGMENT + 77)]) == fp.inserted(fp.state([b"xy" * (fp.SEGMENT + 77)]), fp.state([]))).all()


def test_segments_give_the_same_sketch(monkeypatch):
    items = [bytes(random.Random(i).choices(b"abc d", k=997)) for i in range(9)]
    whole = fp.state(items)
    monkeypatch.setattr(fp, "SEGMENT", 100)
    assert (fp.state(items) == whole).all()


def test_many_rows_without_id(spark):
    docs = spark.createDataFrame([(None, f"text {i} of a page without id") for i in range(300)] + [(5, "five")], "doc_id long, text string")
    out = fp.fingerprints(docs, 8)
    assert out.count() == 301 and out.where("doc_id IS NULL").select("edited_sha256").distinct().count() > 290
    assert out.rdd.getNumPartitions() == 8
