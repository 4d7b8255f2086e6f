"""Queries that SQL cannot express, held against other programs, known values or a walk by hand."""

import hashlib
import hmac

import xxhash

from carrel import registry
from carrel.functions.metaphone import metaphone
from carrel.operators import linkage as ln
from carrel.operators import nlp
from carrel.operators import relational as rel
from carrel.plans.dictionary import Dictionary, Rule, annotated, hints, is_text
from carrel.sources import files
from carrel.streaming.requests import Queue
from tests.conftest import SMALL


def rows(spark, name):
    return registry.QUERIES[name](spark, SMALL).collect()


def test_sha512(spark):
    assert all(r.h == hmac.new(b"k", str(r.c_custkey).encode(), "sha512").hexdigest() for r in rows(spark, "hash_01_sha512"))


def test_hash64(spark):
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{SMALL}/customer.parquet").collect()}
    for r in rows(spark, "hash_03_hash64"):
        assert r.h % 2**64 == xxhash.xxh64_intdigest(names[r.c_custkey].encode(), 42)


def test_scrubber_hash_is_keyed(spark):
    got = rows(spark, "scr_09_scrubber_hash")
    assert len({r.scrubber_hash for r in got}) == len(got) and all(len(r.scrubber_hash) == len(hashlib.md5().hexdigest()) for r in got)


def test_names_that_sound_alike():
    for a, b in (("Smith", "Smyth"), ("Philip", "Filip"), ("Wright", "Rite"), ("Catherine", "Katherine"), ("Jon", "John"), ("Stephen", "Stefen"), ("Knight", "Nite"), ("Clark", "Klark")):
        assert metaphone(a) == metaphone(b) != "", (a, b)
    for a, b in (("Smith", "Jones"), ("Brown", "Green"), ("Taylor", "Baker")):
        assert metaphone(a) != metaphone(b)


def test_metaphone_query(spark):
    assert all(r.code == metaphone(r.n_name) for r in rows(spark, "str_12_metaphone"))


def test_best_pairs_query(spark):
    for r in rows(spark, "lnk_10_best_pairs")[:200]:
        k = float(r.c_custkey)
        m = [[k % 7 - 2, k % 5 - 1], [k % 3, k % 11 - 6]]
        assert abs(r.unordered - ln.best_pairs(m)) < 1e-9 and abs(r.ordered - ln.best_pairs(m, True, 0.1)) < 1e-9


def test_mutated_names(spark):
    for r in rows(spark, "lnk_15_mutated"):
        assert len(r.name) == len(r.mutated) and sum(a != b for a, b in zip(r.name, r.mutated, strict=True)) == 1


def test_external_program(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = rows(spark, "np_39_external_program")
    assert got and all(r.n == len(texts[r.pk]) for r in got)


def test_documents_of_all_processors(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = sorted((k, p.name, f.start) for k, t in texts.items() for p in nlp.PROCESSORS.values() for f in p.parse(t))
    assert sorted((r.pk, r.processor, r.start) for r in rows(spark, "nlp_documents")) == want


def test_registry(spark):
    assert {(r.processor, r.target) for r in rows(spark, "nlp_registry")} == {(p.name, p.target) for p in nlp.PROCESSORS.values()} and len(nlp.PROCESSORS) == 38


def test_draft(spark):
    got = {(r.table_name, r.column_name): r for r in rows(spark, "dd_01_draft")}
    assert got["customer", "c_custkey"].pid and got["orders", "o_custkey"].pid and got["orders", "o_orderkey"].pk


def test_queue(spark, tmp_path):
    q = Queue(spark, f"file://{tmp_path}/q")
    assert q.show().count() == 0 and q.work(lambda d: d) == 0
    q.put(spark.createDataFrame([("a", "x", "one"), ("b", "x", "two"), ("c", "y", None)], "request_id string, client string, text string"), "1")
    q.delete(spark.createDataFrame([("b",)], "request_id string"), "d")
    assert {(r.request_id, r.state) for r in q.show().collect()} == {("a", "waiting"), ("b", "deleted"), ("c", "waiting")}
    assert q.fetch("x").count() == 0 and q.work(lambda d: d.selectExpr("request_id", "upper(text) AS result")) == 1 and q.work(lambda d: d) == 0
    assert [tuple(r) for r in q.fetch("x").collect()] == [("a", "ONE")] and [tuple(r) for r in q.fetch("y").collect()] == [("c", None)]
    q.delete(spark.createDataFrame([("a",)], "request_id string"), "e")
    assert q.fetch("x").count() == 0


def test_remote_processor_with_several_results(spark, tmp_path):
    q = Queue(spark, f"file://{tmp_path}/r")
    notes = spark.createDataFrame([(1, "two"), (2, "none"), (3, None)], "pk long, note string")
    replies = nlp.remote(notes, "pk", "note", q, "b")
    q.work(lambda d: d.where("text = 'two'").selectExpr("request_id", """'[{"value": 1.5}, {"value": 2}]' AS result"""))
    assert sorted(tuple(r) for r in replies("value double").collect()) == [(1, 1.5), (1, 2.0)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "k long, v string")
    zips = files.zipped(df.coalesce(1), "t", member_rows=1)
    assert zips.count() >= 1
    assert sorted(r.line for r in files.unzipped(zips).collect() if r.line != "k\tv") == ["1\ta b", "2\t"]
    ((name, back),) = files.xlsx_rows(files.xlsx({"t": df}))
    assert name == "t" and back == [["k", "v"], ["1", "a\tb"], ["2"]] or back == [["k", "v"], ["1", "a\tb"], ["2", None]]


def test_id_types_and_texts(spark):
    a, b = spark.createDataFrame([], "pid int"), spark.createDataFrame([], "pid string, t string")
    d = Dictionary([Rule("a", "pid", pid=True, defines=True), Rule("b", "pid", pid=True)])
    assert d.id_types({"a": a, "b": b}) == [("a.pid", "int", True), ("b.pid", "string", False)]
    assert is_text(b.schema["t"].dataType) and not is_text(b.schema["t"].dataType, 5, 10) and not is_text(a.schema["pid"].dataType)


def test_hints(spark):
    assert hints("t", "SurnameAtBirth")[0][1] == "patient" and hints("t", "amount") == []
    d, notes = annotated({"t": spark.createDataFrame([], "IDPatient long, Forename string, amount int")})
    assert d.one("t", "pid").column == "IDPatient" and [f for f, _ in notes] == ["t.IDPatient", "t.Forename"]


def test_geography_of_repeated_postcodes(spark):
    places = spark.createDataFrame([("A", "y"), ("A", "x"), ("A", None), ("B", None)], "p string, area string")
    out = rel.with_geography(spark.createDataFrame([("A",), ("B",), ("C",)], "q string"), places, "q", "p", {"area": "area"})
    assert sorted(map(tuple, out.collect()), key=str) == [("A", "x"), ("B", None), ("C", None)]
