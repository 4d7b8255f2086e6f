import datetime
import math

import pytest

from carrel.operators import linkage as ln
from carrel.operators import relational as rel
from carrel.plans import etl
from carrel.plans.dictionary import Dictionary, DraftSettings, Keys, Rule, draft
from carrel.plans.research import Catalog, Select, Table, condition, filled, identity, privileged


def test_rules_are_checked():
    bad = Dictionary([Rule("t", "a", pid=True, mpid=True), Rule("t", "b", add_hash=True), Rule("t", "b", dest_column="c"), Rule("t", "d", dest_column="_src_hash"), Rule("t", "e", alter=("truncate_date", "scrub")), Rule("t", "f", addition_only=True)])
    text = " ".join(bad.errors())
    for part in ("at most one of pid", "unique index", "occurs twice", "reserved", "stands alone", "addition_only needs", "nothing defines"):
        assert part in text
    assert Dictionary([]).errors() == ["empty dictionary"]


def test_dictionary_round_trip(tmp_path):
    d = Dictionary([Rule("t", "a", pid=True, defines=True), Rule("t", "b", include=("x", None), alter=("scrub",))])
    d.save(str(tmp_path / "d.tsv"))
    assert Dictionary.load(str(tmp_path / "d.tsv")).rules == d.rules
    assert [r.omit for r in d.filtered(omit=["t.b"]).rules] == [False, True]


def test_draft(spark):
    df = spark.createDataFrame([(1, "Ann", "long text", None)], "patient_id long, forename string, note string, dob date")
    d = draft({"patient": df}, DraftSettings(patient_sources=("patient.forename",)), {"patient.note": 500})
    by = {r.column: r for r in d.rules}
    assert by["patient_id"].pid and by["patient_id"].defines and by["patient_id"].to_column == "rid"
    assert by["forename"].omit and by["forename"].scrub_method == "words"
    assert by["note"].alter == ("scrub",) and by["dob"].alter == ("truncate_date",)
    assert draft({"patient": df}, DraftSettings(), known=d).rules == []


def test_full_run_and_opt_out(spark):
    people = spark.createDataFrame([(1, "Ann", False), (2, "Bob", True), (3, None, None)], "pid long, name string, optout boolean")
    notes = spark.createDataFrame([(10, 1, "Ann and Bob"), (11, 2, "Bob"), (12, 3, "x"), (13, None, "y")], "id long, pid long, note string")
    d = Dictionary([Rule("people", "pid", "bigint", pid=True, defines=True, dest_column="rid"), Rule("people", "name", omit=True, scrub_source="patient", scrub_method="words"), Rule("people", "optout", "boolean", omit=True, opt_out=True), Rule("notes", "id", "bigint", pk=True, add_hash=True, index="unique"), Rule("notes", "pid", "bigint", pid=True, dest_column="rid"), Rule("notes", "note", alter=("scrub",))])
    out = etl.run({"people": people, "notes": notes}, d, Keys())
    assert {r.id: r.note for r in out["notes"].collect()} == {10: "[__PPP__] and Bob", 12: "x"}
    assert out["people"].count() == 2


def test_incremental_equals_full(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h3")], "id long, v string, _src_hash string")
    new = spark.createDataFrame([(1, "a", "h1"), (2, "B", "h9"), (4, "d", "h4")], "id long, v string, _src_hash string")
    got = sorted(tuple(r) for r in etl.incremental(old, new, "id").collect())
    assert got == sorted(tuple(r) for r in new.collect())
    assert etl.incremental(old, new, "id", addition_only=True).count() == 4


def test_joins_are_inferred():
    c = Catalog({t.name: t for t in (Table("a", "d1", ("trid", "x"), mrid="mrid"), Table("b", "d1", ("trid", "y")), Table("c", "d2", ("z",)), Table("d", "d3", ("w",), rid=None, mrid="mrid", family="f"), Table("e", "d3", ("v",), rid=None, family="f"))})
    assert Select(c).add_column("a", "x").add_column("b", "y").sql() == "SELECT a.x, b.y FROM a INNER JOIN b ON b.trid = a.trid"
    assert "c.rid = b.rid" in Select(c).add_column("b", "y").add_column("c", "z").sql()
    assert Select(c).add_column("b", "y").add_column("e", "v").sql().count("JOIN") == 3
    assert Select(c).add_column("a", "x").set_distinct().add_where("a.x > 5").add_where("a.x < 9", how="OR", bracket=True).sql() == "SELECT DISTINCT a.x FROM a WHERE a.x > 5 OR (a.x < 9)"
    with pytest.raises(KeyError):
        Select(c).add_column("unknown", "x")
    with pytest.raises(ValueError):
        Select(Catalog({t.name: t for t in (Table("a", "d1", ()), Table("d", "d3", (), rid=None, family="f"))})).add_table("a").add_table("d")


def test_conditions():
    assert condition("a", "IN", ["x", "o'y"]) == "a IN ('x', 'o''y')"
    assert condition("a", "<=", 5, "number") == "a <= 5"
    assert condition("a", "IS NULL") == "a IS NULL"
    with pytest.raises(ValueError):
        condition("a", "; DROP", 1)
    assert identity("SELECT  1") == identity("SELECT 1")
    assert filled("a = [[x]]", {"x": "1"}) == "a = 1"
    assert privileged("~pid = 'a' OR ~pid IN ('a', 'b')", {"a": "r1"}) == "rid = 'r1' OR rid IN ('r1', '')"


def test_best_pairs():
    assert ln.best_pairs([[None]]) == 0.0
    assert ln.best_pairs([[3.0]]) == 3.0
    assert ln.best_pairs([[5.0, -1.0], [-1.0, 4.0]]) == pytest.approx(9 - math.log(2))
    assert ln.best_pairs([[5.0, -1.0], [-1.0, 4.0]], True, 0.1) == pytest.approx(9 + math.log(0.9))
    assert ln.best_pairs([[-1.0, 5.0], [4.0, -1.0]], True, 0.1) == pytest.approx(9 + math.log(0.1) - math.log(1))


def test_link_refuses_bad_input(spark):
    people = spark.createDataFrame([("a",), ("a",)], "id string")
    with pytest.raises(ValueError):
        ln.link(people, people)


FREQ = {"p_name": 1e-3, "p_code": 1e-3, "p_two": 1e-3}
_NAME = "name string, code string, two string"
_P_NAME = _NAME + ", p_name double, p_code double, p_two double"
_PEOPLE = "id string, dob date, gender string, perfect_id string, "
_TIME = "start date, end date"
SINGLE = ", forename string, forename_code string, postcode string"
P_SINGLE = SINGLE + ", f_name double, f_code double, f_two double, p_unit double, p_sector double"


def _parts(*names: str, freq: bool = False) -> list[tuple]:
    return [(n, n[:4], n[:2], *(FREQ.values() if freq else ())) for n in names]


def test_link_by_perfect_ids_and_surname_fragments(spark):
    own, other = datetime.date(1970, 1, 2), datetime.date(1999, 9, 9)
    single, freq = ("ANNA", "ANNA", "CB1 1AA"), (1e-3, 1e-3, 1e-3, 1e-6, 1e-4)
    p = spark.createDataFrame([("p1", own, "F", "NHS:12", _parts("QUILL", freq=True), *single, *freq), ("p2", own, "F", None, _parts("SMITH-JONES", "JONES", "SMITH", freq=True), *single, *freq)], f"{_PEOPLE}surname_fragments array<struct<{_P_NAME}>>{P_SINGLE}")
    s = spark.createDataFrame([("s1", other, "M", "nhsnum:12", _parts("BLAKE"), "BOB", "BOB", None), ("s2", own, "F", "nhsnum:13", _parts("JONES"), *single), ("s3", own, "F", None, _parts("WEBER"), *single)], f"{_PEOPLE}surname_fragments array<struct<{_NAME}>>{SINGLE}")
    out = {r.proband_id: r for r in ln.link(p, s, translate={"nhs": "nhsnum"}).collect()}
    assert (out["p1"].match_id, out["p1"].log_odds, out["p1"].second_best, out["p1"].p_match) == ("s1", math.inf, -math.inf, 1.0)
    # The part is a full match with the part's frequency; the other surname is none.
    ep1, ep2, en = (e[0] for e in (ln.Config().surname_ep1, ln.Config().surname_ep2, ln.Config().surname_en))
    full, none = math.log(1 - ep1 - ep2 - en) - math.log(1e-3), math.log(en) - math.log(1 - 3e-3)
    assert out["p2"].match_id == "s2" and out["p2"].log_odds - out["p2"].second_best == pytest.approx(full - none)


def test_scores_of_several_names_and_postcodes(spark):
    day, cfg = datetime.date, ln.Config()
    dob, free = day(1970, 1, 2), (None, None)
    name = lambda n, *when, freq=False: (*_parts(n, freq=freq)[0], *(when or free))
    sur = lambda n, *when, freq=False: (_parts(n, freq=freq), *(when or free))
    shape = lambda n, pc: f"{_PEOPLE}forenames array<struct<{n}, {_TIME}>>, surnames array<struct<fragments: array<struct<{n}>>, {_TIME}>>, postcodes array<struct<{pc}, {_TIME}>>"
    p = spark.createDataFrame([("p", dob, "F", None, [name("ANNA", freq=True), name("MARIA", freq=True)], [sur("OLDE", day(1990, 1, 1), day(1999, 1, 1), freq=True), sur("NEWE", day(1999, 1, 2), None, freq=True)], [("CB1 1AA", 1e-6, 1e-4, *free), ("CB2 2BB", 1e-6, 1e-4, *free)])], shape(_P_NAME, "postcode string, p_unit double, p_sector double"))
    s = spark.createDataFrame([
        ("order", dob, "F", None, [name("ANNA"), name("MARIA")], [sur("NEWE")], [("CB2 2BB", *free)]),
        ("other", dob, "F", None, [name("MARIA"), name("ANNA")], [sur("NEWE")], [("CB2 2BB", *free)]),
        ("early", dob, "F", None, [name("ANNA"), name("MARIA")], [sur("NEWE", day(1980, 1, 1), day(1985, 1, 1))], [("CB2 2BB", *free)]),
        ("blank", dob, "F", None, None, [], None),
    ], shape(_NAME, "postcode string"))
    pairs = s.selectExpr("'p' AS proband_id", "id AS candidate_id", "1 AS priority")
    got = {r.candidate_id: r.log_odds for r in ln.score_pairs(pairs, p, s, cfg).collect()}
    full = lambda *e: math.log(1 - sum(x[0] for x in e)) - math.log(1e-3)
    fore, last = full(cfg.forename_ep1, cfg.forename_ep2, cfg.forename_en), full(cfg.surname_ep1, cfg.surname_ep2, cfg.surname_en)
    unit = 1e-6 * cfg.k_postcode * (1 - cfg.k_pseudo * cfg.unknown_postcode)
    post = math.log(1 - cfg.postcode_ep - cfg.postcode_en) - math.log(unit)
    in_order, out_of_order = math.log(1 - cfg.forename_unordered), math.log(cfg.forename_unordered)
    assert got["order"] - got["blank"] == pytest.approx(2 * fore + in_order + last + post)
    assert got["order"] - got["other"] == pytest.approx(in_order - out_of_order)
    # A surname of another time is not compared.
    assert got["order"] - got["early"] == pytest.approx(last)


def test_types_and_profiles(spark):
    d = spark.createDataFrame([("1", "x", "2020-01-01", "1.5", "yes", ""), ("2", "y", None, "2", "no", None)], "a string, b string, c string, d string, e string, f string")
    assert rel.infer_types(d, ["a", "b", "c", "d", "e", "f"]) == {"a": "bigint", "b": "string", "c": "date", "d": "double", "e": "boolean", "f": "string"}
    assert [f.dataType.simpleString() for f in rel.cast_inferred(d, rel.infer_types(d)).schema.fields][:5] == ["bigint", "string", "date", "double", "boolean"]
    p = rel.profile(d, "b").first()
    assert (p.n_distinct, p.n_null, p.least, p.greatest, p["values"]) == (2, 0, "x", "y", "x|y")


def test_upsert_and_chains(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    assert sorted(tuple(r) for r in rel.upsert(old, new, ["k"], [new["v"]]).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    with pytest.raises(ValueError):
        rel.same_rows(old, new)
