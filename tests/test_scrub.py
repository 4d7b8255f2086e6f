import datetime
import random

import pytest

from carrel.functions.metaphone import metaphone
from carrel.functions.strings import first_letters, surname_fragments, to_ascii
from carrel.operators import patterns as rx
from carrel.operators import scrub as sc


def test_nonspecific():
    n = sc.Nonspecific(postcodes=True, digits=(10, 11), dates=True, emails=True, date_replacement="%b %Y")
    assert n.scrub("3 Sep 2010 CB2 3EB 01223 123456 a.b@c.org; 31 Feb 2011; 2012-05-07; 20130102; sep/4/99") == "Sep 2010 [~~~] [~~~] [~~~]; [~~~]; May 2012; Jan 2013; Sep 1999"
    with pytest.raises(ValueError):
        sc.Nonspecific(dates=True, date_replacement="%d %b")


@pytest.mark.parametrize("text", ["7 Feb 1980", "07/02/80", "2/7/1980", "1980-02-07", "7th February 1980", "Feb 7, 80"])
def test_one_date(text):
    assert rx.compiled([rx.date(datetime.date(1980, 2, 7))]).fullmatch(text)


def test_personal():
    values = [("patient", "words", "John Smith-Jones"), ("patient", "date", "1980-02-07"), ("patient", "number", "123 4567"), ("third_party", "phrase", "5 High Street"), ("patient", "code", "AB/12"), ("patient", "words", "x")]
    p = sc.Personal(values, sc.Options(alternatives=(("Street", "St", "Road"),)))
    assert p.scrub("john SMITH, 7th Feb 1980, 1234567 not 91234567; at 5 high st; ab-12; Smithers x") == "[__PPP__] [__PPP__], [__PPP__], [__PPP__] not 91234567; at [__TTT__]; [__PPP__]; Smithers x"
    assert p.scrub(None) is None


def test_needles_change_nothing():
    """Patterns that are left out because a note lacks their needle would not have matched."""
    r = random.Random(3)
    values = [("patient", "words", "Ann-Marie O'Neil"), ("patient", "date", "1980-02-07"), ("third_party", "number", "+44 (0)12 34"), ("patient", "code", "ab-1/2"), ("third_party", "phrase", "5 High Street"), ("patient", "phrase_unless_numeric", "77 12"), ("patient", "words", "Zoë"), ("patient", "date", "none")]
    bits = ["ANN", "marie", "o'neil", "neil", "7/2/80", "Feb 7th, 1980", "4401234", "44 0 12-34", "AB12", "a.b.1.2", "5 high  street", "5, HIGH St", "7712", "77-12", "ZOË", "zoe", "x", "\u212a", "80", "1980"]
    for o in (sc.Options(), sc.Options(typos=1), sc.Options(alternatives=(("Street", "St"),), suffixes=("s",))):
        p = sc.Personal(values, o)
        for _ in range(300):
            text = r.choice([" ", ", ", "-"]).join(r.choices(bits, k=r.randint(0, 6)))
            want = text
            for kind, mark in (("patient", o.patient), ("third_party", o.third_party)):
                want = rx.compiled([x for x, _ in p.patterns[kind]]).sub(mark, want)
            assert p.scrub(text) == want


def test_typos_and_words():
    assert sc.Personal([("patient", "words", "Smith")], sc.Options(typos=1)).scrub("Smyth Smith Smythe") == "[__PPP__] [__PPP__] Smythe"
    assert sc.WordList(["new york", "york"]).scrub("In New York, yorkish YORK") == "In [~~~], yorkish [~~~]"
    assert "PARIS" in sc.WordList(["paris"])


def test_notes_by_patient(spark):
    notes = spark.createDataFrame([(1, "Ann saw Bob"), (2, "Ann saw Bob"), (None, "Ann"), (1, None)], "pid long, note string")
    who = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (2, None)], "pid long, name string")
    out = sc.scrub_notes(notes, "pid", ["note"], sc.scrub_source(who, "pid", {"name": "words"}))
    assert sorted(map(str, ((r.pid, r.note) for r in out.collect()))) == sorted(map(str, [(1, "[__PPP__] saw Bob"), (2, "Ann saw [__PPP__]"), (None, "Ann"), (1, None)]))


def test_scrubber_hash_follows_values_and_settings(spark):
    who = spark.createDataFrame([(1, "Ann")], "pid long, name string")
    v = sc.patient_values(sc.scrub_source(who, "pid", {"name": "words"}))
    a, b, c = (sc.scrubber_hash(x, o, "k").first()[1] for x, o in ((v, sc.Options()), (v, sc.Options(typos=1)), (sc.patient_values(sc.scrub_source(who, "pid", {"name": "phrase"})), sc.Options())))
    assert len({a, b, c}) == 3


def test_dicts():
    assert sc.scrub_dicts({"a": "Ann 5"}, {"words": ["Ann"]}) == {"a": "[__PPP__] 5"}


def test_names():
    assert surname_fragments("van Beethoven-Müller") == ["VANBEETHOVENMÜLLER", "BEETHOVEN", "MUELLER", "MULLER", "MÜLLER", "VANBEETHOVENMUELLER", "VANBEETHOVENMULLER"]
    assert to_ascii("Straße Clérambault") == "Strasse Clerambault"
    assert [metaphone(x) for x in ("Smith", "Smythe", "Alec", "Mary Ellen", "D'Souza", "")] == ["SM0", "SM0", "ALK", "MRLN", "TSS", ""]
    assert first_letters("Sept", 3) == "Sep(?:t)?"
