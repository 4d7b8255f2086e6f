import random

import duckdb
from pyspark.sql import functions as F

from carrel.llm import linededup as ld

FOOTER = "Accept all cookies on this site to go on reading the text of today with us please."


def own(i: int, n: int) -> str:
    """A line of ``n`` words that no other document has."""
    r = random.Random(i)
    return " ".join("".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(n))


def cleaned(spark, texts):
    rows = list(enumerate(texts))
    return {r.doc_id: r for r in ld.without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


NAMES = [own(1000 + i, 1) for i in range(60)]
CASES = {
    "a footer on short pages": [f"{own(i, 6)}\n{FOOTER}" for i in range(20)],
    "a footer on long pages": [f"{own(i, 30)}\n{FOOTER}" for i in range(20)],
    "a short template in nine documents": [f"{own(i, 20)}\nconnection from {NAMES[i]} closed by the server" for i in range(9)],
    "a variable leading word": [f"{own(i, 20)}\nuser {NAMES[i]} logged in from home today" for i in range(40)],
    "lines that are whole documents": [f"user {NAMES[i]} logged in from home today" for i in range(40)],
    "two templates in a leaf": [f"{own(i, 20)}\nthe server has " + ("opened {} for reading by one of its own users" if i < 20 else "dropped {} because no room was left on disk").format(NAMES[i]) for i in range(40)],
    "three templates in a leaf": [f"{own(i, 20)}\nthe server has " + ("opened {} for reading by one of its own users", "dropped {} because no room was left on disk", "moved everything away to {} before any copy began")[i // 20].format(NAMES[i]) for i in range(60)],
    "variable fields in several places": [f"{own(i, 20)}\nPosted in the section {NAMES[i]} of our news by {NAMES[59 - i]} on a day in May {i}" for i in range(6)],
}


def test_recurring_templates_are_dropped_from_every_document(spark):
    """All cases in one table, the own lines of each document unlike all others, by Spark and by the SQL."""
    rows = []
    for case in sorted(CASES):
        for t in CASES[case]:
            *first, last = t.split("\n")
            kept = "\n".join(own(10_000 + len(rows), len(x.split())) for x in first)
            rows.append((case, kept, f"{kept}\n{last}" if first else last))
    docs = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    out = {r.doc_id: r for r in ld.without_recurring(docs).collect()}
    wrong = [(case, out[i].text) for i, (case, kept, _) in enumerate(rows) if out[i].n_dropped != 1 or out[i].text != kept]
    assert wrong == []
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.values()) == sorted(con.sql(ld.ORACLE).fetchall())


def test_rows_of_unlike_numbers_stay(spark):
    rows = [" ".join(str(random.Random(i).randint(10, 99) + 100 * j * i) for j in range(12)) for i in range(2)]
    texts = [f"{own(i, 20)}\n{rows[i]}" for i in range(2)]
    texts += [f"{own(i, 20)}\n{rows[0][::-1]}" for i in range(2, 4)]
    assert [r.n_dropped for _, r in sorted(cleaned(spark, texts).items())] == [0, 0, 1, 1]


def test_copies_are_no_evidence(spark):
    page = "\n".join(own(100 + i, 12) for i in range(5))
    revised = page.replace(page.split()[20], "revised")
    # What they share with others goes from all of them, and what they share with one another alone stays.
    out = cleaned(spark, [f"{page}\n{FOOTER}", f"{page}\n{FOOTER}", f"{revised}\n{FOOTER}", f"{own(7, 30)}\n{FOOTER}"])
    assert [out[i].text for i in range(4)] == [page, page, revised, own(7, 30)]


def test_oddities(spark, docs, empty):
    out = ld.without_recurring(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text is None and rows[2].n_lines == 0 and rows[3].text == "" and rows[5].text == " \n\t\n "
    assert ld.without_recurring(empty).count() == 0
    twice = ld.without_recurring(out).columns
    assert twice == out.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_ids_and_empty_results(spark):
    rows = [(None, FOOTER), (None, FOOTER), (None, f"{own(1, 20)}\n{FOOTER}"), (5, f"{own(2, 20)}\n\n{FOOTER}")]
    out = ld.without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in out) == sorted([(0, "", 1), (0, "", 1), (0, own(1, 20), 1), (5, own(2, 20) + "\n", 1)])


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    from carrel.llm import common

    texts = CASES["two templates in a leaf"]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert all(r.text == "\n".join(texts[i].split("\n")[:-1]) for i, r in cleaned(spark, texts).items())


def test_only_lines_in_company_are_cut_into_words(spark):
    texts = CASES["variable fields in several places"] + [own(i, 12) for i in range(100, 110)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = ld.line_table(docs)
    assert table.columns == ["doc_id", "t1", "t2", "pos", "n", "h1", "h2", "leaf", "tail"]
    lines = table.groupBy("h1", "h2").agg(*(f(c).alias(a) for f, c, a in ((F.count, "*", "c"), (F.min, "t1", "lo"), (F.max, "t1", "hi"), (F.min, "leaf", "leaf"), (F.min, "tail", "tail"))))
    # The last line of each of the first documents alone shares its leaf, "Posted in the".
    found = ld._in_company(docs, lines.where("leaf IS NOT NULL")).collect()
    assert sorted(r.line for r in found) == sorted({t.split("\n")[1].rsplit(" ", 1)[0] + " <*>" for t in texts[:6]})
