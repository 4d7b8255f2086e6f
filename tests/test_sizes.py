"""Queries over keys and numbers of rows that the small tables do not reach, held against their SQL."""

import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carrel import registry
from carrel.functions import strings as st
from carrel.operators import linkage as ln
from carrel.operators import nlp
from carrel.queries.linking import CFG, _people
from tests.conftest import SMALL, same_rows


def moved(spark, folder, table: str, key: str, keys) -> duckdb.DuckDBPyConnection:
    """Writes ``table`` with the given keys, its rows repeated, to ``folder``; a connection that sees it."""
    one = spark.read.parquet(f"{SMALL}/{table}.parquet").limit(1).drop(key)
    spark.createDataFrame([(k,) for k in keys], f"{key} long").crossJoin(F.broadcast(one)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet/*.parquet'")
    return c


def test_nhs_checksum_of_test_numbers(spark, tmp_path):
    duck = moved(spark, tmp_path, "customer", "c_custkey", range(75600, 75800))
    got = registry.QUERIES["flt_19_nhs_number"](spark, str(tmp_path))
    same_rows(got, duck.sql(registry.ORACLE["flt_19_nhs_number"]))
    assert got.where("ok AND n LIKE '999%'").count()
    assert not got.where(st.is_nhs_number(F.col("n")) & F.col("n").startswith("999")).count()


#: People of the linkage queries are alike where their keys differ by this.
PERIOD = 63000
LINKAGE = ("lnk_02_shortlist", "lnk_04_08_scores", "lnk_11_link", "snk_04_match_result")


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Customers of whom each stands there three times."""
    folder = tmp_path_factory.mktemp("copies")
    return str(folder), moved(spark, folder, "customer", "c_custkey", [k + PERIOD * i for k in range(3, 3000, 13) for i in range(3)])


@pytest.mark.parametrize("name", LINKAGE)
def test_linkage_of_equal_people(spark, copies, name):
    folder, duck = copies
    same_rows(registry.QUERIES[name](spark, folder), duck.sql(registry.ORACLE[name]))


def exchanges(df) -> list[str]:
    """The shuffles of a plan that lie above its first join."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    above = plan.split("Join")[0] if "Join" in plan else plan
    return [line for line in above.splitlines() if "Aggregate" in line or "Exchange" in line]


def test_pairs_are_not_shuffled(spark, copies):
    """What the shortlist and the scores make of each pair goes out as it is: pairs are the square of the people."""
    for name in LINKAGE[:2]:
        assert not exchanges(registry.QUERIES[name](spark, copies[0]))


def test_equal_people_are_scored_once(spark, copies):
    t = registry.Tables(spark, copies[0])
    p, s = _people(t, True), _people(t, False)
    pairs, scored = ln.shortlist(p, s).count(), ln._scored_classes(ln._classes(p)[0], ln._classes(s)[0], CFG)
    assert scored.count() * 9 == pairs


def test_comparison_of_more_people_than_the_population(spark, copies):
    """The SQL states a result for any number of people; the refusal is link's."""
    t = registry.Tables(spark, copies[0])
    p, s, few = _people(t, True), _people(t, False), ln.Config(population=100)
    assert ln.compare(p, s, few).count() == p.count()
    with pytest.raises(ValueError, match="population"):
        ln.link(p, s, few)


@pytest.mark.parametrize("complete_mismatch", [False, True])
def test_shortlist_with_missing_dates(spark, complete_mismatch):
    day = datetime.date
    dobs = [None, day(1970, 1, 2), day(1970, 1, 3), day(1970, 5, 2), day(1981, 1, 2), day(1990, 7, 8)]
    p, s = (spark.createDataFrame([(f"{w}{i}", d) for i, d in enumerate(dobs)], "id string, dob date") for w in "ps")
    want = set()
    for i, a in enumerate(dobs):
        for j, b in enumerate(dobs):
            same = a and b and [a == b, (a.month, a.day) == (b.month, b.day), (a.year, a.day) == (b.year, b.day), (a.year, a.month) == (b.year, b.month)]
            at = same.index(True) + 1 if same and any(same) else 6 if not a or (b and complete_mismatch) else None if b else 5
            if at:
                want.add((f"p{i}", f"s{j}", at))
    got = [tuple(r) for r in ln.shortlist(p, s, complete_mismatch).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_notes_are_read_once(monkeypatch):
    """Rows as note by note, for notes of none, one and several rows; each text is cut into tokens once."""
    texts = ["CRP 5 mg/L, Na 140, K 4.1", "well, 3 days", "CRP 5 mg/L, Na 140, K 4.1", "BP 120/80", "BP 120/80", "", "well, 3 days"]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, None, 9, 10, 11, 12], pa.int64()), pa.array(texts)], names=["pk", "note"])
    chosen = list(nlp.PROCESSORS.values())
    want = [(k, p.name, f.value, f.value2, f.start) for k, x in zip(batch.column(0).to_pylist(), texts, strict=True) for p, f in nlp.parse(nlp.tokens(x), chosen)]
    seen, cut = [], nlp.tokens
    monkeypatch.setattr(nlp, "tokens", lambda x: seen.append(x) or cut(x))
    monkeypatch.setattr(nlp, "PUT_OUT", 3)
    got = [(r["pk"], r["processor"], r["value"], r["value2"], r["start"]) for b in nlp._rows(batch, chosen) for r in b.to_pylist()]
    assert len(want) == 8 and got == want
    assert sorted(seen) == sorted(set(texts))


def test_many_short_notes_in_one_file_are_many_tasks(spark, tmp_path):
    spark.range(50_000).selectExpr("id", "concat('CRP ', id % 50) AS note").coalesce(1).write.parquet(f"{tmp_path}/notes")
    found = nlp.run(spark.read.parquet(f"{tmp_path}/notes"), "id", "note", ["CRP"])
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and sum(r["count"] for r in parts) == 50_000
