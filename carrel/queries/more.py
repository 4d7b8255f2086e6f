"""Files, patterns, dictionaries, schemas, and what else the other modules leave."""

from __future__ import annotations

import datetime
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from carrel.functions import strings as st
from carrel.operators import linkage as ln
from carrel.operators import nlp
from carrel.operators import patterns as rx
from carrel.operators import relational as rel
from carrel.operators import scrub as sc
from carrel.plans import etl
from carrel.plans.dictionary import Dictionary, DraftSettings, Rule, annotated, draft, hints, is_text
from carrel.queries.identity import KEYS, _dictionary
from carrel.queries.linking import CFG, FORENAMES
from carrel.queries.research import CATALOG
from carrel.registry import Tables, query
from carrel.sources import files
from carrel.sources.workspace import put, scratch
from carrel.streaming.requests import Queue

c = F.col


# Files

@query("src_06_delimited", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def _(t: Tables):
    path = scratch(t.spark, "tsv")
    t.nation.select("n_nationkey", "n_name").write.csv(path, sep="\t", header=True)
    return files.delimited(t.spark, path)


def _zip(sheets: dict[str, pd.DataFrame]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, df in sheets.items():
            z.writestr(f"{name}.csv", df.to_csv(index=False))
    return out.getvalue()


@query("src_07_zip", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a.txt' ELSE 'b.txt' END AS member, n_name AS line FROM nation")
def _(t: Tables):
    """A zip for each row, for odd ones inside another zip."""
    def zips(batches):
        for b in batches:
            rows = []
            for k, name in zip(b["n_nationkey"], b["n_name"], strict=True):
                inner, outer = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    z.writestr("b.txt" if k % 2 else "a.txt", f"{k}|{name}")
                if k % 2:
                    with zipfile.ZipFile(outer, "w") as z:
                        z.writestr("more.zip", inner.getvalue())
                rows.append((outer if k % 2 else inner).getvalue())
            yield pd.DataFrame({"content": rows})

    lines = files.unzipped(t.nation.mapInPandas(zips, "content binary"))
    return lines.select(F.substring_index("line", "|", 1).cast("long").alias("n_nationkey"), "member", F.substring_index("line", "|", -1).alias("line"))


@query("src_08_auto_import", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(t: Tables):
    path = scratch(t.spark, "import") + ".zip"
    put(t.spark, path, _zip({"region": t.region.toPandas()}))
    return files.auto_import(t.spark, path)["region"]


@query("src_09_people", "SELECT s_suppkey::VARCHAR AS local_id, 'ANN' AS forename, DATE '2001-02-03' AS since FROM supplier")
def _(t: Tables):
    path = scratch(t.spark, "people") + ".csv"
    d = t.supplier.select(c("s_suppkey").cast("string").alias("local_id"), F.lit("ANN/2001-02-03/;BEA").alias("forenames"), F.lit("LOW").alias("surnames"), F.lit("1990-01-01").alias("dob"), F.lit("F").alias("gender"), F.lit("CB2 3EB").alias("postcodes"), F.lit("nhs:5").alias("perfect_id"), F.lit("").alias("other_info"))
    d.write.csv(path, header=True)
    first = F.get(files.temporal(c("forenames")), F.lit(0))
    return files.people(t.spark, path).select("local_id", first["name"].alias("forename"), first["from"].alias("since"))


@query("src_10_postcode_directory", "SELECT 'CB' || n_nationkey || ' 1AA' AS pcds, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey::DOUBLE END AS imd, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE DATE '1980-06-01' END AS dointr, 'CB' || n_nationkey || '1AA' AS pcd_nospace FROM nation")
def _(t: Tables):
    k, path = c("n_nationkey"), scratch(t.spark, "postcodes") + ".csv"
    raw = t.nation.select(F.concat(F.lit("CB"), k.cast("string"), F.lit(" 1AA")).alias("pcds"), F.when(k % 4 == 0, "  ").otherwise(c("n_regionkey").cast("string")).alias("imd"), F.when(k % 3 == 0, "").when(k % 3 == 1, "198006").otherwise("1980-06-01").alias("dointr"))
    raw.write.csv(path, header=True)
    return files.postcode_directory(t.spark, path)


@query("src_11_documents", "SELECT s_suppkey, s_name || ' & co' AS text FROM supplier WHERE s_suppkey % 3 <> 2")
def _(t: Tables):
    k = c("s_suppkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("<p>"), c("s_name"), F.lit(" &amp; co</p>"))).otherwise(F.concat(c("s_name"), F.lit(" & co")))
    d = t.supplier.select("s_suppkey", body.cast("binary").alias("content"), F.when(k % 3 == 0, "html").when(k % 3 == 1, "txt").otherwise("exe").alias("ext"))
    return files.document_texts(d, "content", "ext", skip_failed=True).select("s_suppkey", "text")


@query("prj_13_skip_failed", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def _(t: Tables):
    d = t.supplier.select("s_suppkey", c("s_name").cast("binary").alias("content"), F.when(c("s_suppkey") % 2 == 0, "txt").otherwise("docx").alias("ext"))
    return files.document_texts(d, "content", "ext", skip_failed=True).select("s_suppkey")


@query("src_12_id_list", "SELECT c_custkey AS id FROM customer")
def _(t: Tables):
    path = scratch(t.spark, "ids")
    t.customer.select(F.concat(c("c_custkey").cast("string"), F.lit("  word")).alias("value")).write.text(path)
    return files.ids(t.spark, path, "bigint")


@query("snk_03_tsv", "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def _(t: Tables):
    path = scratch(t.spark, "export")
    files.tsv(t.part.select("p_partkey", "p_name"), path)
    return t.spark.read.csv(path, sep="\t", header=True)


@query("snk_05_people", "SELECT s_suppkey AS id, s_name AS surname FROM supplier")
def _(t: Tables):
    path = scratch(t.spark, "people-json")
    t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("surname")).write.json(path)
    return t.spark.read.schema("id long, surname string").json(path)


@query("snk_06_schema_check", "SELECT * FROM (VALUES ('missing', 'c_other'), ('extra', 'c_acctbal')) AS x(kind, column_name)")
def _(t: Tables):
    return t.spark.createDataFrame(rel.schema_difference(t.customer, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_other"]), "kind string, column_name string")


@query("snk_03_zip", "SELECT p_partkey, p_name FROM part")
def _(t: Tables):
    """Zipped TSV, made in the executors and read back."""
    lines = files.unzipped(files.zipped(t.part.select("p_partkey", "p_name"), "part")).where("line NOT LIKE 'p_partkey%'")
    return lines.select(F.substring_index("line", "\t", 1).cast("long").alias("p_partkey"), F.substring_index("line", "\t", -1).alias("p_name"))


@query("snk_03_xlsx", "SELECT s_suppkey::BIGINT AS s_suppkey, s_name FROM supplier")
def _(t: Tables):
    """A workbook, read back with its types inferred."""
    path = scratch(t.spark, "export") + ".xlsx"
    put(t.spark, path, files.xlsx({"supplier": t.supplier.select("s_suppkey", "s_name")}))
    return files.auto_import(t.spark, path)["supplier"]


@query("snk_07_unique_index", "SELECT 'customer' AS table_name, TRUE AS is_unique UNION ALL SELECT 'lineitem', FALSE")
def _(t: Tables):
    rows = [(n, rel.duplicates(getattr(t, n), [k]).limit(1).count() == 0) for n, k in (("customer", "c_custkey"), ("lineitem", "l_orderkey"))]
    return t.spark.createDataFrame(rows, "table_name string, is_unique boolean")


# Columns and schemas

@query("flt_12_13_text_columns", "SELECT p_partkey, p_brand FROM part")
def _(t: Tables):
    """Drops texts longer than a limit, and texts that are scrubbed."""
    return rel.readable_columns(t.part, {"p_name": 55, "p_type": 300, "p_brand": 10}, 100, {"p_name"}).drop("p_size", "p_retailprice")


@query("flt_16_patterns", "SELECT * FROM (VALUES ('orders.o_orderdate'), ('orders.o_orderkey'), ('orders.o_orderpriority')) AS x(field)")
def _(t: Tables):
    fields = rel.matching_fields({"orders": t.orders, "nation": t.nation}, ["orders.*order*", "nation.*"], ["*.o_orderstatus", "nation.*"])
    return t.spark.createDataFrame([(f,) for f in fields], "field string")


@query("flt_22_dictionary_rows", "SELECT * FROM (VALUES ('customer.c_custkey', FALSE), ('customer.c_mktsegment', TRUE), ('customer.c_name', TRUE), ('customer.c_optout', TRUE)) AS x(field, omitted)")
def _(t: Tables):
    d = _dictionary().filtered(omit=["customer.c_m*"], drop=["orders.*"])
    return t.spark.createDataFrame([(f"{r.table}.{r.column}", r.omit) for r in d.rules], "field string, omitted boolean")


@query("prj_22_display_columns", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(t: Tables):
    return t.orders.where("o_orderstatus = 'P'").select(["o_orderkey", "o_totalprice"])


@query("type_02_03_checks", "SELECT * FROM (VALUES ('customer.c_custkey', 'bigint', TRUE, FALSE), ('orders.o_custkey', 'bigint', TRUE, FALSE), ('customer.c_name', 'string', FALSE, TRUE)) AS x(field, kind, joins, textual)")
def _(t: Tables):
    """Which id columns can be joined with the one that defines patients, and which are texts."""
    d = Dictionary([Rule("customer", "c_custkey", pid=True, defines=True), Rule("orders", "o_custkey", pid=True), Rule("customer", "c_name", third_party_pid=True)])
    tables = {"customer": t.customer, "orders": t.orders}
    rows = [(f, k, j, is_text(tables[f.split(".")[0]].schema[f.split(".")[1]].dataType, 25, 20)) for f, k, j in d.id_types(tables)]
    return t.spark.createDataFrame(rows, "field string, kind string, joins boolean, textual boolean")


@query("agg_13_catalogue", "SELECT * FROM (VALUES ('customer', 5, 1), ('nation', 3, 2), ('region', 2, 0)) AS x(table_name, n_columns, n_keys)")
def _(t: Tables):
    rows = rel.catalogue({n: getattr(t, n) for n in ("customer", "nation", "region")}, {"customer": ["c_custkey"], "nation": ["n_nationkey", "n_regionkey"]})
    return t.spark.createDataFrame(rows, "table_name string, n_columns int, n_keys int")


@query("qb_02_inference", "SELECT * FROM (VALUES ('q_record', 'q_patient', 1), ('q_record', 'q_event', 1), ('q_record', 'q_other_line', 3), ('q_record', 'q_record', 0)) AS x(a, b, n_joins)")
def _(t: Tables):
    from carrel.plans.research import Select

    pairs = [("q_record", b) for b in ("q_patient", "q_event", "q_other_line", "q_record")]
    return t.spark.createDataFrame([(a, b, len(Select(CATALOG).add_table(a).add_table(b).joins)) for a, b in pairs], "a string, b string, n_joins int")


@query("qb_09_default_dates", "SELECT * FROM (VALUES ('q_patient', NULL), ('q_record', 'created_at'), ('q_event', NULL)) AS x(table_name, date_column)")
def _(t: Tables):
    return t.spark.createDataFrame([(n, CATALOG.date_of(n)) for n in ("q_patient", "q_record", "q_event")], "table_name string, date_column string")


@query("qb_12_record_wise", "SELECT r_regionkey, unnest(['r_regionkey', 'r_name']) AS field, unnest([r_regionkey::VARCHAR, r_name]) AS value FROM region")
def _(t: Tables):
    return rel.record_wise(t.region, "r_regionkey")


# Patterns

def _rows(pairs: list[tuple[str, str | None]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in pairs) + ") AS x(text, found)"


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _by_part(pairs: list[tuple[str, str | None]]) -> str:
    """For each row of part the result of its text, which is one of the pairs' texts with the part's name behind it."""
    cases = " ".join(f"WHEN {i} THEN {_quoted(b)}" for i, (_, b) in enumerate(pairs))
    return f"SELECT p_partkey, CASE p_partkey % {len(pairs)} {cases} END AS found FROM part"


def _texts(t: Tables, texts: list[str], behind: bool = True):
    k, text = c("p_partkey"), F.get(F.lit(texts).cast("array<string>"), (c("p_partkey") % len(texts)).cast("int"))
    return t.part.select(k, (F.concat(text, F.lit(" of "), c("p_name")) if behind else text).alias("text"))


_RX = {
    "rx_01_date": (lambda: rx.date(datetime.date(1980, 2, 7)), [("on 7 Feb 1980.", "7 Feb 1980"), ("07/02/80", "07/02/80"), ("1980-2-07", "1980-2-07"), ("17/02/80", None), ("8 Feb 1980", None)]),
    "rx_02_any_date": (lambda: rx.any_date(), [("seen 3rd September 2010", "3rd September 2010"), ("20130102", "20130102"), ("12 34", None), ("2012-05-07x", None)]),
    "rx_03_code": (lambda: rx.code("AB/12"), [("ref ab-1 2;", "ab-1 2"), ("xAB12", None)]),
    "rx_04_digits": (lambda: rx.n_digits(10), [("no 123 456 7890 here", "123 456 7890"), ("12345678901", None)]),
    "rx_05_postcode": (lambda: rx.postcode(), [("at cb2 3eb now", "cb2 3eb"), ("CB23EBX", None)]),
    "rx_06_typos": (lambda: rx.words("Smith", ("s",), 1), [("Smyths", "Smyths"), ("Smythe", None)]),
    "rx_07_phrase": (lambda: rx.phrase("5 High Street", [["Street", "St", "Road"]]), [("at 5, high  st", "5, high  st"), ("5 High Lane", None)]),
    "rx_08_email": (lambda: rx.email(), [("to a.b+c@x-y.org, or", "a.b+c@x-y.org"), ("a@b", None)]),
    "rx_09_extra": (lambda: "X[0-9]+", [("see x12", "x12"), ("x", None)]),
}


def _register(name: str) -> None:
    make, pairs = _RX[name]

    @query(name, _by_part(pairs))
    def _(t: Tables):
        d = _texts(t, [a for a, _ in pairs])
        return d.select("p_partkey", rx.found(c("text"), [make()]).alias("found"))


for _name in _RX:
    _register(_name)


@query("str_05_06_builders", _rows([("a.b c", r"a\.b\ c"), ("Sept", "Sep(?:t)?")]))
def _(t: Tables):
    return t.spark.createDataFrame([("a.b c", st.escape("a.b c")), ("Sept", st.first_letters("Sept", 3))], "text string, found string")


@query("str_07_09_ascii", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'STRASSECLERAMBAULT' ELSE 'DUVREANGSTROM' END AS found FROM part")
def _(t: Tables):
    d = _texts(t, ["Straße Clérambault", "d'Œuvre-Ångström"], behind=False)
    return d.select("p_partkey", F.udf(st.standard_name, "string", useArrow=True)("text").alias("found"))


@query("str_16_perfect_ids", "SELECT c_custkey, 'nhs' AS k, 'A' || c_custkey AS v FROM customer")
def _(t: Tables):
    k, v = st.perfect_id(F.concat(F.lit("NHS : a"), c("c_custkey").cast("string")))
    return t.customer.select("c_custkey", k.alias("k"), v.alias("v"))


# Scrubbers

@query("scr_02_flexible_words", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'In [~~~] now of ' ELSE 'newyork of ' END || p_name AS found FROM part")
def _(t: Tables):
    w = sc.WordList(["new york"], flexible=True)
    return _texts(t, ["In New   York now", "newyork"]).select("p_partkey", F.udf(w.scrub, "string", useArrow=True)("text").alias("found"))


@query("scr_08_order", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[__PPP__] at [~~~]' ELSE '[~~~] at [~~~]' END AS note FROM customer")
def _(t: Tables):
    """The patient's details before the nonspecific ones, or after: the mark shows which came first."""
    d = t.customer.select("c_custkey", F.lit("1234567890 at CB2 3EB").alias("note"), F.lit("1234567890").alias("v"))
    own, non = sc.scrub_source(d, "c_custkey", {"v": "number"}), sc.Nonspecific(postcodes=True, digits=(10,))
    first = sc.scrub_notes(d.where("c_custkey % 2 = 0"), "c_custkey", ["note"], own, sc.Options(nonspecific=non))
    last = sc.scrub_notes(d.where("c_custkey % 2 = 1"), "c_custkey", ["note"], own, sc.Options(nonspecific=non, nonspecific_first=True))
    return first.unionByName(last).select("c_custkey", "note")


@query("scr_11_texts", _rows([("a", "[__PPP__] saw [__TTT__]"), ("b", None)]))
def _(t: Tables):
    out = sc.scrub_dicts({"a": "Ann saw Bob", "b": None}, {"words": ["Ann"]}, {"words": ["Bob"]})
    return t.spark.createDataFrame(sorted(out.items()), "text string, found string")


# Notes

@query("nlp_05_validators", "SELECT p_partkey, unnest(['CRP', 'MMSE', 'BP']) AS processor, unnest([3, 1, 2]) AS n FROM part")
def _(t: Tables):
    note = F.concat(F.lit("CRP up. CRP "), c("p_size").cast("string"), F.lit("; c-reactive protein low. MMSE poor. BP high, blood pressure 120/80. "), c("p_name"))

    def named(batches):
        for b in batches:
            yield pd.DataFrame([(k, p, len(list(nlp.PROCESSORS[p].mentions(x)))) for k, x in zip(b["p_partkey"], b["note"], strict=True) for p in ("CRP", "MMSE", "BP")], columns=["p_partkey", "processor", "n"])

    return t.part.select("p_partkey", note.alias("note")).mapInPandas(named, "p_partkey long, processor string, n int")


@query("nlp_06_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1234.5 WHEN 1 THEN -3.0 WHEN 2 THEN -2.5 END::DOUBLE AS value FROM part")
def _(t: Tables):
    return _texts(t, ["1,234.5", "−3", "–2.5", "x"], behind=False).select("p_partkey", F.udf(nlp.to_float, "double", useArrow=True)("text").alias("value"))


@query("nlp_08_read_names", "SELECT p_partkey AS pk, p_size::DOUBLE AS value FROM part")
def _(t: Tables):
    note = F.concat(F.lit("Plasma C-reactive protein level (XE2dy) "), c("p_size").cast("string"), F.lit(" mg/L"))
    return nlp.run(t.part.select("p_partkey", note.alias("note")), "p_partkey", "note", ["CRP"]).select("pk", "value")


@query("nlp_registry")
def _(t: Tables):
    return t.spark.createDataFrame([(p.name, p.target, len(p.units)) for p in nlp.PROCESSORS.values()], "processor string, target string, n_units int")


# Linkage

@query("lnk_03_prior", f"SELECT round(ln(1.0::DOUBLE / {CFG.population}) - ln(1 - 1.0::DOUBLE / {CFG.population}), 9) AS prior")
def _(t: Tables):
    return t.spark.createDataFrame([(round(CFG.prior(), 9),)], "prior double")


@query("lnk_09_missing", "SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS unknown FROM customer")
def _(t: Tables):
    k = c("c_custkey")
    a, b = F.when(k % 3 != 0, "F"), F.when(k % 5 != 0, "M")
    return t.customer.select("c_custkey", ln.gender_score(a, b, CFG).isNull().alias("unknown"))


@query("lnk_14_sample_size", "SELECT (SELECT count(*) FROM customer) > 1000 AS refused, (SELECT count(*) FROM customer) > 852523 AS refused_by_default")
def _(t: Tables):
    """link() refuses a sample that is larger than the population."""
    people = t.customer.select(c("c_custkey").alias("id"))

    def refused(population: int) -> bool:
        try:
            ln.check_sizes(people, ln.Config(population=population))
        except ValueError:
            return True
        return False

    return t.spark.createDataFrame([(refused(1000), refused(CFG.population))], "refused boolean, refused_by_default boolean")


@query("lnk_15_mutated")
def _(t: Tables):
    return t.spark.createDataFrame([(n, ln.mutated(n, i + 3)) for i, n in enumerate(FORENAMES)], "name string, mutated string")


# Dictionaries

@query("dd_02_05_checks", "SELECT * FROM (VALUES ('no column customer.c_optout'), ('no column orders.o_note')) AS x(error)")
def _(t: Tables):
    return t.spark.createDataFrame([(e,) for e in _dictionary().check_against({"customer": t.customer, "orders": t.orders})], "error string")


@query("dd_03_rule_errors", "SELECT 'at most one of pid, mpid, third_party_pid' AS error UNION ALL SELECT 'addition_only needs a primary key'")
def _(t: Tables):
    bad = [*Rule("t", "a", pid=True, mpid=True).errors(), *Rule("t", "b", addition_only=True).errors()]
    return t.spark.createDataFrame([(e.split(": ", 1)[1],) for e in bad], "error string")


@query("dd_04_whole", "SELECT 'empty dictionary' AS error UNION ALL SELECT 'nothing defines patients'")
def _(t: Tables):
    return t.spark.createDataFrame([(e,) for e in Dictionary([]).errors() + Dictionary([Rule("t", "a")]).errors()], "error string")


@query("dd_08_10_classes", "SELECT * FROM (VALUES ('customer', TRUE, FALSE), ('orders', TRUE, TRUE)) AS x(table_name, with_patients, with_pk)")
def _(t: Tables):
    d = _dictionary()
    return t.spark.createDataFrame([(n, bool(d.one(n, "pid")), bool(d.one(n, "pk"))) for n in d.tables()], "table_name string, with_patients boolean, with_pk boolean")


@query("inc_07_incremental_draft", "SELECT 'region.r_name' AS field UNION ALL SELECT 'region.r_regionkey'")
def _(t: Tables):
    known = draft({"nation": t.nation}, DraftSettings())
    more = draft({"nation": t.nation, "region": t.region}, DraftSettings(), known=known)
    return t.spark.createDataFrame([(f"{r.table}.{r.column}",) for r in more.rules], "field string")


@query("inc_08_request_queue", "SELECT c_custkey::VARCHAR AS request_id, upper(c_name) AS result FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def _(t: Tables):
    """Requests of two clients are put, some are deleted before the work and some after; one client fetches what is left."""
    q = Queue(t.spark, scratch(t.spark, "requests"))
    k = c("c_custkey")
    q.put(t.customer.select(k.alias("request_id"), (k % 2).alias("client"), c("c_name").alias("text")), "first")
    q.delete(t.customer.where("c_custkey % 6 = 0").select(k.alias("request_id")), "early")
    q.work(lambda d: d.select("request_id", F.upper("text").alias("result")))
    q.delete(t.customer.where("c_custkey % 6 = 3").select(k.alias("request_id")), "late")
    return q.fetch("0")


@query("np_40_remote", "SELECT p_partkey AS pk, round((p_size + p_partkey % 10 / 10.0)::DOUBLE, 9) AS value FROM part")
def _(t: Tables):
    """Notes are sent to a processor elsewhere by an exchange folder; here the worker that answers runs the CRP processor."""
    note = F.concat(F.lit("CRP "), c("p_size").cast("string"), F.lit("."), (c("p_partkey") % 10).cast("string"), F.lit(" mg/L"))
    q = Queue(t.spark, scratch(t.spark, "remote"))
    sent = nlp.remote(t.part.select("p_partkey", note.alias("note")), "p_partkey", "note", q, "crp")
    q.work(lambda d: nlp.run(d.select(c("request_id").cast("long").alias("pk"), "text"), "pk", "text", ["CRP"]).select(c("pk").cast("string").alias("request_id"), F.to_json(F.struct("value")).alias("result")))
    return sent("value double").select("pk", F.round("value", 9).alias("value"))


@query("dd_07_hints", "SELECT * FROM (VALUES ('r.IDPatient', 'pid', FALSE), ('r.NHSNumber', 'mpid', FALSE), ('r.Surname', 'patient', TRUE), ('r.NextOfKinName', 'third_party', TRUE), ('r.FreeText', 'scrub', FALSE), ('r.IDProfileEnteredBy', 'omit', TRUE)) AS x(field, use, omitted)")
def _(t: Tables):
    """What the names of a record system's columns call for, and whether the draft omits them."""
    columns = ["IDPatient", "NHSNumber", "Surname", "NextOfKinName", "FreeText", "IDProfileEnteredBy"]
    table = t.customer.select(*(c("c_name").alias(x) for x in columns))
    d, notes = annotated({"r": table})
    use = {f"r.{x}": hints("r", x)[-1][1] for x in columns}
    omitted = {f"{r.table}.{r.column}": r.omit for r in d.rules}
    return t.spark.createDataFrame([(f, use[f], omitted[f]) for f in dict(notes)], "field string, use string, omitted boolean")


@query("etl_secret_map", "SELECT count(*) AS n, count(DISTINCT rid) AS n_rid, min(trid) AS least, max(trid) AS most FROM (SELECT c_custkey AS rid, row_number() OVER () AS trid FROM customer)")
def _(t: Tables):
    m = etl.secret_map(t.customer.select(c("c_custkey").alias("pid")), t.customer.select(c("c_custkey").alias("pid"), (c("c_custkey") * 7).alias("mpid")), KEYS)
    return m.agg(F.count("*").alias("n"), F.count_distinct("rid").alias("n_rid"), F.min("trid").alias("least"), F.max("trid").alias("most"))
