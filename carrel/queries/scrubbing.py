"""Scrubbers of free text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.operators import scrub as sc
from carrel.queries.identity import _EMAIL
from carrel.registry import Tables, query

c = F.col
_CONTACT = "'Mail p' || c_custkey || '@example.org or ring 01223 ' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || ', CB' || (c_custkey % 9 + 1) || ' ' || (c_custkey % 10) || 'EB. Ref ' || c_custkey || '.'"


def _contact():
    k = c("c_custkey")
    return F.concat(F.lit("Mail p"), k.cast("string"), F.lit("@example.org or ring 01223 "), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(", CB"), (k % 9 + 1).cast("string"), F.lit(" "), (k % 10).cast("string"), F.lit("EB. Ref "), k.cast("string"), F.lit("."))


_ALL = rf"regexp_replace({_CONTACT}, '{_EMAIL}|\b[A-Za-z]{{1,2}}[0-9][A-Za-z0-9]?\s*[0-9][A-Za-z]{{2}}\b|\b[0-9]([ \t]*[0-9]){{10}}\b', '[~~~]', 'g')"


@query("scr_04_nonspecific", f"SELECT c_custkey, {_ALL} AS note FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", sc.Nonspecific(emails=True, postcodes=True, digits=(11,)).column(_contact()).alias("note"))


@query("scr_04_emails", f"SELECT doc_id, regexp_replace(text, '{_EMAIL}', '[~~~]', 'g') AS text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", sc.Nonspecific(emails=True).column(c("text")).alias("text"))


@query("scr_05_blurred_dates", "SELECT o_orderkey, 'Seen ' || strftime(o_orderdate, '%b %Y') || ' and later.' AS note FROM orders")
def _(t: Tables):
    n = sc.Nonspecific(dates=True, date_replacement="%b %Y")

    @F.pandas_udf(T.StringType())
    def scrub(s: pd.Series) -> pd.Series:
        return s.map(n.scrub)

    k = c("o_orderkey") % 3
    day = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    # Day and month of a date like 03/04/1995 are read in that order; the oracle's dates are told apart by their day.
    day = F.when(F.dayofmonth("o_orderdate") <= 12, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(day)
    return t.orders.select("o_orderkey", scrub(F.concat(F.lit("Seen "), day, F.lit(" and later."))).alias("note"))


@query("scr_01_word_list", r"SELECT doc_id, regexp_replace(text, '(?i)\b(idiot|stupid|moron)\b', '[~~~]', 'g') AS text FROM documents")
def _(t: Tables):
    words = sc.WordList(["idiot", "stupid", "moron"])

    @F.pandas_udf(T.StringType())
    def scrub(s: pd.Series) -> pd.Series:
        return s.map(words.scrub)

    # Only rows that hold a word of the list are sent to Python.
    text = c("text")
    held = text.rlike("(?iu)" + "|".join(sorted(words.words)))
    hit = t.documents.where(held).select("doc_id", scrub(text).alias("text"))
    return hit.unionByName(t.documents.where(~held | text.isNull()).select("doc_id", "text"))


@query("scr_03_allow_list", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'blue')), ' ') AS words FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.array_join(F.filter(F.split("p_name", " "), lambda x: ~x.isin("red", "blue")), " ").alias("words"))


_PERSON = "'Customer ' || c_custkey || ' (CUSTOMER#' || lpad(c_custkey::VARCHAR, 9, '0') || ', nation ' || c_nationkey || ') was seen with nation_' || c_nationkey || '.'"


@query("scr_06_personal", rf"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace({_PERSON}, '(?i)\bcustomer\b', '[__PPP__]', 'g'), '\b' || lpad(c_custkey::VARCHAR, 9, '0') || '\b', '[__PPP__]', 'g'), '(?i)\bnation_' || c_nationkey || '\b', '[__TTT__]', 'g') AS note FROM customer")
def _(t: Tables):
    k = c("c_custkey").cast("string")
    note = F.concat(F.lit("Customer "), k, F.lit(" (CUSTOMER#"), F.lpad(k, 9, "0"), F.lit(", nation "), c("c_nationkey").cast("string"), F.lit(") was seen with nation_"), c("c_nationkey").cast("string"), F.lit("."))
    own = sc.scrub_source(t.customer, "c_custkey", {"c_name": "words"})
    other = sc.scrub_source(t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")), "c_custkey", {"n_name": "words"}, "third_party")
    return sc.scrub_notes(t.customer.select("c_custkey", note.alias("note")), "c_custkey", ["note"], own.unionByName(other))


@query("scr_07_default_methods", "SELECT * FROM (VALUES ('c_custkey', 'number'), ('c_name', 'words'), ('c_nationkey', 'number'), ('c_acctbal', 'number'), ('c_mktsegment', 'words')) AS x(column_name, method)")
def _(t: Tables):
    return t.spark.createDataFrame([(f.name, sc.default_method(f.dataType)) for f in t.customer.schema.fields], "column_name string, method string")


@query("scr_09_scrubber_hash")
def _(t: Tables):
    return sc.scrubber_hash(sc.patient_values(sc.scrub_source(t.customer, "c_custkey", {"c_name": "words"})), sc.Options(), "hash-key")


@query("scr_10_third_party", "WITH e AS (SELECT c_custkey AS pid, c_custkey + 1 AS related FROM customer) SELECT pid, c_name AS value FROM e JOIN customer ON related = c_custkey")
def _(t: Tables):
    links = t.customer.select(c("c_custkey").alias("pid"), (c("c_custkey") + 1).alias("rel"))
    r = sc.related(links, "pid", "rel", 1)
    return r.join(t.customer, c("related") == c("c_custkey")).select("pid", c("c_name").alias("value"))


@query("scr_12_compare", f"SELECT c_custkey, {_CONTACT} AS raw, {_ALL} AS clean, 0 AS n_patient, 0 AS n_third_party, 3 AS n_nonspecific FROM customer")
def _(t: Tables):
    raw = t.customer.select("c_custkey", _contact().alias("note"))
    clean = raw.select("c_custkey", sc.Nonspecific(emails=True, postcodes=True, digits=(11,)).column(c("note")).alias("note"))
    return sc.compare(raw, clean, "c_custkey", "note")
