"""Pseudonyms, dictionary runs, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from carrel.functions import hashing as ha
from carrel.operators import relational as rel
from carrel.operators import scrub as sc
from carrel.plans import etl
from carrel.plans.dictionary import Dictionary, DraftSettings, Keys, Rule, altered, anonymised, draft
from carrel.registry import FLAGSHIP, Tables, query

c = F.col
KEYS = Keys("pid-key", "mpid-key", "change-key", {"extra": "extra-key"})
_RID, _MRID = ha.hmac_sql("c_custkey", "pid-key"), ha.hmac_sql("CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 7 END", "mpid-key")
_EMAIL = r"[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+"


@query(FLAGSHIP, f"SELECT {ha.hmac_sql('doc_id', 'pid-key')} AS rid, source, date_trunc('month', DATE '2020-01-15' + (doc_id % 700)::INT)::DATE AS written, regexp_replace(text, '{_EMAIL}', '[~~~]', 'g') AS note FROM documents WHERE lang IN ('en', 'de')")
def _(t: Tables):
    d = t.documents.withColumn("written", F.date_add(F.lit("2020-01-15").cast("date"), (c("doc_id") % 700).cast("int")))
    d = d.withColumn("text", sc.Nonspecific(emails=True).column(c("text")))
    rules = [
        Rule("notes", "doc_id", "bigint", pid=True, dest_column="rid"),
        Rule("notes", "source"),
        Rule("notes", "lang", include=("en", "de"), omit=True),
        Rule("notes", "written", "date", alter=("truncate_date",)),
        Rule("notes", "text", dest_column="note"),
    ]
    return anonymised(d, rules, KEYS)


@query("hash_01_hmac", f"SELECT c_custkey, {ha.hmac_sql('c_custkey', 'k')} AS h_md5, {ha.hmac_sql('c_name', 'k', 'sha256')} AS h_sha256, {ha.hmac_sql('c_custkey', 'k')} = {ha.hmac_sql('c_custkey::VARCHAR', 'k')} AS same FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", ha.hmac(c("c_custkey"), "k").alias("h_md5"), ha.hmac(c("c_name"), "k", "sha256").alias("h_sha256"), (ha.hmac(c("c_custkey"), "k") == ha.hmac(c("c_custkey").cast("string"), "k")).alias("same"))


@query("hash_01_sha512")
def _(t: Tables):
    return t.customer.select("c_custkey", ha.hmac(c("c_custkey"), "k", "sha512").alias("h"))


@query("hash_02_row_hash", f"SELECT c_custkey, {ha.row_hash_sql(['c_custkey', 'c_name', 'c_mktsegment'], 'change-key')} AS h FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", ha.row_hash([c("c_custkey"), c("c_name"), c("c_mktsegment")], "change-key").alias("h"))


@query("hash_03_hash64")
def _(t: Tables):
    return t.customer.select("c_custkey", ha.hash64(c("c_name")).alias("h"))


@query("hash_04_bulk", f"SELECT x AS id, CASE WHEN x = '' THEN '' ELSE {ha.hmac_sql('x', 'k', 'sha256')} END AS h FROM (SELECT CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS x FROM supplier)")
def _(t: Tables):
    x = F.when(c("s_suppkey") % 5 == 0, "").otherwise(c("s_name"))
    return t.supplier.select(x.alias("id"), F.when(x == "", "").otherwise(ha.hmac(x, "k", "sha256")).alias("h"))


@query("prj_03_04_pseudonyms", f"SELECT {_RID} AS rid, {_MRID} AS mrid, c_mktsegment FROM customer")
def _(t: Tables):
    d = t.customer.select("c_custkey", F.when(c("c_custkey") % 10 != 0, c("c_custkey") * 7).alias("mpid"), "c_mktsegment")
    return anonymised(d, [Rule("p", "c_custkey", pid=True, dest_column="rid"), Rule("p", "mpid", mpid=True, dest_column="mrid"), Rule("p", "c_mktsegment")], KEYS)


@query("prj_05_third_party", f"SELECT o_orderkey, {ha.hmac_sql('o_custkey', 'pid-key')} AS rid, {ha.hmac_sql('o_custkey + 1', 'pid-key')} AS relative_rid FROM orders")
def _(t: Tables):
    d = t.orders.select("o_orderkey", "o_custkey", (c("o_custkey") + 1).alias("relative"))
    return anonymised(d, [Rule("o", "o_orderkey"), Rule("o", "o_custkey", pid=True, dest_column="rid"), Rule("o", "relative", third_party_pid=True, dest_column="relative_rid")], KEYS)


@query("prj_06_trid", f"SELECT c_custkey::VARCHAR AS pid, {_RID} AS rid, row_number() OVER (ORDER BY {_RID}) AS trid FROM customer")
def _(t: Tables):
    return etl.secret_map(t.customer.select(c("c_custkey").alias("pid")), None, KEYS)


@query("prj_09_14_alter", f"SELECT page_id, {ha.hmac_sql('url', 'extra-key')} AS url_hash, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", altered(c("url"), ("hash=extra",), KEYS.extra).alias("url_hash"), altered(c("html"), ("html_untag",), {}).alias("text"))


@query("prj_16_timestamp")
def _(t: Tables):
    return t.region.select("r_regionkey", F.current_timestamp().alias("_when_processed_utc"))


def _dictionary() -> Dictionary:
    return Dictionary(
        [
            Rule("customer", "c_custkey", "bigint", dest_table="patient", dest_column="rid", pid=True, defines=True),
            Rule("customer", "c_name", omit=True, scrub_source="patient", scrub_method="words"),
            Rule("customer", "c_mktsegment", dest_table="patient", dest_column="segment"),
            Rule("customer", "c_optout", "boolean", dest_table="patient", omit=True, opt_out=True),
            Rule("orders", "o_orderkey", "bigint", dest_table="record", dest_column="record_id", pk=True, add_hash=True, index="unique"),
            Rule("orders", "o_custkey", "bigint", dest_table="record", dest_column="rid", pid=True),
            Rule("orders", "o_orderdate", "timestamp", dest_table="record", dest_column="month", alter=("truncate_date",)),
            Rule("orders", "o_note", dest_table="record", dest_column="note", alter=("scrub",)),
        ]
    )


def _source(t: Tables):
    customer = t.customer.withColumn("c_optout", F.when(c("c_custkey") % 3 == 0, c("c_acctbal") < 0))
    note = F.concat(F.lit("Seen with CUSTOMER#"), F.lpad(c("o_custkey").cast("string"), 9, "0"), F.lit(" and Customer#000000000; status "), c("o_orderstatus"))
    return {"customer": customer, "orders": t.orders.withColumn("o_note", note).select("o_orderkey", "o_custkey", "o_orderdate", "o_note")}


_KEPT = "c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal < 0)"
_NOTE = "'Seen with CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0') || ' and Customer#000000000; status ' || o_orderstatus"
_CLEAN = f"regexp_replace(regexp_replace({_NOTE}, '\\b(?i)customer\\b', '[__PPP__]', 'g'), '\\b' || lpad(o_custkey::VARCHAR, 9, '0') || '\\b', '[__PPP__]', 'g')"


@query("etl_full_run", f"SELECT o_orderkey AS record_id, {ha.hmac_sql('o_custkey', 'pid-key')} AS rid, date_trunc('month', o_orderdate)::DATE AS month, {_CLEAN} AS note FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_KEPT}")
def _(t: Tables):
    return etl.run(_source(t), _dictionary(), KEYS)["record"].drop("_src_hash")


@query("etl_patients", f"SELECT {_RID} AS rid, c_mktsegment AS segment FROM customer WHERE {_KEPT}")
def _(t: Tables):
    return etl.run(_source(t), _dictionary(), KEYS)["patient"]


@query("flt_14_required_scrubber", "SELECT DISTINCT c_custkey::VARCHAR AS pid FROM customer WHERE c_custkey % 4 <> 0")
def _(t: Tables):
    d = Dictionary([Rule("customer", "c_custkey", "bigint", pid=True, defines=True), Rule("customer", "c_name", scrub_source="patient", scrub_method="words", required_scrubber=True)])
    tables = {"customer": t.customer.withColumn("c_name", F.when(c("c_custkey") % 4 != 0, c("c_name")))}
    return etl.with_required(etl.patient_ids(tables, d), tables, d)


def _versions(t: Tables):
    """The destination after a first run, and the source as it is at a second: some rows changed, some gone, some new."""
    key = F.col("o_orderkey")
    old = t.orders.where(key % 10 != 9).select(key.alias("id"), c("o_totalprice").alias("v"), F.md5(c("o_totalprice").cast("string")).alias("_src_hash"))
    v = F.when(key % 10 == 3, c("o_totalprice") + 1).otherwise(c("o_totalprice"))
    new = t.orders.where(key % 10 != 0).select(key.alias("id"), v.alias("v"), F.md5(v.cast("string")).alias("_src_hash"))
    return old, new


@query("inc_01_changed_rows", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 IN (3, 9)")
def _(t: Tables):
    old, new = _versions(t)
    return etl.changed(new, old, "id").select("id")


@query("inc_02_constant_rows", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 9")
def _(t: Tables):
    old, new = _versions(t)
    return etl.changed(new, old, "id", by_hash=None).select("id")


@query("inc_03_incremental", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 10 <> 0")
def _(t: Tables):
    old, new = _versions(t)
    return etl.incremental(old, new, "id").select("id", "v")


@query("inc_03_addition_only", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders")
def _(t: Tables):
    old, new = _versions(t)
    return etl.incremental(old, new, "id", addition_only=True).select("id", "v")


@query("inc_06_wipe", f"SELECT o_orderkey, {ha.hmac_sql('o_custkey', 'pid-key')} AS rid FROM orders WHERE o_custkey % 6 <> 0")
def _(t: Tables):
    dest = t.orders.select("o_orderkey", ha.hmac(c("o_custkey"), "pid-key").alias("rid"))
    return etl.wipe(dest, t.customer.where("c_custkey % 6 = 0").select(c("c_custkey").alias("pid")), KEYS)


@query("jn_17_delete_opted_out", f"SELECT o_orderkey FROM orders WHERE {ha.hmac_sql('o_custkey', 'pid-key')} NOT IN (SELECT {_RID} FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t: Tables):
    dest = t.orders.select("o_orderkey", ha.hmac(c("o_custkey"), "pid-key").alias("rid"))
    return etl.wipe(dest, t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("pid")), KEYS).select("o_orderkey")


@query("jn_23_secret_map_lookup", f"SELECT c_custkey::VARCHAR AS pid FROM customer WHERE {_RID} IN (SELECT {_RID} FROM customer WHERE c_custkey IN (5, 17, 90))")
def _(t: Tables):
    ids = etl.secret_map(t.customer.select(c("c_custkey").alias("pid")), None, KEYS)
    chosen = t.spark.createDataFrame([(5,), (17,), (90,)], "k long").select(ha.hmac(c("k"), "pid-key").alias("rid"))
    return ids.join(chosen, "rid", "left_semi").select("pid")


@query("snk_01_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer")
def _(t: Tables):
    dest = t.customer.where("c_custkey % 8 <> 0").select("c_custkey", c("c_mktsegment").alias("v"))
    rows = t.customer.where("c_custkey % 4 = 0").select("c_custkey", F.explode(F.array(F.lit("new"), F.lit("older"))).alias("v"))
    return rel.upsert(dest, rows, ["c_custkey"], [c("v")])


@query("snk_02_known_columns", "SELECT c_custkey, c_name FROM customer")
def _(t: Tables):
    schema = ["c_custkey", "c_name"]
    return t.customer.withColumn("unknown", F.lit(1)).select(*schema)


@query("src_counts_report", "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n_source, (SELECT count(*) FROM orders WHERE o_custkey % 2 = 0) AS n_dest")
def _(t: Tables):
    return etl.counts({"orders": t.orders}, {"orders": t.orders.where("o_custkey % 2 = 0")})


@query("dd_01_draft")
def _(t: Tables):
    settings = DraftSettings(pid=("customer.c_custkey", "orders.o_custkey"), definers=("customer.*",), patient_sources=("customer.c_name",), truncate=("orders.o_orderdate",), suffix="key")
    d = draft({"customer": t.customer, "orders": t.orders}, settings, {"orders.o_orderstatus": 1, "orders.o_orderpriority": 15, "customer.c_mktsegment": 10})
    return t.spark.createDataFrame([(r.table, r.column, r.to_column, r.pid, r.pk, r.scrub_method, ",".join(r.alter)) for r in d.rules], "table_name string, column_name string, dest string, pid boolean, pk boolean, method string, alter string")


@query("dd_06_summary", "SELECT 'customer' AS table_name, 4 AS n_columns, 2 AS n_omitted, TRUE AS has_pid, 1 AS n_scrub_sources UNION ALL SELECT 'orders', 4, 0, TRUE, 0")
def _(t: Tables):
    rows = [(s["table"], s["columns"], s["omitted"], s["has_pid"], s["scrub_sources"]) for s in _dictionary().summary()]
    return t.spark.createDataFrame(rows, "table_name string, n_columns int, n_omitted int, has_pid boolean, n_scrub_sources int")


@query("dd_09_patient_numbers", "SELECT row_number() OVER (ORDER BY c_custkey)::INT AS surrogate, TRY_CAST(substr(c_name, 10) AS BIGINT) AS patient_number FROM customer")
def _(t: Tables):
    from pyspark.sql import Window

    # Numbered in buckets of the key first, so that no task sorts all rows.
    d = t.customer.select("c_custkey", F.substring("c_name", 10, 100).try_cast("bigint").alias("patient_number"), F.floor(c("c_custkey") / 1000).alias("b"))
    before = d.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("b")) - c("n")).select("b", "before")
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy("c_custkey"))).join(F.broadcast(before), "b")
    return d.select((c("before") + c("rn")).cast("int").alias("surrogate"), "patient_number")
