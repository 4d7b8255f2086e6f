"""The research layer: linked tables, explorers, finders."""

from __future__ import annotations

from pyspark.sql import functions as F

from carrel.operators import relational as rel
from carrel.plans.research import Catalog, Select, Table, condition, filled, identity, privileged
from carrel.registry import Tables, query

c = F.col

#: Two databases of one family, and one of another that is linked through a table with mrid.
CATALOG = Catalog(
    {
        t.name: t
        for t in (
            Table("q_patient", "db1", ("trid", "rid", "mrid", "segment"), mrid="mrid"),
            Table("q_record", "db1", ("trid", "rid", "record_id", "price", "created_at")),
            Table("q_event", "db2", ("trid", "rid", "event_id", "event_type"), trid="trid"),
            Table("q_other_patient", "db3", ("trid", "mrid", "balance"), rid=None, mrid="mrid", family="other"),
            Table("q_other_line", "db3", ("trid", "line"), rid=None, family="other"),
        )
    }
)


def _views(t: Tables) -> None:
    k = c("c_custkey")
    t.customer.select(k.alias("trid"), (k * 10).alias("rid"), (k * 100).alias("mrid"), c("c_mktsegment").alias("segment")).createOrReplaceTempView("q_patient")
    t.orders.select(c("o_custkey").alias("trid"), (c("o_custkey") * 10).alias("rid"), c("o_orderkey").alias("record_id"), c("o_totalprice").alias("price"), c("o_orderdate").alias("created_at")).createOrReplaceTempView("q_record")
    t.events.select((c("user_id") + 1000000).alias("trid"), (c("user_id") * 10).alias("rid"), "event_id", "event_type").createOrReplaceTempView("q_event")
    t.supplier.select((c("s_suppkey") + 5000).alias("trid"), (c("s_suppkey") * 100).alias("mrid"), c("s_acctbal").alias("balance")).createOrReplaceTempView("q_other_patient")
    t.lineitem.select((c("l_suppkey") + 5000).alias("trid"), c("l_orderkey").alias("line")).createOrReplaceTempView("q_other_line")


@query("qb_01_add_to_select", "SELECT c_mktsegment AS segment, o_orderkey AS record_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY')")
def _(t: Tables):
    _views(t)
    s = Select(CATALOG).add_column("q_patient", "segment").add_column("q_record", "record_id")
    s.add_where(condition("q_record.price", ">", 200000, "number")).add_where("q_patient.segment = 'BUILDING' OR q_patient.segment = 'MACHINERY'", bracket=True)
    return s.run(t.spark)


@query("jn_02_across_databases", "SELECT o_orderkey AS record_id, event_id FROM orders JOIN events ON user_id = o_custkey WHERE event_type = 'purchase' AND o_totalprice > 100000")
def _(t: Tables):
    _views(t)
    s = Select(CATALOG).add_column("q_record", "record_id").add_column("q_event", "event_id")
    return s.add_where("q_event.event_type = 'purchase'").add_where("q_record.price > 100000").run(t.spark)


@query("jn_03_through_mrid", "SELECT o_orderkey AS record_id, l_orderkey AS line FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = c_custkey JOIN lineitem ON l_suppkey = s_suppkey WHERE o_totalprice > 200000")
def _(t: Tables):
    _views(t)
    s = Select(CATALOG).add_column("q_record", "record_id").add_column("q_other_line", "line")
    return s.add_where("q_record.price > 200000").run(t.spark)


@query("set_02_distinct", "SELECT DISTINCT c_mktsegment AS segment FROM customer JOIN orders ON o_custkey = c_custkey")
def _(t: Tables):
    _views(t)
    s = Select(CATALOG).add_column("q_patient", "segment").set_distinct(True)
    return s.add_table("q_record").run(t.spark)


@query("prj_21_add_column", "SELECT c_mktsegment AS segment, c_custkey * 10 AS rid, c_mktsegment AS segment2 FROM customer")
def _(t: Tables):
    _views(t)
    return Select(CATALOG).add_column("q_patient", "segment").add_column("q_patient", "rid").add_column("q_patient", "segment", "segment2").run(t.spark)


@query("flt_08_literals", "SELECT o_orderkey AS record_id FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_totalprice < 250000.5 AND o_orderkey NOT IN (1, 2, 3)")
def _(t: Tables):
    _views(t)
    s = Select(CATALOG).add_column("q_record", "record_id").add_where(condition("created_at", ">=", "1996-01-01", "date"))
    return s.add_where(condition("price", "<", 250000.5, "number")).add_where(condition("record_id", "NOT IN", [1, 2, 3], "int")).run(t.spark)


@query("flt_23_privileged", "SELECT o_orderkey AS record_id FROM orders WHERE o_custkey IN (7, 8)")
def _(t: Tables):
    _views(t)
    sql = privileged("SELECT record_id FROM q_record WHERE ~pid IN ('p7', 'p8', 'unknown')", {"p7": "70", "p8": "80"})
    return t.spark.sql(sql.replace("''", "'-1'"))


@query("qb_03_patient_ids", "SELECT DISTINCT c_custkey * 100 AS mrid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_mktsegment = 'BUILDING'")
def _(t: Tables):
    p = t.customer.select((c("c_custkey") * 100).alias("mrid"), "c_mktsegment")
    o = t.orders.select((c("o_custkey") * 100).alias("m"), "o_totalprice")
    return rel.restricted(p, [(o, "m", c("o_totalprice") > 250000), (p, "mrid", c("c_mktsegment") == "BUILDING")])


@query("qb_04_patient_rows", "SELECT o_custkey * 100 AS mrid, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY 1, 2")
def _(t: Tables):
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select((c("c_custkey") * 100).alias("mrid"))
    return t.orders.select((c("o_custkey") * 100).alias("mrid"), "o_orderkey", "o_totalprice").join(ids, "mrid", "left_semi").orderBy("mrid", "o_orderkey")


_FINDER = "SELECT o_custkey AS mrid, 'orders' AS table_name, count(*) AS n_records, min(o_orderdate) AS min_date, max(o_orderdate) AS max_date FROM orders GROUP BY 1 UNION ALL SELECT user_id, 'events', count(*), min(ts), max(ts) FROM events GROUP BY 1 UNION ALL SELECT c_custkey, 'customer', count(*), NULL, NULL FROM customer GROUP BY 1"


@query("agg_01_data_finder", _FINDER)
def _(t: Tables):
    return rel.data_finder({"orders": (t.orders, "o_custkey", "o_orderdate"), "events": (t.events, "user_id", "ts"), "customer": (t.customer, "c_custkey", None)})


@query("qb_05_monster", "SELECT * FROM orders WHERE o_custkey IN (1, 2, 4)")
def _(t: Tables):
    return t.orders.join(t.spark.createDataFrame([(1,), (2,), (4,)], "o_custkey long"), "o_custkey", "left_semi").select(t.orders.columns)


@query("qb_06_text_finder", "SELECT DISTINCT source AS mrid, 'documents' AS table_name, 'text' AS column_name, doc_id::VARCHAR AS key, NULL::TIMESTAMP AS at, text AS content FROM documents WHERE text ILIKE '%idiot%' OR text ILIKE '%clown%' UNION SELECT conv_id::VARCHAR, 'conversations', 'text', turn::VARCHAR, NULL, text FROM conversations WHERE text ILIKE '%idiot%' OR text ILIKE '%clown%'")
def _(t: Tables):
    return rel.text_finder({"documents": (t.documents, "source", "doc_id", "text", None), "conversations": (t.conversations, "conv_id", "turn", "text", None)}, ["idiot", "clown"])


@query("srt_02_text_order", "SELECT event_type, user_id, ts, event_id FROM events ORDER BY event_type, user_id, ts DESC, event_id")
def _(t: Tables):
    return t.events.select("event_type", "user_id", "ts", "event_id").orderBy("event_type", "user_id", F.desc("ts"), "event_id")


@query("qb_07_one_patient", "SELECT doc_id, text FROM documents WHERE source = 'src3' AND length(text) >= 50")
def _(t: Tables):
    return t.documents.where((c("source") == "src3") & (F.length("text") >= 50)).select("doc_id", "text")


@query("qb_08_catalogue", " UNION ALL ".join(f"SELECT '{d}' AS database_name, '{n}' AS table_name, '{col}' AS column_name" for d, n, col in CATALOG.listing()))
def _(t: Tables):
    return t.spark.createDataFrame(CATALOG.listing(), "database_name string, table_name string, column_name string")


@query("qb_10_identity", "SELECT sha256('SELECT a FROM t') AS id")
def _(t: Tables):
    return t.spark.createDataFrame([(identity("SELECT  a\nFROM t"),)], "id string")


@query("qb_11_template", "SELECT o_orderkey AS record_id FROM orders WHERE o_totalprice > 300000 AND o_custkey < 500")
def _(t: Tables):
    _views(t)
    return t.spark.sql(filled("SELECT record_id FROM q_record WHERE price > [[least]] AND trid < [[most]]", {"least": "300000", "most": "500"}))


@query("qb_13_ranking", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END, s_acctbal DESC, s_suppkey)::INT AS seq FROM supplier")
def _(t: Tables):
    return rel.sequence(t.supplier, ["s_nationkey"], [F.when(c("s_acctbal") > 5000, 0).otherwise(1), F.desc("s_acctbal"), c("s_suppkey")]).select("s_suppkey", "seq")
