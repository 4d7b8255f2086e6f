"""De-identification runs: full and incremental, from source tables to destination tables under a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrel.functions.hashing import hmac
from carrel.operators import scrub as sc
from carrel.operators.relational import keep_existing
from carrel.plans.dictionary import Dictionary, Keys, anonymised


def patient_ids(tables: dict[str, DataFrame], d: Dictionary) -> DataFrame:
    """pid: distinct non-null ids of all columns that define patients."""
    parts = [tables[r.table].select(F.col(r.column).cast("string").alias("pid")) for r in d.rules if r.defines]
    return reduce(lambda a, b: a.unionByName(b), parts).where("pid IS NOT NULL").distinct()


def opted_out(tables: dict[str, DataFrame], d: Dictionary, values=(True, 1, "1", "true")) -> DataFrame | None:
    """pid of everyone for whom an opt-out column holds one of the values; null is no opt-out."""
    parts = []
    for r in d.rules:
        pid = d.one(r.table, "pid")
        if r.opt_out and pid:
            texts = sorted({str(v).lower() for v in values})
            parts.append(tables[r.table].where(F.lower(F.col(r.column).cast("string")).isin(texts)).select(F.col(pid.column).cast("string").alias("pid")))
    return reduce(lambda a, b: a.unionByName(b), parts).where("pid IS NOT NULL").distinct() if parts else None


def scrub_values(tables: dict[str, DataFrame], d: Dictionary, pids: DataFrame) -> DataFrame | None:
    """Values to be removed, by patient, from all scrub-source columns."""
    parts = []
    for t in d.tables():
        pid = d.one(t, "pid")
        for kind in ("patient", "third_party"):
            columns = {r.column: r.scrub_method for r in d.of(t) if r.scrub_source == kind}
            if pid and columns:
                parts.append(sc.scrub_source(tables[t], pid.column, columns, kind).withColumn("pid", F.col("pid").cast("string")))
    if not parts:
        return None
    return reduce(lambda a, b: a.unionByName(b), parts).join(pids, "pid", "left_semi").distinct()


def with_required(pids: DataFrame, tables: dict[str, DataFrame], d: Dictionary) -> DataFrame:
    """Patients for whom every required scrub source holds a value."""
    for r in d.rules:
        if r.required_scrubber:
            pid = d.one(r.table, "pid")
            pids = pids.join(tables[r.table].where(F.trim(F.col(r.column).cast("string")) != "").select(F.col(pid.column).cast("string").alias("pid")).distinct(), "pid", "left_semi")
    return pids


def run(tables: dict[str, DataFrame], d: Dictionary, keys: Keys | None = None, options: sc.Options | None = None) -> dict[str, DataFrame]:
    """A full run: destination name -> table. Tables without a pid are copied under their rules; patients who opted out are left out."""
    keys = keys or Keys()
    if errors := d.errors() + d.check_against(tables):
        raise ValueError("; ".join(errors))
    pids = with_required(patient_ids(tables, d), tables, d)
    out_ids = opted_out(tables, d)
    if out_ids is not None:
        pids = pids.join(out_ids, "pid", "left_anti")
    values = scrub_values(tables, d, pids)
    out = {}
    for t in d.tables():
        rules = d.of(t)
        if all(r.omit for r in rules):
            continue
        df, pid = tables[t], d.one(t, "pid")
        if pid:
            df = df.join(pids, df[pid.column].cast("string") == pids["pid"], "left_semi")
        own = values.withColumn("pid", F.col("pid").cast(df.schema[pid.column].dataType)) if pid and values is not None else None
        out[rules[0].to_table if not rules[0].omit else next(r.to_table for r in rules if not r.omit)] = anonymised(df, rules, keys, own, options)
    return out


def secret_map(pids: DataFrame, mpids: DataFrame | None, keys: Keys) -> DataFrame:
    """pid, rid, trid, and mpid, mrid if known: the only table that links ids to pseudonyms.

    trid is a dense number in the order of rid, so it says nothing of the order of pids; it is counted in buckets of rid first,
    so that no task sorts all.
    """
    d = pids.select(F.col("pid").cast("string").alias("pid"), hmac(F.col("pid"), keys.pid).alias("rid")).withColumn("bucket", F.substring("rid", 1, 3))
    sizes = d.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).select("bucket", "before")
    d = d.withColumn("in_bucket", F.row_number().over(Window.partitionBy("bucket").orderBy("rid"))).join(F.broadcast(before), "bucket")
    d = d.select("pid", "rid", (F.col("before") + F.col("in_bucket")).alias("trid"))
    if mpids is None:
        return d
    return d.join(mpids.select(F.col("pid").cast("string").alias("pid"), "mpid"), "pid", "left").select("pid", "rid", "trid", "mpid", hmac(F.col("mpid"), keys.mpid).alias("mrid"))


def changed(source: DataFrame, done: DataFrame, pk: str, by_hash: str | None = "_src_hash") -> DataFrame:
    """Rows of an incremental run: those whose key, or key and hash, the destination does not have yet."""
    on = [pk] if by_hash is None else [pk, by_hash]
    return source.join(done.select(*on), on, "left_anti")


def incremental(dest: DataFrame, new: DataFrame, pk: str, by_hash: str | None = "_src_hash", addition_only: bool = False, changed_scrubbers: DataFrame | None = None, rid: str = "rid") -> DataFrame:
    """The destination after a run: vanished rows go (unless only additions are made), unchanged ones stay, others are replaced.

    ``changed_scrubbers`` names patients (column rid) whose scrubber has changed: their rows are made anew although the source has not changed.
    """
    kept = dest if addition_only else keep_existing(dest, new, [(pk, pk)])
    fresh = changed(new, dest, pk, by_hash)
    if changed_scrubbers is not None:
        fresh = fresh.unionByName(new.join(changed_scrubbers, rid, "left_semi")).dropDuplicates([pk])
    return kept.join(fresh.select(pk), pk, "left_anti").unionByName(fresh)


def wipe(dest: DataFrame, opted: DataFrame, keys: Keys, rid: str = "rid") -> DataFrame:
    """Without rows of patients who have opted out since (column pid)."""
    return dest.join(opted.select(hmac(F.col("pid"), keys.pid).alias(rid)), rid, "left_anti")


def counts(source: dict[str, DataFrame], dest: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_source and n_dest for a report."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), F.lit(side).alias("side"), "n") for side, ts in (("s", source), ("d", dest)) for k, df in ts.items()]
    d = reduce(lambda a, b: a.unionByName(b), parts)
    return d.groupBy("table_name").agg(F.coalesce(F.sum(F.when(F.col("side") == "s", F.col("n"))), F.lit(0)).alias("n_source"), F.coalesce(F.sum(F.when(F.col("side") == "d", F.col("n"))), F.lit(0)).alias("n_dest"))
