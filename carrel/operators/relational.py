"""Joins, windows and aggregations that record data need again and again."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lookups of at most this many rows are broadcast; larger ones are joined by shuffle.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has been counted and is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order, which must leave no ties."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def sequence(df: DataFrame, by: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def last_in_chain(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """max_number over each chain of edits and whether a row is its last."""
    most = F.max(number).over(Window.partitionBy(*by))
    return df.withColumn("max_number", most).withColumn("last_in_chain", F.col(number) == F.col("max_number"))


def lookup(df: DataFrame, table: DataFrame, on: str, key: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with columns of a lookup table by its unique key; null where the code is not in it."""
    t = table.select(F.col(key).alias("_key"), *(F.col(c).alias(a) for c, a in columns.items()))
    return df.join(t, F.col(on) == F.col("_key"), "left").drop("_key")


def first_lookup(df: DataFrame, table: DataFrame, on: str, key: str, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """As ``lookup`` where a code may occur again and again: its first row in the given order counts."""
    return lookup(df, latest(table, [key], order), on, key, columns)


def nested_lookup(df: DataFrame, table: DataFrame, codes: DataFrame, on: str, key: str, code: str, code_key: str, columns: dict[str, str]) -> DataFrame:
    """A lookup whose rows are inner-joined to their code table first, so that a missing code loses the whole lookup."""
    return lookup(df, table.join(codes, table[code] == codes[code_key]), on, key, columns)


def span(df: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Least start and greatest end of each id: when a record was entered and last changed."""
    return df.groupBy(by).agg(F.min(start).alias("first_at"), F.max(end).alias("last_at"))


def with_geography(df: DataFrame, postcodes: DataFrame, on: str, key: str, columns: dict[str, str], inner: bool = False) -> DataFrame:
    """Areas by postcode; the left form keeps the number of rows, which ``same_rows`` can check. Of rows with one postcode the least areas count, nulls last."""
    areas = [F.col(c).alias(a) for c, a in columns.items()]
    least = F.min(F.struct(*(x for c, a in columns.items() for x in (F.col(c).isNull().alias(f"_{a}"), F.col(c).alias(a))))) if areas else None
    t = postcodes.groupBy(F.col(key).alias("_key")).agg(least.alias("_x")).select("_key", *(F.col(f"_x.{a}").alias(a) for a in columns.values())) if areas else postcodes.select(F.col(key).alias("_key")).distinct()
    return df.join(t, F.col(on) == F.col("_key"), "inner" if inner else "left").drop("_key")


def same_rows(a: DataFrame, b: DataFrame) -> None:
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")


def keep_existing(dest: DataFrame, source: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``dest`` that have a row in ``source``; keys are compared null-safe."""
    cond = None
    for d, s in on:
        c = dest[d].eqNullSafe(source[s])
        cond = c if cond is None else cond & c
    return dest.join(source, cond, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(ids, df[column] == ids[key], "left_anti")


def upsert(dest: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``dest`` with rows of equal key replaced; of several new rows with one key the first in the given order is taken."""
    new = latest(rows, key, order)
    return dest.join(new, key, "left_anti").unionByName(new)


def shortlist(a: DataFrame, b: DataFrame, on: str, max_depth: int = 1) -> DataFrame:
    return a.join(b.select(on).distinct(), on, "left_semi")


def running_frequency(df: DataFrame, word: str) -> DataFrame:
    """word, n, share, and cumulative share in order of falling count, then word.

    The running sum is taken over counts first, of which there are few, then inside each count, so
    that a vocabulary of any size is not one task.
    """
    counts = df.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    per = counts.groupBy("n").agg(F.count("*").alias("words"))
    above = per.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("words")).over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = per.agg(F.sum(F.col("n") * F.col("words")).alias("total"))
    bucket = F.substring(F.col("word"), 1, 2)
    d = counts.withColumn("bucket", bucket)
    inside = d.groupBy("n", "bucket").agg(F.count("*").alias("w")).withColumn("earlier", F.coalesce(F.sum("w").over(Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("n", "bucket").orderBy("word")))
    d = d.join(inside.select("n", "bucket", "earlier"), ["n", "bucket"]).join(above.select("n", "before"), "n").join(F.broadcast(total))
    return d.select("word", "n", (F.col("n") / F.col("total")).alias("share"), ((F.col("before") + F.col("n") * (F.col("earlier") + F.col("rank"))) / F.col("total")).alias("cumulative"))


def profile(df: DataFrame, column: str, most_distinct: int = 20) -> DataFrame:
    """One row: distinct non-null values, nulls, least and greatest if there are several, and the values if they are few, null first."""
    c = F.col(column)
    counted = df.groupBy(c.alias("v")).agg(F.count("*").alias("k"))
    out = counted.agg(F.count("v").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("n_null"), F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("greatest"))
    few = counted.orderBy(F.asc_nulls_first("v")).limit(most_distinct + 1).agg(F.sort_array(F.collect_list(F.col("v").cast("string"))).alias("values"))
    several = F.col("n_distinct") > 1
    out = out.join(F.broadcast(few))
    return out.select(F.lit(column).alias("column_name"), "n_distinct", "n_null", F.when(several, F.col("least")).alias("least"), F.when(several, F.col("greatest")).alias("greatest"), F.when(F.col("n_distinct") <= most_distinct, F.array_join("values", "|")).alias("values"))


def data_finder(tables: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """Per patient and table: rows, first and last date. ``tables``: name -> (table, patient column, date column or None)."""
    out = None
    for name, (df, pid, date) in tables.items():
        d = F.col(date).cast("timestamp") if date else F.lit(None).cast("timestamp")
        one = df.groupBy(F.col(pid).alias("mrid")).agg(F.count("*").alias("n_records"), F.min(d).alias("min_date"), F.max(d).alias("max_date")).select("mrid", F.lit(name).alias("table_name"), "n_records", "min_date", "max_date")
        out = one if out is None else out.unionByName(one)
    return out


def text_finder(tables: dict[str, tuple[DataFrame, str, str, str, str | None]], words: list[str], context: bool = True) -> DataFrame:
    """Rows whose text holds any of the words. ``tables``: name -> (table, patient, key, text, date)."""
    out = None
    for name, (df, pid, key, text, date) in tables.items():
        hit = None
        for w in words:
            c = F.col(text).ilike(f"%{w}%")
            hit = c if hit is None else hit | c
        cols = [F.col(pid).cast("string").alias("mrid"), F.lit(name).alias("table_name"), F.lit(text).alias("column_name"), F.col(key).cast("string").alias("key"), (F.col(date).cast("timestamp") if date else F.lit(None).cast("timestamp")).alias("at")]
        one = df.where(hit).select(*cols, *([F.col(text).alias("content")] if context else []))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def restricted(patients: DataFrame, conditions: list[tuple[DataFrame, str, Column]], pid: str = "mrid") -> DataFrame:
    """Distinct patients that satisfy every condition; null ids are none."""
    out = patients.select(pid).where(F.col(pid).isNotNull()).distinct()
    for table, column, where in conditions:
        out = out.join(table.where(where).select(F.col(column).alias(pid)).distinct(), pid, "left_semi")
    return out


def subset(tables: dict[str, DataFrame], column: str, values: list[str], keep_others: bool, include: list[str] = ("*",), exclude: list[str] = ()) -> dict[str, DataFrame]:
    """Rows whose filter column, as text, is among the values; tables without the column are kept whole or not at all."""

    out = {}
    for name, df in tables.items():
        if not any(fnmatch(name, p) for p in include) or any(fnmatch(name, p) for p in exclude):
            continue
        if column in df.columns:
            out[name] = df.where(F.col(column).cast("string").isin(values))
        elif keep_others:
            out[name] = df
    return out


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The ``number``-th page from 1, as top rows of the order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: Types by what all values of a column can be read as, narrowest first.
INFERRED = ("boolean", "bigint", "double", "date", "timestamp", "string")


def infer_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The narrowest type that all non-blank values of each text column can be read as; string where there is none. One pass."""
    cols = columns or df.columns
    checks = []
    for c in cols:
        v = F.nullif(F.trim(F.col(c)), F.lit(""))
        tests = {
            "boolean": v.rlike("(?i)^(true|false|yes|no|y|n|t|f)$"),
            "bigint": v.rlike("^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull(),
            "double": v.try_cast("double").isNotNull(),
            "date": v.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.try_cast("date").isNotNull(),
            "timestamp": v.try_cast("timestamp").isNotNull() & v.rlike(r"^\d{4}-\d{2}-\d{2}"),
        }
        checks += [F.min(F.when(v.isNotNull(), F.coalesce(t, F.lit(False)))).alias(f"{c}|{k}") for k, t in tests.items()]
    got = df.agg(*checks).first()
    return {c: next((k for k in INFERRED[:-1] if got[f"{c}|{k}"]), "string") for c in cols}


def cast_inferred(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def one(c: str, kind: str) -> Column:
        v = F.nullif(F.trim(F.col(c)), F.lit(""))
        if kind == "boolean":
            return F.lower(v).isin("true", "yes", "y", "t")
        return v.try_cast(kind)

    return df.select(*(one(c, types[c]).alias(c) if c in types else F.col(c) for c in df.columns))


def schema_difference(df: DataFrame, wanted: list[str]) -> list[tuple[str, str]]:
    """(``missing`` or ``extra``, column) of a table against the columns that a destination should have, by name."""
    have = set(df.columns)
    return [("missing", c) for c in sorted(set(wanted) - have)] + [("extra", c) for c in sorted(have - set(wanted))]


def readable_columns(df: DataFrame, lengths: dict[str, int], most: int, scrubbed: set[str] = frozenset()) -> DataFrame:
    """The table without texts that may be longer than ``most`` characters and without texts that are scrubbed."""
    return df.select([c for c in df.columns if lengths.get(c, 0) <= most and c not in scrubbed])


def matching_fields(tables: dict[str, DataFrame], allow: list[str], deny: list[str] = ()) -> list[str]:
    """``table.column`` names that match a pattern of ``allow`` and none of ``deny``; * and ? as in a shell."""
    names = [f"{t}.{c}" for t, df in tables.items() for c in df.columns]
    return [n for n in names if any(fnmatch(n, p) for p in allow) and not any(fnmatch(n, p) for p in deny)]


def catalogue(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> list[tuple[str, int, int]]:
    """Table, number of columns and number of indexed (key) columns of each table."""
    return [(t, len(df.columns), len((keys or {}).get(t, []))) for t, df in tables.items()]


def record_wise(df: DataFrame, key: str) -> DataFrame:
    """A row per field of each record: the key, field and value as text; nulls are rows, too."""
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns]
    return df.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.field", "x.value")
