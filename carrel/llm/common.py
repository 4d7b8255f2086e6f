"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: blank and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share.

    The folder is the one that ``spark.checkpoint.dir`` names. Where it is unset, as in
    tests, it is a folder inside the warehouse.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_carrel_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of tables in the innermost scope last; the first list is of those outside any.
_WRITTEN: list[list[str]] = [[]]


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table: the lineage ends there.

    Spark deletes the shuffle files of the plan once the driver's JVM has collected it; asking for that here keeps
    the disk that a job takes to about that of its largest step. ``keep``: the table outlives the scope that it is written in.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN[-2 if keep and len(_WRITTEN) > 1 else -1].append(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that ``stored`` has written outside scopes, or to outlive them; how many. Call it once results are written elsewhere."""
    return _delete(spark, _WRITTEN[0])


def _delete(spark: SparkSession, paths: list[str]) -> int:
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@contextmanager
def scope(spark: SparkSession):
    """Tables that ``stored`` writes inside, but for those to be kept, are deleted at its end. Results that leave it must not read them."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        _delete(spark, _WRITTEN.pop())


def sliced(batches, rows: int = 2000):
    """The record batches in slices, so that what a task makes of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """What runs inside sends texts to Python in batches of so many rows, for less memory on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a looked-up table that are broadcast, and rows of one key from which it counts as hot.
BROADCAST_ROWS, HOT_ROWS = 1 << 20, 1 << 20


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", wide=None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and, as ``rows``, an upper bound or estimate of the key's rows on the other side.

    The table is read twice, so one that takes work is ``stored`` before. It is counted. Up to ``BROADCAST_ROWS`` rows (of 24 bytes; ``wide`` is a Column with the bytes of a row that has more) it is broadcast. Beyond that its hot keys alone, of ``HOT_ROWS`` rows or more, are, of which there are
    at most as many as the input has rows over ``HOT_ROWS``; all others are shuffled, so no task reads more than about that many rows of one key.
    """
    size = table.agg(F.greatest(F.count("*"), F.coalesce(F.sum(wide) / 24, F.lit(0)))).first()[0] if wide is not None else table.limit(BROADCAST_ROWS + 1).count()
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop("rows")), on, how)
    hot = table.where(F.col("rows") >= HOT_ROWS).drop("rows")
    if not hot.limit(1).count():
        return rows.join(table.drop("rows"), on, how)
    rest = table.where(F.col("rows") < HOT_ROWS).drop("rows")
    if how == "inner":
        return rows.join(F.broadcast(hot), on).unionByName(rows.join(rest, on))
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(cold.select(rows.join(F.broadcast(hot), on).columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_count(text):
    """Words of a text, 0 for null; a Column."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(id_column: str = "doc_id"):
    """crc32 of the id written as text, modulo 3: remainder 1 is held out from every fit."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3
