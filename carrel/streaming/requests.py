"""A queue of processing requests in a shared folder: put, fetch, show and delete, and the batch exchange with a processor elsewhere.

Each step writes files of its own and none changes another's, so several clients and workers need no lock. A request is its text with an id; a batch of
requests is one Parquet folder. A worker answers a batch with a folder of replies under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "request_id string, client string, text string"
REPLY = "request_id string, result string"


class Queue:
    """``folder`` is shared by clients and workers, for instance one that a network service fills and empties."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, kind: str) -> list[str]:
        """Names of the batches that are written to their end."""
        _, fs = self._files()
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = jpath(self._path(kind))
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jpath(s.getPath(), "_SUCCESS")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [self._path(kind, b) for b in self._batches(kind)]
        if not paths:
            return self.spark.createDataFrame([], schema + ", batch string")
        return self.spark.read.schema(schema).parquet(*paths).withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -2))

    def put(self, requests: DataFrame, batch: str) -> None:
        """Queues request_id, client and text as one batch; the same batch put again replaces itself."""
        requests.select(*(F.col(c).cast("string").alias(c) for c in ("request_id", "client", "text"))).write.mode("overwrite").parquet(self._path("requests", batch))

    def show(self) -> DataFrame:
        """request_id, client, batch and state (``waiting``, ``done`` or ``deleted``) of all requests."""
        done = self._read("replies", REPLY).select("request_id", F.lit(True).alias("_done")).distinct()
        gone = self._read("deleted", "request_id string").select("request_id", F.lit(True).alias("_gone")).distinct()
        d = self._read("requests", REQUEST).join(done, "request_id", "left").join(gone, "request_id", "left")
        return d.select("request_id", "client", "batch", F.when(F.col("_gone"), "deleted").when(F.col("_done"), "done").otherwise("waiting").alias("state"))

    def fetch(self, client: str) -> DataFrame:
        """request_id and result of a client's requests that are done and not deleted."""
        mine = self.show().where((F.col("client") == client) & (F.col("state") == "done")).select("request_id")
        return self._read("replies", REPLY).select("request_id", "result").join(mine, "request_id", "left_semi")

    def delete(self, ids: DataFrame, batch: str) -> None:
        """Withdraws requests: they are not worked on, and their results are not given out. ``ids``: request_id."""
        ids.select(F.col("request_id").cast("string").alias("request_id")).write.mode("overwrite").parquet(self._path("deleted", batch))

    def work(self, program: Callable[[DataFrame], DataFrame]) -> int:
        """Answers every batch without replies with ``program`` (request_id and text to request_id and result); how many batches."""
        todo = [b for b in self._batches("requests") if b not in self._batches("replies")]
        for b in todo:
            gone = self._read("deleted", "request_id string").select("request_id")
            rows = self.spark.read.schema(REQUEST).parquet(self._path("requests", b)).join(gone, "request_id", "left_anti")
            program(rows.select("request_id", "text")).select(F.col("request_id").cast("string").alias("request_id"), F.col("result").cast("string").alias("result")).write.mode("overwrite").parquet(self._path("replies", b))
        return len(todo)
