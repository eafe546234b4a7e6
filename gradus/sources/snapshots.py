"""Tables that change as a whole: snapshots with an atomic pointer, and batch-wise appends.

A snapshot is written next to the old one and becomes current when its commit file appears, all
tables of a commit together. Appended tables hold one folder per batch; writing a batch again
replaces its folder, so a replay after a lost driver changes nothing. A commit also names the last
batch of its stream, which makes that batch's appended rows and the snapshots visible as one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _children(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def _commit(self) -> tuple[int, dict]:
        done = [n for n in self._children(f"{self.base}/_commits") if n.isdigit()]
        if not done:
            return 0, {"tables": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.base}/_commits/{done[-1]}"))
        try:
            return int(done[-1]), json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        return self._commit()[0]

    def last_batch(self, stream: str) -> int:
        return self._commit()[1]["batches"].get(stream, -1)

    def read(self, name: str, schema: str) -> DataFrame:
        """Current snapshot of a table; an empty frame of ``schema`` before the first."""
        where = self._commit()[1]["tables"].get(name)
        if where is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{where}")

    def publish(
        self, tables: dict[str, DataFrame], stream: str | None = None, batch: int | None = None
    ) -> int:
        """Write all tables and make them current at once. A batch is published once."""
        number, state = self._commit()
        if stream is not None and state["batches"].get(stream, -1) >= batch:
            return number
        number += 1
        for name, df in tables.items():
            where = f"{name}/v={number}"
            df.write.mode("overwrite").parquet(f"{self.base}/{where}")
            state["tables"][name] = where
        if stream is not None:
            state["batches"][stream] = batch
        hidden = self._path(f"{self.base}/_commits/_{number:012d}")
        final = self._path(f"{self.base}/_commits/{number:012d}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            raise RuntimeError(f"snapshot {number} of {self.base} was published by someone else")
        return number

    def append(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch}")

    def appended(
        self, name: str, schema: str, before: int | None = None, stream: str | None = None
    ) -> DataFrame:
        """Appended rows, of all batches or of those before one. With ``stream`` only rows of batches
        that it has published: what a batch wrote before it died is not seen, and its replay
        replaces it."""
        if not any("=" in n for n in self._children(f"{self.base}/{name}")):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.base}/{name}")
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if stream is not None:
            rows = rows.where(F.col("batch") <= self.last_batch(stream))
        return rows.drop("batch")
