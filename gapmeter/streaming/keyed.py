"""A table of keyed rows that micro-batches add to, each reading only the part it touches.

Rows lie in ``buckets`` by a hash of their key, below one folder per span of batches::

    sink/span=0_7/bucket=3/part-...     eight batches, merged
    sink/span=8_8/bucket=3/part-...     one batch

A batch reads the keys of the buckets its own rows fall into, and no others. Whenever MERGE spans of one length stand
side by side they are rewritten as one, so a bucket has at most MERGE folders for each power of MERGE and a row is rewritten
once for each. A span counts only with its success mark, and a span inside a longer one doesn't, so a merge
that dies halfway, or whose old spans were not deleted yet, changes nothing. A batch that runs again
writes its own span again, or nothing if that was merged already: every row counts once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MERGE = 8


class KeyedSink:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, merge: int = MERGE):
        if merge < 2 or buckets < 1:
            raise ValueError("merge must be at least 2, buckets at least 1")
        self.spark, self.path, self.keys, self.buckets, self.merge = spark, path.rstrip("/"), keys, buckets, merge
        #: Folders whose keys the last batch read.
        self.last_read: list[str] = []

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def spans(self) -> list[tuple[int, int]]:
        """Spans that count, in order: complete ones that no longer one holds."""
        found = []
        for name in self._names(self.path):
            if (m := re.fullmatch(r"span=(\d+)_(\d+)", name)) and "_SUCCESS" in self._names(f"{self.path}/{name}"):
                found.append((int(m[1]), int(m[2])))
        return sorted(s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found))

    def _folder(self, span: tuple[int, int]) -> str:
        return f"{self.path}/span={span[0]}_{span[1]}"

    def read(self, schema) -> DataFrame:
        """All rows, with the columns of ``schema``."""
        folders = [self._folder(s) for s in self.spans()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        empty = self.spark.createDataFrame([], schema)
        return self._load(empty.schema, folders).select(*empty.columns)

    def _load(self, schema, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def add(self, batch: DataFrame, number: int) -> None:
        """Rows of batch ``number`` whose key no batch before has brought, one for each key (null keys are equal)."""
        spans = self.spans()
        if any(a <= number <= b and a < b for a, b in spans):
            return  # merged already
        # deduplicated once, in the partitions it is written from: at most ``buckets`` numbers reach the driver
        fresh = self._bucketed(batch).repartition("bucket").dropDuplicates(["bucket", *self.keys]).persist()
        try:
            touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
            self.last_read = []
            for s in spans:
                if s[1] < number:
                    have = set(self._names(self._folder(s)))
                    self.last_read += [f"{self._folder(s)}/bucket={b}" for b in touched if f"bucket={b}" in have]
            new = fresh
            if self.last_read:
                key = fresh.select(*self.keys).schema
                seen = self._load(key, self.last_read).select(*[F.col(k).alias(f"_{k}") for k in self.keys])
                new = fresh.join(seen, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_anti")
            new.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self._folder((number, number)))
        finally:
            fresh.unpersist()
        self.compact()

    def compact(self) -> None:
        """Rewrite each run of ``merge`` neighbouring spans of one length as one span, then delete them."""
        while True:
            spans = self.spans()
            for i in range(len(spans) - self.merge + 1):
                run = spans[i:i + self.merge]
                if len({b - a for a, b in run}) == 1 and all(x[1] + 1 == y[0] for x, y in zip(run, run[1:])):
                    break
            else:
                return
            folders = [self._folder(s) for s in run]
            rows = self.spark.read.option("basePath", self.path).parquet(*folders).drop("span")
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self._folder((run[0][0], run[-1][1])))
            for f in folders:
                fs, p = self._fs(f)
                fs.delete(p, True)


def run_keyed(df: DataFrame, sink: KeyedSink, checkpoint: str) -> StreamingQuery:
    """Process everything available in micro-batches into ``sink``, then stop."""
    q = df.writeStream.foreachBatch(sink.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
