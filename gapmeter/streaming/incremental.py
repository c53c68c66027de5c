"""Incremental loading with Structured Streaming.

* J1 -- resumable exactly-once append: a file source, a Parquet sink and a
  checkpoint location; ``Trigger.AvailableNow`` processes what is there and
  stops. A rerun picks up only new files (the reference's saved cursor and
  truncate-on-resume, done by Spark's offset log and sink commit log).
* J2 -- duplicates after a resume: an anti-join with the touched part of a keyed sink (``keyed.py``),
  or ``dropDuplicatesWithinWatermark`` when an event time bounds the state.
* J3 -- hourly series with late rows: partial sums per micro-batch, complete in any
  order; or event-time windows with a watermark, where rows later than the watermark
  are dropped (and counted by ``numRowsDroppedByWatermark``).

Checkpoints and sinks live below the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import rnd
from ..session import ensure_checkpoint_dir, remove


_SCRATCH: list[tuple[str, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint dir. ``drop_scratch`` deletes it once its results are read."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark.sparkContext.applicationId, path))
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete every folder this application got from ``scratch``."""
    own = [x for x in _SCRATCH if x[0] == spark.sparkContext.applicationId]
    for x in own:
        remove(spark, x[1])
        _SCRATCH.remove(x)


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      partition_by: list[str] | None = None) -> StreamingQuery:
    """Process everything available, exactly once, then stop."""
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return q


def run_batches(df: DataFrame, sink: str, checkpoint: str, each) -> StreamingQuery:
    """Process everything available in micro-batches: ``each(batch, done)`` gives what a batch
    adds to the table ``done`` of the batches before it (None at first). A batch has a
    folder of its own and overwrites it if it runs again, so every row counts once."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [f"{sink}/batch={k}" for k in range(number)]
        done = spark.read.option("basePath", sink).parquet(*before) if before else None
        each(batch, done).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def new_keys(keys: list[str]):
    """J2 for few batches: rows of a batch whose key no batch before has brought, against the whole sink (``keyed.py`` reads
    only the touched part). Null keys count as equal."""
    def each(batch: DataFrame, done: DataFrame | None) -> DataFrame:
        fresh = batch.dropDuplicates(keys)
        if done is None:
            return fresh
        seen = done.select(*[F.col(k).alias(f"_{k}") for k in keys])
        return fresh.join(seen, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    return each


def hourly_partials(ts: str, key: str, value: str):
    """Sums per hour and key of a batch. Partial sums add up to the complete series whatever
    the order of the files; no window stays open and no row is late."""
    def each(batch: DataFrame, done: DataFrame | None) -> DataFrame:
        return (batch.groupBy(F.window(ts, "1 hour").alias("w"), F.col(key)).agg(F.sum(value).alias("summe"), F.count(F.lit(1)).alias("n"))
                .select(F.col("w.start").alias("fenster_start"), F.col("w.end").alias("fenster_ende"), key, "summe", "n"))
    return each


def hourly_with_late(ts: str, key: str, value: str, delay_hours: int):
    """As ``hourly_partials``; rows more than ``delay_hours`` before the latest time of any batch before are
    counted as late (``n_spaet``) and correct their hour all the same. That time is kept in the sink (``bis``)."""
    def each(batch: DataFrame, done: DataFrame | None) -> DataFrame:
        seen = done.agg(F.max("bis")).first()[0] if done is not None else None
        late = F.lit(False) if seen is None else F.col(ts) < F.lit(seen) - F.expr(f"INTERVAL {int(delay_hours)} HOURS")
        return (batch.groupBy(F.window(ts, "1 hour").alias("w"), F.col(key))
                .agg(F.sum(value).alias("summe"), F.count(F.lit(1)).alias("n"), F.count(F.when(late, 1)).alias("n_spaet"), F.max(ts).alias("bis"))
                .select(F.col("w.start").alias("fenster_start"), key, "summe", "n", "n_spaet", "bis"))
    return each


def hourly_totals(partials: DataFrame, key: str) -> DataFrame:
    """The series that the partial sums of ``hourly_with_late`` add up to."""
    return partials.groupBy(F.col("fenster_start").cast("timestamp_ntz").alias("fenster_start"), key).agg(
        rnd(F.sum("summe"), 6).alias("summe"), F.sum("n").alias("n"), F.sum("n_spaet").alias("n_spaet"))


def dedup_stream(df: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """J2 where copies arrive within ``delay``: the watermark bounds the state."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def hourly_windows(df: DataFrame, ts: str, key: str, value: str, delay: str = "2 hours") -> DataFrame:
    """Hourly event-time windows per key with a watermark (append mode emits
    each window once it is closed)."""
    return (df.withWatermark(ts, delay)
            .groupBy(F.window(ts, "1 hour").alias("w"), F.col(key))
            .agg(F.sum(value).alias("summe"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("fenster_start"), F.col("w.end").alias("fenster_ende"), key,
                    "summe", "n"))


def rows_dropped_by_watermark(q: StreamingQuery) -> int:
    """Late rows dropped by the watermark over the query's recent batches
    (Spark's ``numRowsDroppedByWatermark`` state-operator metric)."""
    total = 0
    for p in q.recentProgress:
        for op in p.get("stateOperators", []) or []:
            total += int(op.get("numRowsDroppedByWatermark", 0) or 0)
    return total
