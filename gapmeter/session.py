"""Spark session settings used by every job.

ANSI mode stays on (Spark 4 default): every text conversion goes through
``try_*`` functions so that one bad value yields NULL instead of failing a job.
The session time zone is a parameter because hour/year extraction of the
generation series depends on it (SURVEY B17).
"""

from __future__ import annotations

import contextlib
import math
import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows may hold whole documents: smaller batches keep buffers on both sides of a Python worker small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # generated methods above the JIT's 8000-byte limit would run interpreted:
    # let Spark split such stages instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "gapmeter", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the submitter's config wins; we only
    fill in what is unset."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system path set by the submitter;
    we only create a scratch one when nothing is configured (local tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a shared folder (e.g. on the cluster's "
                             "distributed file system) -- a machine-local folder does not survive executor loss")
        d = tempfile.mkdtemp(prefix="gapmeter-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any store Spark writes to; a missing one is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def apply_session_defaults(spark: SparkSession) -> None:
    """Make a foreign session (e.g. the driver's) behave like ours for the
    runtime settings results and plans depend on: ANSI casts, UTC, AQE."""
    for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled", "spark.sql.codegen.hugeMethodLimit", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        try:
            spark.conf.set(k, DEFAULT_CONF[k])
        except Exception:  # pragma: no cover - static conf on some clusters
            pass


@contextlib.contextmanager
def few_tasks(spark: SparkSession):
    """While it holds, shuffles end in partitions of the advised size, not as many as there are cores: for rounds of
    small steps, each of which is written out, that is fewer files."""
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


#: Values of a partition column for which a task of a write keeps a file open each.
OPEN_FILES = 32
#: Bytes a Parquet file that is written beside others gathers in memory.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20)}


@contextlib.contextmanager
def unsorted_writes(spark: SparkSession):
    """While it holds, a task that writes by a partition column of few values (years) keeps a file open for each instead of sorting
    its rows: a sort takes memory, or spills, as the task's input grows. Beyond OPEN_FILES values the rest is sorted."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(OPEN_FILES))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession):
    """While it holds, a step that is planned and run under it deletes its shuffle files once it has run. For steps whose result is
    written out: what is read from then on is the result, and without this the files of all steps before stay on disk until the
    driver's JVM happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


#: Rows that a layer's build shuffles at once, and the most slices it takes: each reads the input anew.
SLICE_ROWS, MAX_SLICES = 120_000_000, 8


def slices(rows: int) -> int:
    """Slices by key in which a layer of so many rows is built, one after the other: only one slice's shuffle files are on disk."""
    return max(1, min(MAX_SLICES, math.ceil(rows / SLICE_ROWS)))


def materialize(df):
    """Cut lineage at a mart boundary: a reliable checkpoint written to the
    shared ``spark.checkpoint.dir`` (survives executor loss; never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
