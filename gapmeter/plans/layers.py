"""Persisted pipeline layers (raw -> core -> star -> marts), written once and re-read.

Each layer is a Parquet table in a folder below the shared ``spark.checkpoint.dir``; a
lost executor therefore loses nothing, and lineage is cut at every layer boundary. A
layer belongs to one Spark application and one state of its input folder (names, sizes
and times of the files): changed input builds it anew and deletes the old one.
``drop_layers`` deletes all layers of an application; call it when a batch is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..session import SMALL_GROUPS, ensure_checkpoint_dir, passing_shuffles, unsorted_writes

#: A third less disk than the default codec.
CODEC = "zstd"
_WRITTEN: dict[tuple[str, str, str], tuple[str, str]] = {}


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files below ``folder``, on any store Spark reads."""
    fs, p = _file_system(spark, folder)
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(found))


def layer(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame | Iterable[DataFrame]],
          partition_by: list[str] | None = None) -> DataFrame:
    """The layer's table. ``build`` gives it as a whole or in slices, each of which is made and written after the one before."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    state = fingerprint(spark, sf_dir)
    known, path = _WRITTEN.get(key, ("", ""))
    if known != state:
        if path:
            _delete(spark, path)
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/layers/{uuid.uuid4().hex[:12]}/{name}"
        with passing_shuffles(spark):
            built = build()
            for df in [built] if isinstance(built, DataFrame) else built:
                w = df.write.mode("append").option("compression", CODEC)
                if partition_by:
                    with unsorted_writes(spark):
                        w.options(**SMALL_GROUPS).partitionBy(*partition_by).parquet(path)
                else:
                    w.parquet(path)
        _WRITTEN[key] = (state, path)
    return spark.read.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p.getParent(), True)


def drop_layers(spark: SparkSession) -> None:
    """Delete every layer this application has written."""
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId]:
        _delete(spark, _WRITTEN.pop(key)[1])
