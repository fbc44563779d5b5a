"""Tables written to the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where it is unset, as in
    local tests, a temporary folder is set once for the session. On a cluster it must be set:
    the executors could not read what the driver's machine holds."""
    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if kept:
        return kept
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = spark.conf.get("tablemill.shared.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="tablemill-")
        spark.conf.set("tablemill.shared.dir", own)
    return own


#: Folders that were written, by application; lists that take down further ones, in this thread.
_written: dict[str, list[str]] = {}
_recording = threading.local()


@contextmanager
def recorded(folders: list[str]) -> Iterator[list[str]]:
    """While it holds, folders gets every folder that this thread begins."""
    lists = _recording.__dict__.setdefault("lists", [])
    lists.append(folders)
    try:
        yield folders
    finally:
        lists.remove(folders)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table; `remove_written` knows it."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    for taken in (_written.setdefault(spark.sparkContext.applicationId, []), *_recording.__dict__.get("lists", [])):
        taken.append(path)
    return path


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for paths in _written.values():
        if folder in paths:
            paths.remove(folder)


def remove_written(spark: SparkSession) -> int:
    """Deletes the tables that this application has written to the shared folder so far, and says how
    many. For when the results that were made of them are written: frames that still read them
    fail afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        delete_folder(spark, p)
    return len(paths)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage, and the rows
    survive the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a dense 0-based number in the given order, without one partition for all rows:
    rows are sorted by range, numbered inside their partitions, and shifted by the sizes of the
    partitions before (as many numbers as there are partitions)."""
    kept = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = sorted((r.p, r.n) for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before - (p << 33)))
        before += n
    shifts = df.sparkSession.createDataFrame(rows or [(0, 0)], "p long, shift long")
    joined = kept.join(F.broadcast(shifts), part == F.col("p"))
    return joined.withColumn(name, F.col("__at") + F.col("shift")).drop("__at", "p", "shift")
