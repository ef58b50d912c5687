"""Tables that a job writes to read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[list[str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder of ``spark.checkpoint.dir``, which all machines share.

    A local session that names none gets a temporary folder; on a cluster that is an error, as a folder of one machine
    is lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="lanewatt-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, once no table is to be read from it any more."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


@contextmanager
def scratch_job(spark: SparkSession) -> Iterator[None]:
    """A job: at its end, whether it failed or not, every scratch folder that was named in it is deleted.

    Results are lazy and read those folders, so a job ends after its results were written or collected. Jobs may be
    nested; each deletes its own.
    """
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove_folder(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder, for what several branches of a plan read."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
