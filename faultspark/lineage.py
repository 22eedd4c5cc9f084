"""Cut lineage in iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a local one
    only where a local session names none, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(spark, "_faultspark_folder", None) or "file://" + tempfile.mkdtemp(prefix="faultspark-")
        spark._faultspark_folder = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once as a table in the shared folder and read back.

    A checkpoint of the rows would compute them twice; the files survive lost
    executors just the same, and are removed when the driver ends."""
    path = f"{folder(df.sparkSession)}/faultspark-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _MADE if spark else ():
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone already
            return
