"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where a local session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_faultspark_dir", None) or "file://" + tempfile.mkdtemp(prefix="faultspark-")
        spark._faultspark_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/faultspark-{uuid.uuid4().hex}-{name}"
    _MADE.append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later jobs start from these files, so a lost executor costs only its own
    tasks, and joins on the result see plain scans."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _MADE if spark else ():
        try:
            drop(spark, path)
        except Exception:  # the JVM may be gone already
            return


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_BYTES`` at most, unless it
    sets a smaller bound itself: a batch of long texts must fit a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = df.sparkSession.conf.get(key)
    if not given.rstrip("b").isdigit() or not 0 < int(given.rstrip("b")) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
