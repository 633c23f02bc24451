"""Tables written between steps of a job."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the job that is at work in this thread, if it deletes its tables.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # a local session that set none
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, so nothing that depends on them may be read after it: for jobs that
    write their results. Inside another scratch the outer one deletes."""
    if _SCRATCH.get() is not None:
        yield
        return
    own = new_path(spark, "scratch")
    before = _SCRATCH.set(own)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end, inside another scratch or passing too; what is to last is written by
    the function that it gives, which puts it where tables were put before."""
    outer = _SCRATCH.get()
    own = f"{outer}/passing-{uuid.uuid4().hex}" if outer else new_path(spark, "passing")
    before = _SCRATCH.set(own)

    def lasting(df: DataFrame, name: str) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return written(df, name)
        finally:
            _SCRATCH.reset(inner)

    try:
        yield lasting
    finally:
        _SCRATCH.reset(before)
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        freed(spark)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir, read back, in folders by a column if one is given. Its
    lineage ends there, so what is not repeatable (partition numbers, say) is fixed, and a lost executor costs no
    recomputation. Inside scratch() the table goes when that ends; else it stays as long as the folder does, since what is
    returned reads it."""
    spark, own = df.sparkSession, _SCRATCH.get()
    path = f"{own}/{name}-{uuid.uuid4().hex}" if own else new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of steps that have ended: it does so only when the driver's JVM collects what
    refers to them, which by itself may be half an hour later. For the end of steps over large tables."""
    spark._jvm.System.gc()
