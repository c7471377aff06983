"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        path = "file://" + tempfile.mkdtemp(prefix="quire-")
        _written.append((spark, path))
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quire"
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and survives lost executors."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(schema).parquet(path)
    back._written_at = path
    return back


def release(*frozen: DataFrame) -> None:
    """Delete tables of freeze() that nothing will read any more, not even to make up for lost tasks."""
    for df in frozen:
        discard(df.sparkSession, df._written_at)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While this holds, the shuffle files of an action go when it ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the session may have ended, or the table be gone
            continue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")
