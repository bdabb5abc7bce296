"""Sessions and the written tables that cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a temporary folder, on a local master only: executors elsewhere would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        found = getattr(spark.sparkContext, "_tessera_tables", "")
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            found = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            found = spark.sparkContext._tessera_tables = "file://" + found
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one.  It goes when the application ends, if nobody deletes it before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at, files = _path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def saver(spark: SparkSession, name: str = "step"):
    """save(df): writes it to the shared folder and reads it again, for iterative operators."""
    root, count = scratch_folder(spark, name), 0

    def save(df: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        df.write.parquet(f"{root}/{count}")
        return spark.read.schema(df.schema).parquet(f"{root}/{count}")

    return save
