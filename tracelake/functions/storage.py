"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local master without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def mounted(uri: str) -> str:
    """The path of a file URI, for readers that open files themselves."""
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"{uri} is no folder that every machine has mounted")
    return uri.removeprefix("file://")


#: Files of so many bytes a core are small enough to be dealt out.
DEAL_BYTES = 32 << 20


def dealt(table: DataFrame) -> DataFrame:
    """Rows of a few small files, dealt over the cores, as a row group is one task's work; other tables as they are."""
    spark = table.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, table.inputFiles()
    if len(files) >= cores:
        return table
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    size = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
    return table.repartition(cores) if size <= cores * DEAL_BYTES else table


def _at(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    path, fs = _at(spark, uri)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def delete(spark: SparkSession, uri: str) -> None:
    path, fs = _at(spark, uri)
    fs.delete(path, True)
