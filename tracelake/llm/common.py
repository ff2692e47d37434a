"""Small helpers shared by the corpus operators: shared storage and table loading."""

from __future__ import annotations

import contextlib
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset a local master gets a temporary folder of its own, set for the
    session; a cluster has no folder that all its machines share, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Most bytes of a broadcast table whose size follows the data, and rows of an Arrow batch of texts.
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 500


def broadcast_if_small(staged: DataFrame, row_bytes: int | None = None) -> DataFrame:
    """A staged table, to be broadcast up to BROADCAST_BYTES and shuffled beyond.

    A row takes ``row_bytes``, or what its fixed-width columns take in a hash table.
    """
    width = row_bytes or 16 + 8 * len(staged.columns)
    return F.broadcast(staged) if staged.count() * width <= BROADCAST_BYTES else staged


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet without vectored reads, unless the session says how.

    A vectored read takes whole column chunks into buffers outside the heap that the JVM
    keeps by thread; chunks of texts are long.  Results are read lazily, so it holds for
    the session.
    """
    if spark.conf.get(VECTORED, None) is None:
        spark.conf.set(VECTORED, "false")


VECTORED = "parquet.hadoop.vectored.io.enabled"


#: Per cent of the driver's heap that a collection leaves free, at most; the JVM's own figure is 70.
FREE_PERCENT = 40


def lean_heap(spark: SparkSession) -> None:
    """Let collections in the driver's JVM give back what they free beyond FREE_PERCENT, unless its command line says how much stays.

    What is alive in the driver is small, and most of the heap that it keeps is free.  The
    flag holds for the JVM; its largest heap stays as it is.
    """
    with contextlib.suppress(Py4JError):  # a JVM of another make has no such flag
        kind = spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        flags = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        if flags.getVMOption(FREE_FLAG).getOrigin().toString() == "DEFAULT":
            flags.setVMOption(FREE_FLAG, str(FREE_PERCENT))


FREE_FLAG = "MaxHeapFreeRatio"


def let_go(spark: SparkSession) -> None:
    """A collection in the driver's JVM, as Spark's cleaner asks for now and then: plans, broadcasts and shuffles that are done with go."""
    spark._jvm.System.gc()


#: Share of the driver's largest heap above which a kept table is followed by a collection.
GROWN = 0.45


def let_go_if_grown(spark: SparkSession) -> None:
    """A collection if the driver's heap has grown: what is alive is small, and a full collection gives the rest back to the machine."""
    heap = spark._jvm.Runtime.getRuntime()
    if heap.totalMemory() > GROWN * heap.maxMemory():
        let_go(spark)


class Workspace:
    """Tables written to the shared folder, to cut lineage and to survive lost executors.

    Each workspace has a folder of its own.  ``keep`` writes and rereads a frame, with
    BATCH_ROWS texts at most in an Arrow batch meanwhile, as texts are long rows; ``drop``
    deletes tables that no later step reads, and ends what the driver held for them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        plain_reads(spark)
        lean_heap(spark)
        let_go(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
        with small_batches(self.spark, batch_rows):
            df.write.mode("overwrite").parquet(self.path(name))
        let_go_if_grown(self.spark)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
        let_go(self.spark)


def clear_old(spark: SparkSession, hours: float) -> list[str]:
    """Delete workspaces in the shared folder that were last written so many hours ago; returns their paths.

    Results are read lazily from workspaces, so only the caller knows when they can go.
    """
    root, jvm = shared_dir(spark), spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name = status.getPath().getName()
        if status.isDirectory() and re.search(r"-[0-9a-f]{12}$", name) and status.getModificationTime() <= (time.time() - 3600 * hours) * 1000:
            fs.delete(status.getPath(), True)
            gone.append(f"{root}/{name}")
    return gone


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of so many rows for the jobs begun inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
