"""A table of last states, kept as deltas of batches and a snapshot that takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import children, delete


class LastStates:
    """Rows of which the last by key counts; a batch writes one delta, and ``compact`` merges deltas into a snapshot.

    ``delta/batch=n`` holds what batch n wrote.  The snapshot is cut into buckets by a hash
    of the key; ``merged/upto=n/bucket=b`` holds a bucket as of batch n, and
    ``current/upto=n``, written last, tells which version of each bucket counts.  So a
    merge reads and writes only buckets that its deltas touch, readers read the snapshot
    and the deltas behind it, and a batch that runs again changes nothing.  Rows for which
    the condition ``over`` holds leave the table with the next merge.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str], buckets: int = 64, over: str = "false"):
        self.spark, self.path, self.key, self.order, self.buckets, self.over = spark, path.rstrip("/"), key, order, buckets, over
        self.schema = f"{schema}, batch long"
        self.columns = [c.split()[0] for c in self.schema.split(", ")]

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the complete folders batch=n or upto=n, in order."""
        names = children(self.spark, f"{self.path}/{folder}")
        return sorted(int(n.partition("=")[2]) for n in names if "=" in n and "_SUCCESS" in children(self.spark, f"{self.path}/{folder}/{n}"))

    def upto(self) -> int:
        """The last batch in the snapshot; -1 if there is none."""
        return max(self._numbers("current"), default=-1)

    def has(self, batch: int) -> bool:
        return batch <= self.upto() or batch in self._numbers("delta")

    def put(self, batch: int, rows: DataFrame) -> None:
        """Write what a batch has changed; once it is in the snapshot this does nothing."""
        if batch > self.upto():
            named = rows.withColumn("batch", F.lit(batch).cast("long")).select(self.columns)
            named.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _versions(self) -> dict[int, int]:
        upto = self.upto()
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/current/upto={upto}").collect() if upto >= 0 else []
        return {r["bucket"]: r["version"] for r in rows}

    def _snapshot(self, versions: dict[int, int]) -> DataFrame:
        return self._files([f"{self.path}/merged/upto={v}/bucket={b}" for b, v in sorted(versions.items())])

    def _open(self) -> list[int]:
        return [n for n in self._numbers("delta") if n > self.upto()]

    def _deltas(self, batches: list[int]) -> DataFrame:
        return self._files([f"{self.path}/delta/batch={n}" for n in batches])

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c != self.key]
        last = F.max_by(F.struct(*rest), F.struct("batch", *self.order)).alias("s")
        return rows.groupBy(self.key).agg(last).select(self.key, "s.*").select(self.columns)

    def read(self) -> DataFrame:
        """The last row of each key."""
        return self._last(self._snapshot(self._versions()).unionByName(self._deltas(self._open())))

    def log(self) -> DataFrame:
        """All rows of the deltas that are still there."""
        return self._deltas(self._numbers("delta"))

    def compact(self) -> None:
        """Merge all open deltas into the buckets that they touch."""
        deltas, versions = self._open(), self._versions()
        if not deltas:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        changed = self._deltas(deltas)
        touched = [r["bucket"] for r in changed.select(bucket).distinct().collect()]  # as many as there are buckets, at most
        old = self._snapshot({b: v for b, v in versions.items() if b in touched})
        upto = deltas[-1]
        self._last(old.unionByName(changed)).where(f"NOT coalesce({self.over}, false)").select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/merged/upto={upto}")
        there = [int(n.partition("=")[2]) for n in children(self.spark, f"{self.path}/merged/upto={upto}") if "=" in n]
        now = sorted(({b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(there, upto)).items())
        self.spark.createDataFrame(now, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/current/upto={upto}")

    def vacuum(self) -> None:
        """Delete deltas that are in the snapshot and versions that no bucket has; not while somebody reads."""
        upto, used = self.upto(), set(self._versions().values())
        for folder, gone in (("delta", lambda n: n <= upto), ("merged", lambda n: n not in used), ("current", lambda n: n < upto)):
            for name in children(self.spark, f"{self.path}/{folder}"):
                if "=" in name and gone(int(name.partition("=")[2])):
                    delete(self.spark, f"{self.path}/{folder}/{name}")
