"""A Python data source for tables of SQLite files, with filters pushed into the query.

Options: ``path`` (a file, or a folder of files with the same tables, as of many machines),
``table`` (a table name or a parenthesised query), ``columns`` (a DDL schema),
``skip_locked`` (a store that stays locked gives no rows instead of an error, the others
stay).  Files are opened read-only, with one retry while they are locked.  A range of row
ids of a large file is a partition, as are some small files together; a query is not cut.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ROWS_PER_PARTITION = 200_000
#: Files of under so many bytes are read whole, so many in one partition.
SMALL_BYTES, FILES_PER_PARTITION = 32 << 20, 32


def connect(path: str) -> sqlite3.Connection:
    for last in (False, True):
        try:
            found = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=1)
            found.execute("SELECT 1 FROM sqlite_master LIMIT 1")
            return found
        except sqlite3.OperationalError:
            if last:
                raise
            time.sleep(0.2)
    raise AssertionError


class Parts(InputPartition):
    """Stores, or ranges of row ids of them: (file, low, high), without ids for all rows."""

    def __init__(self, parts: list[tuple[str, int | None, int | None]]):
        super().__init__(parts)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.names = options["path"], options["table"], schema.names
        self.skip_locked = options.get("skip_locked", "false").lower() == "true"
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons and prefixes go into the query; a prefix is a range of the column, so its index serves."""
        for f in filters:
            if isinstance(f, StringStartsWith) and len(f.attribute) == 1 and f.value and ord(f.value[-1]) < 0xD7FF:
                name = f'"{f.attribute[0]}"'
                self.where += [(f"{name} >= ?", f.value), (f"{name} < ?", f.value[:-1] + chr(ord(f.value[-1]) + 1))]
                yield f  # numbers and blobs may stand in a text column of SQLite
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.where.append((f'"{f.attribute[0]}" IS NOT NULL', None))
            elif type(f) in OPERATORS and len(f.attribute) == 1 and isinstance(f.value, (str, int, float)):
                self.where.append((f'"{f.attribute[0]}" {OPERATORS[type(f)]} ?', f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = sorted(f for f in glob.glob(f"{self.path}/**", recursive=True) if os.path.isfile(f)) if os.path.isdir(self.path) else [self.path]
        if len(files) == 1:
            self._open(files[0])  # a single store that is not there fails at once
        large = [] if self.table.startswith("(") else [f for f in files if os.path.getsize(f) >= SMALL_BYTES]
        small = [(f, None, None) for f in files if f not in set(large)]
        found = [Parts(small[i : i + FILES_PER_PARTITION]) for i in range(0, len(small), FILES_PER_PARTITION)]
        return [*found, *[Parts([x]) for f in large for x in self._ranges(f)]]

    def _open(self, path: str) -> sqlite3.Connection | None:
        """A connection, or nothing for a locked store that may be skipped."""
        try:
            return connect(path)
        except sqlite3.OperationalError as error:
            if self.skip_locked and "locked" in str(error):
                return None
            raise

    def _ranges(self, path: str) -> list[tuple[str, int, int]]:
        db = self._open(path)
        if db is None:
            return []
        with db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [] if low is None else [(path, a, min(a + ROWS_PER_PARTITION - 1, high)) for a in range(low, high + 1, ROWS_PER_PARTITION)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source = self.table if self.table.startswith("(") else f'"{self.table}"'
        columns = ", ".join(f'"{n}"' for n in self.names)
        for path, low, high in partition.value:
            terms, values = [t for t, _ in self.where], [v for t, v in self.where if "?" in t]
            if low is not None:
                terms, values = [*terms, "rowid BETWEEN ? AND ?"], [*values, low, high]
            db = self._open(path)
            if db is not None:
                with db:
                    yield from db.execute(f"SELECT {columns} FROM {source}" + (f" WHERE {' AND '.join(terms)}" if terms else ""), values)


def unreadable(error: Exception) -> bool:
    """Whether a job failed as SQLite could not read a store; workers hand errors on as text."""
    return bool(re.search(r"^sqlite3\.\w+: ", str(error), re.MULTILINE))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, columns: str, skip_locked: bool = False):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("columns", columns).option("skip_locked", str(skip_locked)).load()
