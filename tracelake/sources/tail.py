"""Streaming sources: appended lines of files, by byte offset; and the ticks of a clock.

Spark's file stream reads a file once; this one reads what was appended since.  The driver
plans spans of files from their sizes; executors read the lines that begin in their spans,
each to its end.  A line is read once it is complete; a file that shrank is read from its
start.  The folder must be one that driver and executors share.

What is planned goes to a log of plans, each a list of (file, begin, end) of the files that
it moves on, with a list of all files now and then.  A stream's offset is the number of a
plan, however many files there are.
"""

from __future__ import annotations

import bisect
import glob
import json
import os
import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPAN_BYTES = 16 << 20
BYTES_PER_BATCH = 1 << 30
BLOCK = 1 << 16
#: Plans from one list of all files to the next, threads that look for line ends, and the least share of a file in a plan.
PLANS_PER_LIST, THREADS, LEAST_SHARE = 50, 32, 1 << 16


class Span(InputPartition):
    """Lines that begin in [start, stop) of a file; ``stop`` lies behind a line's end."""

    def __init__(self, path: str, start: int, stop: int, end: int):
        super().__init__((path, start, stop, end))


def last_line_end(path: str, low: int, high: int) -> int:
    """Offset behind the last line feed in [low, high), or ``low``; read from the back in blocks."""
    with open(path, "rb") as f:
        while high > low:
            begin = max(low, high - BLOCK)
            f.seek(begin)
            at = f.read(high - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            high = begin
    return low


def next_line_end(path: str, low: int, high: int) -> int:
    """Offset behind the first line feed in [low, high), or ``low`` where there is none."""
    with open(path, "rb") as f:
        f.seek(low)
        at = low
        while at < high and (data := f.read(min(BLOCK, high - at))):
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
    return low


class PlanLog:
    """Numbered plans in a folder: ``n.json`` lists [file, begin, end], ``n.all.json`` the ends of all files after plan n."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, n: int, whole: bool = False) -> str:
        return os.path.join(self.folder, f"{n}.all.json" if whole else f"{n}.json")

    def _load(self, path: str):
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def _store(self, path: str, value) -> None:
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(value, f)
        os.replace(f"{path}.tmp", path)

    def numbers(self, whole: bool = False) -> list[int]:
        pattern = re.compile(r"(\d+)\.all\.json" if whole else r"(\d+)\.json")
        return sorted(int(m[1]) for name in os.listdir(self.folder) if (m := pattern.fullmatch(name)))

    def spans(self, n: int) -> list[list]:
        return self._load(self._path(n))

    def state(self) -> tuple[int, dict[str, int]]:
        """Number of the last plan, and the ends of all files after it."""
        lists = self.numbers(whole=True)
        n = lists[-1] if lists else 0
        ends = self._load(self._path(n, True)) if lists else {}
        for n in [x for x in self.numbers() if x > n]:  # noqa: B020
            ends |= {path: end for path, _, end in self.spans(n)}
        return n, ends

    def add(self, n: int, spans: list[tuple[str, int, int]], ends: dict[str, int]) -> None:
        self._store(self._path(n), spans)
        if n % PLANS_PER_LIST == 0:
            self._store(self._path(n, True), ends)

    def forget(self, done: int) -> None:
        """Delete plans of batches that are done and that a list of all files covers."""
        lists = [n for n in self.numbers(whole=True) if n <= done]
        if lists:
            for n in self.numbers():
                if n < min(lists[-1], done):
                    os.remove(self._path(n))
            for n in lists[:-1]:
                os.remove(self._path(n, True))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.limit = int(options.get("maxBytesPerBatch", BYTES_PER_BATCH))
        self.span = int(options.get("spanBytes", SPAN_BYTES))
        self.plans = options["plans"]
        self.log: PlanLog | None = None

    def _state(self) -> PlanLog:
        if self.log is None:
            self.log = PlanLog(self.plans)
            self.n, self.ends = self.log.state()
            self.cursor = self.log.spans(self.n)[-1][0] if self.n in self.log.numbers() else ""
        return self.log

    def initialOffset(self) -> dict:
        return {"plan": 0}

    def _end(self, path: str, begin: int, size: int, share: int) -> int:
        """End of the complete lines in a share of a file; of one line at least, if it is complete."""
        end = last_line_end(path, begin, min(size, begin + share))
        return next_line_end(path, begin, size) if end == begin and begin + share < size else end

    def latestOffset(self) -> dict:
        """Plan what the next batch takes, if there is anything: files share its bytes evenly, beginning behind the file served last."""
        log, grown = self._state(), []
        for path in sorted(glob.glob(os.path.join(self.root, "**", self.pattern), recursive=True)):
            size, begin = os.path.getsize(path), self.ends.get(path, 0)
            begin = 0 if size < begin else begin
            if size > begin:
                grown.append((path, begin, size))
        first = bisect.bisect_right([g[0] for g in grown], self.cursor)
        grown = grown[first:] + grown[:first]
        taken: dict[str, tuple[int, int]] = {}
        left = self.limit
        with ThreadPoolExecutor(THREADS) as pool:
            while grown and left > 0:
                share = min(max(left // len(grown), LEAST_SHARE), left)
                served = grown[: max(1, -(-left // share))]
                ends = list(pool.map(lambda g: self._end(*g, share), served))  # noqa: B023
                rest = []
                for (path, begin, size), end in zip(served, ends, strict=True):
                    if end > begin:
                        taken[path] = (taken.get(path, (begin, 0))[0], end)
                        left -= end - begin
                        if end < size:
                            rest.append((path, end, size))
                grown = grown[len(served) :] + rest
        if taken:
            spans = [(path, begin, end) for path, (begin, end) in taken.items()]
            self.n, self.cursor = self.n + 1, spans[-1][0]
            self.ends |= {path: end for path, _, end in spans}
            log.add(self.n, spans, self.ends)
        return {"plan": self.n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = self._state()
        planned = [s for n in range(start["plan"] + 1, end["plan"] + 1) for s in log.spans(n)]
        return [Span(path, a, min(a + self.span, stop), stop) for path, begin, stop in planned for a in range(begin, stop, self.span)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, start, stop, end = partition.value
        with open(path, "rb") as f:
            if start:
                f.seek(start - 1)
                if f.read(1) != b"\n":
                    f.readline()  # this line began in the span before
            while (at := f.tell()) < stop:
                line = f.readline(end - at)
                if not line:
                    break
                yield path, at, line.removesuffix(b"\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        self._state().forget(end["plan"])


class TailSource(DataSource):
    """Options: ``path``, ``pattern``, ``plans`` (a folder of the stream's own, kept as long as its checkpoint), ``maxBytesPerBatch``, ``spanBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "file string, byte_offset bigint, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(self.options)


class ClockReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.every = float(options.get("everySeconds", 1))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": int(time.time() / self.every)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(int(end["tick"] * self.every * 1e6))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value,)

    def commit(self, end: dict) -> None:
        pass


class ClockSource(DataSource):
    """One row whenever ``everySeconds`` have gone by: timers and due work go on in a stream that has no other input."""

    @classmethod
    def name(cls) -> str:
        return "clock_ticks"

    def schema(self) -> str:
        return "micros bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ClockReader(self.options)
