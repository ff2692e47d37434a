"""State of the watch job: findings and quiet times by key, in Spark's RocksDB state store, with timers and a time to live."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the job must run with: states with timers live in RocksDB, and batches come with input (a clock's, too), so that a single run ends.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def stateful(spark: SparkSession):
    """Settings for queries that are started inside; the session's own come back."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Quiet(StatefulProcessor):
    """Lets a hit through if it comes more than the ttl after the last one let through of its key; the state is gone after the ttl."""

    def __init__(self, ttl: dt.timedelta, order: list[str]):
        self.micros, self.order = ttl // dt.timedelta(microseconds=1), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seen bigint", ttlDurationMs=max(self.micros // 1000, 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            if last is None or row["order_at"] - last > self.micros:
                last = row["order_at"]
                yield row
        self.last.update((last,))

    def close(self) -> None:
        pass


FINDING = "category string, snippet string, status string, count bigint, first bigint, last bigint, muted bigint, note string"
STATE = "fingerprint string, category string, snippet_redacted string, kind string, status string, count bigint, first bigint, last bigint, muted bigint, note string, event string, file string, byte_offset bigint, order_at bigint"
STATUS_OF = {"ack": "ack", "mute": "muted", "resolve": "resolved"}


class Findings(StatefulProcessor):
    """The finding of a fingerprint, from observations and decisions in order of ``order_at``.

    An observation of a resolved finding opens it anew with a count of one; others count
    on.  Observations within the ttl of the last one let through, which is the finding's
    ``last``, are dropped and only counted; so one value is read and written a key, if it
    changes.  A note changes the note.  A mute with an end sets a timer, which makes the
    finding new again without any input of its own.
    """

    def __init__(self, ttl: dt.timedelta | None):
        self.micros = None if ttl is None else ttl // dt.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.finding = handle.getValueState("finding", FINDING)

    def _row(self, key, now: dict, kind: str, event: str, file, byte_offset: int, at: int) -> Row:
        return Row(
            fingerprint=key[0], category=now["category"], snippet_redacted=now["snippet"], kind=kind, status=now["status"], count=now["count"], first=now["first"],
            last=now["last"], muted=now["muted"], note=now["note"], event=event, file=file, byte_offset=byte_offset, order_at=at)

    def _load(self) -> dict | None:
        names = [c.split()[0] for c in FINDING.split(", ")]
        found = self.finding.get()
        return None if found is None else dict(zip(names, found, strict=True))

    def _mute(self, now: dict, until: int | None) -> None:
        """Set or take back the timer of a mute."""
        if now["muted"] is not None:
            self.handle.deleteTimer(max(now["muted"] // 1000, 1))
        now["muted"] = until
        if until is not None:
            self.handle.registerTimer(max(until // 1000, 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._load()
        now, dropped, at = before and dict(before), 0, 0
        for r in sorted(rows, key=lambda r: (r["order_at"], r["byte_offset"])):
            kind, at = "updated", r["order_at"]
            if r["kind"] == "obs":
                if self.micros is not None and now is not None and at - now["last"] <= self.micros:
                    dropped += 1
                    continue
                if now is None:
                    now, kind = {"category": r["category"], "snippet": r["snippet_redacted"], "status": "new", "count": 1, "first": at, "last": at, "muted": None, "note": None}, "new_finding"
                elif now["status"] == "resolved":
                    now |= {"status": "new", "count": 1, "last": at}
                    kind = "reopened"
                else:
                    now |= {"count": now["count"] + 1, "last": at}
            elif now is None:
                continue
            elif r["kind"] == "note":
                now["note"] = r["note"]
            elif r["kind"] in STATUS_OF:
                now["status"] = STATUS_OF[r["kind"]]
                self._mute(now, r["muted_until"] if r["kind"] == "mute" else None)
            else:
                continue
            yield self._row(key, now, kind, r["kind"], r["file"], r["byte_offset"], at)
        if now is not None:
            if now != before:
                self.finding.update(tuple(now.values()))
            if dropped:
                yield self._row(key, now | {"count": dropped}, "dropped", "drop", None, -1, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if now is not None and now["status"] == "muted" and now["muted"] is not None and max(now["muted"] // 1000, 1) <= at:
            now |= {"status": "new", "muted": None}
            self.finding.update(tuple(now.values()))
            yield self._row(key, now, "updated", "expire", None, -1, at * 1000)

    def close(self) -> None:
        pass
