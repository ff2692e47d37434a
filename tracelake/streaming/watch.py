"""The watch job: follow transcripts, detect secrets, drop repeats, keep findings, hand out alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import secrets
from tracelake.functions.storage import mounted
from tracelake.operators.findings import fan_out, payload, with_playbook
from tracelake.sinks.tables import LastStates
from tracelake.streaming import state
from tracelake.streaming.state import stateful

TTL = dt.timedelta(minutes=5)
HIT = "category string, fingerprint string, snippet_redacted string, file string, byte_offset long, seen_at timestamp"
FINDING = "fingerprint string, category string, snippet_redacted string, kind string, status string, count long, first_seen timestamp, last_seen timestamp, muted_until timestamp, note string"
ORIGIN = "event string, file string, byte_offset long, order_at long"
DECISION = "fingerprint string, kind string, seen_at timestamp, muted_until timestamp, note string"


def follow(spark: SparkSession, path: str, plans: str) -> DataFrame:
    """Appended lines of the files under a folder; ``plans`` is a folder of the stream's own."""
    from tracelake.sources.tail import TailSource

    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail_lines").option("path", path).option("plans", plans).load()


def ticks(spark: SparkSession, every_seconds: float = 1) -> DataFrame:
    """A row whenever so much time has gone by: batches without other input, for what is due."""
    from tracelake.sources.tail import ClockSource

    spark.dataSource.register(ClockSource)
    return spark.readStream.format("clock_ticks").option("everySeconds", str(every_seconds)).load()


def detect(lines: DataFrame, now=None) -> DataFrame:
    """Hits of (file, byte_offset, line) rows; works on streams and tables alike."""
    hit = secrets.hits(lines, once=True, carry=["file", "byte_offset"]).where("suppressed_by is null")
    snippet = secrets.redact(F.col("value"))
    return hit.select("category", secrets.fingerprint(F.col("category"), snippet).alias("fingerprint"), snippet.alias("snippet_redacted"), "file", "byte_offset", (F.current_timestamp() if now is None else now).alias("seen_at"))


def drop_repeats(hits: DataFrame, ttl: dt.timedelta = TTL) -> DataFrame:
    """Hits that come more than the ttl after the last one let through of their fingerprint, so of their category and snippet.

    The state of a fingerprint is one time, and gone once it is older than the ttl.
    Queries must be started inside ``stateful``.
    """
    rows = hits.withColumn("order_at", F.unix_micros("seen_at")).withColumn("seen_at", F.col("order_at"))
    names = [*hits.columns, "order_at"]
    kept = rows.select(names).groupBy("fingerprint").transformWithState(state.Quiet(ttl, ["order_at", "byte_offset"]), rows.select(names).schema, "append", "ProcessingTime")
    return kept.withColumn("seen_at", F.timestamp_micros("seen_at")).select(hits.columns)


def log_of(hits: DataFrame, decisions: DataFrame | None = None, clock: DataFrame | None = None) -> DataFrame:
    """Hits as observations, decisions (DECISION) and ticks, as the log that ``keep_findings`` reads; with their place."""
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    names = ["fingerprint", "category", "snippet_redacted", "kind", "order_at", "muted_until", "note", "file", "byte_offset"]
    rows = hits.withColumns({"kind": F.lit("obs"), "order_at": F.unix_micros("seen_at"), "muted_until": none, "note": text}).select(names)
    if decisions is not None:
        said = {"category": text, "snippet_redacted": text, "file": text, "byte_offset": F.lit(-1).cast("long"), "order_at": F.unix_micros("seen_at"), "muted_until": F.unix_micros("muted_until")}
        rows = rows.unionByName(decisions.withColumns(said).select(names))
    if clock is not None:
        tick = {"fingerprint": F.lit(""), "category": text, "snippet_redacted": text, "kind": F.lit("tick"), "order_at": F.col("micros"), "muted_until": none, "note": text, "file": text, "byte_offset": F.lit(-1).cast("long")}
        rows = rows.unionByName(clock.withColumns(tick).select(names))
    return rows


def keep_findings(log: DataFrame, ttl: dt.timedelta | None = None) -> DataFrame:
    """Findings (FINDING, ORIGIN) from a log of observations and decisions (kind: obs, ack, mute, resolve, note), updated as they come.

    Each row of the log gives the state after it, with kind new_finding, reopened or
    updated.  With a ``ttl`` repeats are dropped as by ``drop_repeats``; a row of kind
    dropped counts those of a batch.  A mute that ends gives a row of event ``expire``.
    Queries must be started inside ``stateful``.
    """
    found = log.groupBy("fingerprint").transformWithState(state.Findings(ttl), state.STATE, "append", "ProcessingTime")
    times = {"first_seen": F.timestamp_micros("first"), "last_seen": F.timestamp_micros("last"), "muted_until": F.timestamp_micros("muted")}
    return found.withColumns(times).select([c.split()[0] for c in f"{FINDING}, {ORIGIN}".split(", ")])


def alerts(findings: DataFrame, hooks: DataFrame) -> DataFrame:
    """Deliveries of new and reopened findings: hook, fingerprint, kind, body, with the place of the change that they tell of."""
    fresh = with_playbook(findings.where(F.col("kind").isin("new_finding", "reopened")))
    return fan_out(fresh, hooks).select("hook_id", "fingerprint", "kind", payload().alias("body"), "order_at")


DEAD_LETTER = "hook_id string, fingerprint string, body string, attempts int, last_error string, attempted_at timestamp"
DELIVERY = f"delivery_id string, {DEAD_LETTER}, status string, due_at timestamp"
#: Seconds before each attempt, and failures in a row after which a hook's other deliveries wait for their next turn.
WAITS = (0, 10, 60, 600)
TIRED = 3


def deliveries(found: DataFrame, batch: int) -> DataFrame:
    """Open deliveries of alerts; the id, the same when a batch runs again, tells a receiver that it has a delivery already."""
    # several changes of one finding in a batch differ in order_at
    key = F.sha2(F.concat_ws("|", "hook_id", "fingerprint", "kind", F.lit(batch), F.col("order_at").cast("string")), 256)
    none = F.lit(None)
    return found.select(
        key.alias("delivery_id"), "hook_id", "fingerprint", "body", F.lit(0).alias("attempts"), none.cast("string").alias("last_error"), none.cast("timestamp").alias("attempted_at"),
        F.lit("open").alias("status"), none.cast("timestamp").alias("due_at"))


def attempt(send: Callable[[str, str, str], int], waits: tuple[float, ...] = WAITS, now: Callable[[], dt.datetime] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A mapInPandas function that posts each delivery (DELIVERY) once and returns it as done, dead, or open with its next due time.

    ``send(hook_id, body, delivery_id)`` gives an HTTP status; 4xx is final, others are due
    again after the next wait.  Nothing waits here: a hook that failed TIRED times in a row
    in this task is not asked again, and what is left for it is due with its next turn.
    """
    clock = now or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def post(r) -> tuple[str, bool]:
        try:
            status = send(r.hook_id, r.body, r.delivery_id)
        except OSError as e:
            return str(e), False
        return ("" if 200 <= status < 300 else f"status {status}"), 400 <= status < 500

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed: dict[str, int] = {}
        for part in parts:
            out = []
            for r in part.itertuples():
                at, tries = clock(), int(r.attempts)
                soon = at + dt.timedelta(seconds=waits[min(tries + 1, len(waits) - 1)])
                if failed.get(r.hook_id, 0) >= TIRED:
                    out.append((r.delivery_id, r.hook_id, r.fingerprint, r.body, tries, r.last_error, r.attempted_at, "open", soon))
                    continue
                error, final = post(r)
                failed[r.hook_id] = 0 if not error or final else failed.get(r.hook_id, 0) + 1
                status = "done" if not error else "dead" if final or tries + 1 >= len(waits) else "open"
                out.append((r.delivery_id, r.hook_id, r.fingerprint, r.body, tries + 1, error or None, at, status, soon if status == "open" else None))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in DELIVERY.split(", ")])
            yield frame.astype({"attempted_at": "datetime64[us]", "due_at": "datetime64[us]"})

    return run


def queue_of(spark: SparkSession, table_dir: str) -> LastStates:
    return LastStates(spark, f"{table_dir}/deliveries", DELIVERY, "delivery_id", ["attempts"], over="status = 'done'")


def findings_of(spark: SparkSession, table_dir: str) -> LastStates:
    return LastStates(spark, f"{table_dir}/findings", f"{FINDING}, {ORIGIN}", "fingerprint", ["order_at", "byte_offset"])


def dead_letter(queue: LastStates) -> DataFrame:
    """Deliveries that are given up."""
    return queue.read().where("status = 'dead'").select([c.split()[0] for c in DEAD_LETTER.split(", ")])


def dead_letters(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The latest failed deliveries."""
    return rows.orderBy(F.desc("attempted_at"), "hook_id", "fingerprint").limit(limit)


def requeue(rows: DataFrame, send: Callable[[str, str, str], int], hook_id: str | None = None) -> DataFrame:
    """Deliver dead letters again, of one hook if given; returns those that are still dead, to be written as the new table.

    Bodies that are no JSON are not sent and stay.  Attempts add up.
    """
    asked = F.try_parse_json("body").isNotNull() & (F.lit(True) if hook_id is None else F.col("hook_id") == hook_id)
    key = F.sha2(F.concat_ws("|", F.lit("again"), "hook_id", "fingerprint", "body"), 256)
    names = [c.split()[0] for c in DELIVERY.split(", ")]
    again = rows.where(asked).withColumns({"delivery_id": key, "status": F.lit("open"), "due_at": F.lit(None).cast("timestamp")}).select(names)
    failed = again.repartition("hook_id").mapInPandas(attempt(send, (0,)), DELIVERY).where("status <> 'done'")
    return rows.where(~F.coalesce(asked, F.lit(False))).unionByName(failed.select(rows.columns))


def sweep(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Hits of a full scan of (file, byte_offset, line) whose finding is not known: what a watch has missed."""
    return detect(lines).join(findings.select("fingerprint"), "fingerprint", "left_anti")


COUNTER = "seen_at timestamp, catches long, dropped long, new_findings long, reopened long, expired long"


def counters(states: DataFrame) -> DataFrame:
    """Counts of a batch by hour (COUNTER): hits let through and dropped, findings new and reopened, mutes that ended."""
    n = lambda test: F.count_if(F.expr(test))
    hour = F.date_trunc("hour", F.timestamp_micros("order_at")).alias("seen_at")
    return states.groupBy(hour).agg(
        n("event = 'obs'").alias("catches"), F.coalesce(F.sum(F.when(F.col("kind") == "dropped", F.col("count"))), F.lit(0)).alias("dropped"),
        n("kind = 'new_finding'").alias("new_findings"), n("kind = 'reopened'").alias("reopened"), n("event = 'expire'").alias("expired"))


def watch(
    spark: SparkSession, path: str, table_dir: str, checkpoint: str, hooks: DataFrame, send: Callable[[str, str, str], int], decisions: DataFrame | None = None,
    ttl: dt.timedelta = TTL, waits: tuple[float, ...] = WAITS, interval: str | None = None, tick_seconds: float = 1, compact_every: int = 20,
):
    """Start the whole job; with an ``interval`` it goes on, else it takes what is there and ends.

    ``decisions`` is a stream of user decisions (DECISION).  Folders under ``table_dir``:
    hits and counters by batch; findings and deliveries as tables of last states
    (``findings_of``, ``queue_of``).  A batch has folders of its own, so one that is run
    again after a failure replaces what it had written, and does not send again what is
    noted as sent.  A clock gives a batch each ``tick_seconds``, so mutes end and deliveries
    are tried again without new lines.
    """
    findings, queue = findings_of(spark, table_dir), queue_of(spark, table_dir)

    def batch(states: DataFrame, n: int) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{table_dir}/{name}/batch={n}")
        kept = states.persist()
        try:
            changes = kept.where("kind <> 'dropped'")
            if not kept.isEmpty():
                put(changes.where("event = 'obs'").withColumn("seen_at", F.col("last_seen")).select([c.split()[0] for c in HIT.split(", ")]), "hits")
                findings.put(n, changes)
                put(counters(kept), "counters")
            if not queue.has(n):
                due = queue.read().where("status = 'open' AND due_at <= current_timestamp()").drop("batch")
                every = due.unionByName(deliveries(alerts(changes, hooks), n))
                queue.put(n, every.repartition("hook_id").mapInPandas(attempt(send, waits), DELIVERY))
        finally:
            kept.unpersist()
        if n % compact_every == compact_every - 1:
            findings.compact()
            queue.compact()

    log = log_of(detect(follow(spark, path, f"{mounted(checkpoint)}/plans")), decisions, ticks(spark, tick_seconds))
    writer = keep_findings(log, ttl).writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream")
    with stateful(spark):
        return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()
