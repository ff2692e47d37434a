"""Secret scans, and the findings table as a fold of observations and user decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import dims, secrets
from tracelake.operators.ordered import carry_last


def clip(lines: DataFrame, limit: int | None = dims.LINE_LIMIT) -> DataFrame:
    """Lines cut at the limit of transcripts, with a mark; without a limit they stay whole."""
    if limit is None:
        return lines.withColumn("line_truncated", F.lit(False))
    cut = F.substring("line", 1, limit).alias("_cut"), (F.length("line") > limit).alias("line_truncated")
    return secrets.pinned(lines, *cut).withColumn("line", F.col("_cut")).drop("_cut")


def scan(lines: DataFrame, min_confidence: int = 7, limit: int | None = dims.LINE_LIMIT) -> DataFrame:
    """One row per unsuppressed hit of (file, line_no, line); raw values never leave this projection."""
    found = secrets.hits(lines, min_confidence, once=True, carry=["file", "line_no"], limit=limit).where("suppressed_by is null")
    snippet = secrets.redact(F.col("value"))
    return found.select(
        "file", "line_no", "category", snippet.alias("snippet_redacted"), "confidence", F.length("value").alias("full_length"),
        secrets.fingerprint(F.col("category"), snippet).alias("fingerprint"),
    )


def scan_contexts(lines: DataFrame, min_confidence: int = 7, limit: int | None = dims.LINE_LIMIT, around: int = 200) -> DataFrame:
    """Hits with the raw text around them, for a local viewer that must show it; other outputs are redacted."""
    return secrets.contexts(clip(lines, limit), min_confidence, around)


def audit(rows: DataFrame, min_confidence: int = 7, text: str = "line", limit: int | None = dims.LINE_LIMIT, split: bool = False) -> DataFrame:
    """Suppressed hits by category and rule, of lines or of whole texts that are ``split`` into lines."""
    found = secrets.hits(rows, min_confidence, text=text, carry=[], limit=limit, split=split).where("suppressed_by is not null")
    return found.groupBy("category", "suppressed_by").agg(F.count("*").alias("hits"))


def by_danger(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows by their category's confidence, highest first: entropy after the vendors, unknown categories last; then by name."""
    known = {d.category: d.confidence for d in dims.DETECTORS} | {"high_entropy": 6}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("category")), F.lit(0))
    return rows.orderBy(F.desc(rank), "category", *ties)


def fold(log: DataFrame) -> DataFrame:
    """State of each fingerprint from its log (fingerprint, seq, ts, kind, muted_until).

    Kinds: obs, ack, mute, resolve.  An observation whose predecessor is a resolve opens
    the finding anew and counts from one.  The last decision since the last (re)opening
    is the status.  Decisions on unknown fingerprints do nothing.  ``seq`` is unique
    within a fingerprint; all steps are partial aggregates, or windows over pieces of bounded length.
    """
    key = ["fingerprint"]
    rows = carry_last(log, key, ["seq"], F.col("kind"), "before")
    obs = F.col("kind") == "obs"
    opened = rows.groupBy("fingerprint").agg(
        F.coalesce(F.max(F.when(obs & (F.col("before") == "resolve"), F.col("seq"))), F.min(F.when(obs, F.col("seq")))).alias("opened"),
        F.min(F.when(obs, F.col("ts"))).alias("first_seen"),
    ).where(F.col("opened").isNotNull())
    since = rows.join(opened, "fingerprint").where(F.col("seq") >= F.col("opened"))
    decided = ~obs
    return since.groupBy("fingerprint").agg(
        F.min("first_seen").alias("first_seen"), F.max(F.when(obs, F.col("ts"))).alias("last_seen"), F.count_if(obs).alias("count"),
        F.coalesce(F.max_by(F.when(decided, F.col("kind")), F.when(decided, F.col("seq"))), F.lit("new")).alias("decision"),
        F.max_by(F.when(decided, F.col("muted_until")), F.when(decided, F.col("seq"))).alias("muted_until"),
    ).select("fingerprint", "first_seen", "last_seen", "count", F.element_at(F.create_map(*[F.lit(x) for x in ("new", "new", "ack", "ack", "mute", "muted", "resolve", "resolved")]), F.col("decision")).alias("status"), F.when(F.col("decision") == "mute", F.col("muted_until")).alias("muted_until"))


def expire_mutes(findings: DataFrame, now: str) -> DataFrame:
    """Findings whose mute has run out read as new."""
    over = (F.col("status") == "muted") & F.col("muted_until").isNotNull() & (F.col("muted_until") <= F.lit(now).cast("timestamp"))
    return findings.withColumn("status", F.when(over, "new").otherwise(F.col("status"))).withColumn("muted_until", F.when(~over, F.col("muted_until")))


def page(findings: DataFrame, limit: int = 50, offset: int = 0, status: str | None = None, category: str | None = None, since: str | None = None) -> DataFrame:
    """A page by last sighting, newest first; filters compose."""
    rows = findings
    if status:
        rows = rows.where(F.col("status") == status)
    if category:
        rows = rows.where(F.col("category") == category)
    if since:
        rows = rows.where(F.col("last_seen") >= F.lit(since).cast("timestamp"))
    return rows.orderBy(F.desc("last_seen"), "fingerprint").offset(offset).limit(min(limit, 500))


def playbooks(spark) -> DataFrame:
    return spark.createDataFrame([(c, *v) for c, v in dims.PLAYBOOKS.items()], "category string, severity string, advice string")


def with_playbook(findings: DataFrame) -> DataFrame:
    """Severity and advice by category, the general ones where a category has none."""
    known = F.broadcast(playbooks(findings.sparkSession))
    severity, advice = dims.PLAYBOOK_FALLBACK
    return findings.join(known, "category", "left").withColumn("severity", F.coalesce("severity", F.lit(severity))).withColumn("advice", F.coalesce("advice", F.lit(advice)))


def fan_out(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Each event with each enabled hook that wants its kind and, if it filters, its category.

    Hooks are a configuration table: exploded by kind (and category) and broadcast, so
    events are worked out once and stay where they are; there are few kinds to shuffle by.
    """
    wants = hooks.where("enabled").select("hook_id", F.explode(F.array_distinct("kinds")).alias("_kind"), "categories")
    every = wants.where(F.coalesce(F.size("categories"), F.lit(0)) <= 0).select("hook_id", "_kind", F.lit(None).cast("string").alias("_category"), F.lit(True).alias("_every"))
    some = wants.where(F.size("categories") > 0).select("hook_id", "_kind", F.explode(F.array_distinct("categories")).alias("_category"), F.lit(False).alias("_every"))
    known = F.broadcast(every.unionByName(some))
    return events.join(known, (F.col("kind") == F.col("_kind")) & (F.col("_every") | (F.col("category") == F.col("_category")))).select(*events.columns, "hook_id")


def payload(kind: str = "plain") -> Column:
    """Body of a delivery: the event with its advice, or an incident in the Events API v2 shape."""
    if kind == "plain":
        rotation = F.struct("severity", "advice").alias("rotation")
        return F.to_json(F.struct(F.col("kind").alias("event"), "fingerprint", "category", "snippet_redacted", "first_seen", "count", rotation))
    level = F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "high", "error").when(F.col("severity") == "low", "info").otherwise("warning")
    body = F.struct(F.concat(F.col("category"), F.lit(" leaked")).alias("summary"), level.alias("severity"), F.struct("snippet_redacted", "advice", "count").alias("custom_details"))
    return F.to_json(F.struct(F.lit("trigger").alias("event_action"), F.col("fingerprint").alias("dedup_key"), body.alias("payload")))


def catches_by_day(hits: DataFrame, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """Accepted hits per local day in [start, end)."""
    day = F.to_date(F.convert_timezone(None, F.lit(zone), F.col("ts").cast("timestamp_ntz")))
    return hits.select(day.alias("day")).where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date"))).groupBy("day").agg(F.count("*").alias("catches"))
