"""Behavioural dimensions over sessions and skill events; ``by`` adds group keys to the global form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import basename, hour_bucket
from tracelake.operators.ordered import as_of, carry_last, exact_median, seconds

VIBE, LATE_HOUR, DAY = 5, 22, 86400.0


def local(ts: str, zone: str) -> Column:
    """Wall-clock time of an instant in a zone, whatever the session's zone is."""
    return F.convert_timezone(None, F.lit(zone), F.col(ts).cast("timestamp_ntz"))


def _ships(events: DataFrame) -> DataFrame:
    return events.where((F.col("event") == "completed") & (F.col("skill") == "ship"))


def _used() -> Column:
    return F.col("event").isin("completed", "started")


def compliance(entries: DataFrame) -> DataFrame:
    known = F.col("user_choice").isNotNull() & F.col("recommended").isNotNull()
    same = F.col("user_choice") == F.col("recommended")
    return entries.where(known).agg(F.count("*").alias("total_questions"), F.count_if(same).alias("matched_count"), F.avg(same.cast("double")).alias("ratio"))


def skill_diversity(events: DataFrame) -> DataFrame:
    return events.where(_used()).agg((F.count_distinct("skill").cast("double") / F.nullif(F.count("*"), F.lit(0)).cast("double")).alias("diversity"))


def timing(sessions: DataFrame, granularity: int = 6, zone: str = "UTC") -> DataFrame:
    """Sessions and mean events by start hour, all buckets present."""
    labels = sessions.sparkSession.range(0, 24, granularity).select(hour_bucket(F.col("id"), granularity).alias("label"))
    counted = sessions.where(F.col("started_at").isNotNull()).groupBy(hour_bucket(F.hour(local("started_at", zone)), granularity).alias("label")).agg(F.count("*").alias("n"), F.avg("event_count").alias("mean"))
    return labels.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("session_count"), F.coalesce("mean", F.lit(0.0)).alias("avg_event_count"))


def weekdays(sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Sessions, short share and mean events by weekday (Monday 0), all seven present."""
    days = sessions.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    counted = sessions.where(F.col("started_at").isNotNull()).groupBy(F.weekday(local("started_at", zone)).alias("weekday")).agg(
        F.count("*").alias("n"), F.avg((F.col("event_count") < VIBE).cast("double")).alias("vibe"), F.avg("event_count").alias("mean"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return days.join(counted, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("session_count"), zero("vibe").alias("vibe_rate"), zero("mean").alias("avg_event_count"))


def bimodal(sessions: DataFrame) -> DataFrame:
    n = F.coalesce("event_count", F.lit(0))
    return sessions.agg(F.avg((n < VIBE).cast("double")).alias("short_share"), F.avg(F.when(n >= VIBE, n)).alias("long_avg_events"))


def project_switch(sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Median distinct projects per active day; null under five days.  The median's buffer holds distinct counts only."""
    rows = sessions.where(F.col("started_at").isNotNull()).select(F.to_date(local("started_at", zone)).alias("day"), basename(F.col("cwd")).alias("project")).where(F.col("project").isNotNull())
    daily = rows.groupBy("day").agg(F.count_distinct("project").alias("n"))
    return daily.agg(F.when(F.count("*") >= 5, F.median("n")).alias("median_projects"))


def project_focus(sessions: DataFrame) -> DataFrame:
    """Most frequent project (least name on ties) and its share."""
    rows = sessions.select(basename(F.col("cwd")).alias("project")).where(F.col("project").isNotNull()).groupBy("project").agg(F.count("*").alias("n"))
    return rows.agg(F.min_by("project", F.struct(-F.col("n"), "project")).alias("project"), (F.max("n").cast("double") / F.sum("n").cast("double")).alias("share"))


def top_skill(events: DataFrame) -> DataFrame:
    rows = events.where(_used()).groupBy("skill").agg(F.count("*").alias("n"))
    enough = F.sum("n") >= 5
    return rows.agg(F.when(enough, F.min_by("skill", F.struct(-F.col("n"), "skill"))).alias("skill"), F.when(enough, F.max("n").cast("double") / F.sum("n").cast("double")).alias("share"))


def wins(events: DataFrame, k: int = 3) -> DataFrame:
    """Latest clean completions by date; equal dates in order of name."""
    clean = events.where((F.col("event") == "completed") & (F.col("outcome") == "clean"))
    return clean.select("skill", F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct().orderBy(F.desc("date"), "skill").limit(k)


def ship_cadence(events: DataFrame, by: list[str]) -> DataFrame:
    """Median days between ships; null under two ships."""
    ships = _ships(events).select(*by, "ts")
    gaps = carry_last(ships, by, ["ts"], F.col("ts"), "before").withColumn("gap", (F.unix_micros("ts") - F.unix_micros("before")).cast("double") / (DAY * 1e6))
    return exact_median(gaps, by, "gap", "median_days")


def plan_then_ship(events: DataFrame, by: list[str], window_seconds: float = 7 * DAY) -> DataFrame:
    """Share of ships with a completed plan review in the window before them, its ends included."""
    plans = events.where((F.col("event") == "completed") & F.col("skill").contains("plan-eng-review"))
    near = as_of(_ships(events), plans, by, "ts", "ts", F.col("ts"), "plan_ts")
    ok = F.coalesce(seconds("ts") - seconds("plan_ts") <= window_seconds, F.lit(False))
    return near.groupBy(*by).agg(F.count("*").alias("ships"), F.avg(ok.cast("double")).alias("ratio"))


def vibe_score(sessions: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Share of ships whose latest session before was short; ships without one count as not."""
    near = as_of(_ships(events), sessions, by, "ts", "started_at", F.struct("started_at", "session_id", "event_count"), "session")
    short = F.coalesce(F.coalesce(F.col("session.event_count"), F.lit(0)) < VIBE, F.lit(False)) & F.col("session").isNotNull()
    return near.groupBy(*by).agg(F.count("*").alias("ships"), F.avg(short.cast("double")).alias("score"))


def late_night_ships(sessions: DataFrame, events: DataFrame, by: list[str], zone: str = "UTC", window_seconds: float = DAY) -> DataFrame:
    """Share of sessions begun late that a ship follows within the window; null under three."""
    late = sessions.where(F.hour(local("started_at", zone)) >= LATE_HOUR)
    near = as_of(late, _ships(events), by, "started_at", "ts", F.col("ts"), "ship_ts", forward=True)
    ok = F.coalesce(seconds("ship_ts") - seconds("started_at") <= window_seconds, F.lit(False))
    return near.groupBy(*by).agg(F.count("*").alias("late_sessions"), F.when(F.count("*") >= 3, F.avg(ok.cast("double"))).alias("rate"))


def overplanning(events: DataFrame, by: list[str], window_seconds: float = 7 * DAY) -> DataFrame:
    """Share of office hours that no ship follows within the window; null under three."""
    office = events.where(_used() & F.col("skill").contains("office-hours"))
    near = as_of(office, _ships(events), by, "ts", "ts", F.col("ts"), "ship_ts", forward=True)
    none = ~F.coalesce(seconds("ship_ts") - seconds("ts") <= window_seconds, F.lit(False))
    return near.groupBy(*by).agg(F.count("*").alias("office_hours"), F.when(F.count("*") >= 3, F.avg(none.cast("double"))).alias("rate"))
