"""Whole reports: activity of a window in one row, its difference by provider, and all habits at once."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.money import usd
from tracelake.functions.text import normalize_skill_name
from tracelake.operators import behaviour, usage

TOP = 5


def slices(used: DataFrame) -> DataFrame:
    """Sessions, cost and tokens by provider, dearest first and then by name."""
    return usage.activity_by_provider(used).orderBy(F.desc("cost_usd"), "provider")


def first_met_top(df: DataFrame, value: Column, at: Column, name: str, k: int = TOP) -> DataFrame:
    """The k most frequent values; of equal counts the one met first, in order of ``at``, then of name."""
    rows = df.select(value.alias(name), at.alias("_at")).where(F.col(name).isNotNull())
    return rows.groupBy(name).agg(F.count("*").alias("count"), F.min("_at").alias("_at")).orderBy(F.desc("count"), "_at", name).limit(k).drop("_at")


def _listed(rows: DataFrame, part: str, columns: list[str], order: Column) -> DataFrame:
    """A few rows as one row with an array of structs in order."""
    item = F.struct(order.alias("_order"), F.struct(*columns).alias("_item"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_item"]).alias(part))


def activity_report(used: DataFrame, sessions: DataFrame, invocations: DataFrame, start: str, end: str) -> DataFrame:
    """One row: session_count, cost_usd, total_tokens, by_provider, top_skills, top_topics of [start, end).

    A session is active if it has usage in the window, whenever it began.  Slices are in
    order of cost, tops in order of count and then name.  All parts are one-row tables,
    joined on a constant.
    """
    inside = usage.in_window(used, start, end)
    total = usage.activity(inside)
    providers = _listed(usage.activity_by_provider(inside), "by_provider", ["provider", "sessions", "cost_usd", "total_tokens"], F.struct(-F.col("cost_usd"), "provider"))
    by_count = F.struct(-F.col("count"), F.col("name"))
    skills = usage.top_counts(usage.in_window(invocations, start, end), normalize_skill_name(F.col("raw_name")), "name", TOP)
    topics = usage.top_topics(inside, sessions, TOP).withColumnRenamed("topic", "name")
    parts = [total, providers, _listed(skills, "top_skills", ["name", "count"], by_count), _listed(topics, "top_topics", ["name", "count"], by_count)]
    return reduce(lambda a, b: a.join(b, "_one"), [p.withColumn("_one", F.lit(1)) for p in parts]).drop("_one")


def diff_by_provider(used: DataFrame, start: str, end: str, previous_start: str) -> DataFrame:
    """Sessions, cost and tokens of this window and the one before it, for providers active in either."""
    now = (F.col("ts") >= F.lit(start).cast("timestamp")).alias("now")
    both = usage.by_model(usage.in_window(used, previous_start, end), now, "provider", "session_id").withColumn("tokens", usage.total_tokens())
    sides = (("", F.col("now")), ("_before", ~F.col("now")))
    return both.groupBy("provider").agg(
        *[F.count_distinct(F.when(c, F.col("session_id"))).alias(f"sessions{s}") for s, c in sides],
        *[usd(F.coalesce(F.sum(F.when(c, F.col("nano"))), F.lit(0))).alias(f"cost_usd{s}") for s, c in sides],
        *[F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).alias(f"total_tokens{s}") for s, c in sides],
    ).orderBy(F.desc("cost_usd"), "provider")


def _measure(name: str, df: DataFrame, value: Column, label: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("measure"), (label if label is not None else F.lit(None)).cast("string").alias("label"), value.cast("double").alias("value"))


def reflection(used: DataFrame, sessions: DataFrame, entries: DataFrame, events: DataFrame, start: str, end: str, previous_start: str, zone: str = "UTC") -> DataFrame:
    """The measures of a period as rows (measure, label, value); one without data has no value or no row.

    Sessions count by their start, questions and skill events by their time.
    """
    inside = lambda df, ts: usage.in_window(df, start, end, ts)
    own, done = inside(sessions, "started_at"), inside(events, "ts")
    wins = behaviour.wins(done)
    parts = [
        _measure("compliance", behaviour.compliance(inside(entries, "ts")), F.col("ratio")),
        _measure("skill_diversity", behaviour.skill_diversity(done), F.col("diversity")),
        _measure("cost_trend", usage.cost_trend(used, start, end, previous_start), F.col("trend")),
        _measure("timing", behaviour.timing(own, 6, zone), F.col("session_count"), F.col("label")),
        _measure("project_focus", behaviour.project_focus(own), F.col("share"), F.col("project")),
        _measure("plan_then_ship", behaviour.plan_then_ship(done, []), F.col("ratio")),
        _measure("vibe_score", behaviour.vibe_score(own, done, []), F.col("score")),
        _measure("win", wins, F.lit(1.0), F.concat_ws(" ", "date", "skill")),
    ]
    return reduce(DataFrame.unionByName, parts)


QUESTION_LOG = "ts timestamp, skill string, question_id string, user_choice string, recommended string"
SKILL_EVENTS = "ts timestamp, skill string, event string, outcome string"


@dataclass(frozen=True)
class ReflectionSource:
    """Where answers and skill events of a reflection come from: two builders, either of which may be missing."""

    name: str
    questions: Callable[[SparkSession], DataFrame] | None = None
    skills: Callable[[SparkSession], DataFrame] | None = None

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Answers (QUESTION_LOG) and skill events (SKILL_EVENTS); empty where there is no builder."""
        pairs = ((self.questions, QUESTION_LOG), (self.skills, SKILL_EVENTS))
        return tuple(build(spark).select([c.split()[0] for c in schema.split(", ")]) if build else spark.createDataFrame([], schema) for build, schema in pairs)


def first_available(spark: SparkSession, sources: list[ReflectionSource]) -> ReflectionSource | None:
    """The first source that has any rows; one that cannot be read is passed over."""
    for source in sources:
        try:
            if any(not rows.isEmpty() for rows in source.read(spark)):
                return source
        except (PySparkException, OSError, ValueError) as error:
            warnings.warn(f"reflection source {source.name} is left out: {str(error).splitlines()[0]}", stacklevel=2)
    return None


def reflect(spark: SparkSession, sources: list[ReflectionSource], used: DataFrame, sessions: DataFrame, start: str, end: str, previous_start: str, zone: str = "UTC") -> DataFrame:
    """``reflection`` over the first source that is available; without one the measures of usage and sessions remain."""
    questions, events = (first_available(spark, sources) or ReflectionSource("none")).read(spark)
    return reflection(used, sessions, questions, events, start, end, previous_start, zone)


def habits(sessions: DataFrame, events: DataFrame, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """The habits of a period as rows (measure, label, value)."""
    own, done = usage.in_window(sessions, start, end, "started_at"), usage.in_window(events, start, end)
    days, modes, top = behaviour.weekdays(own, zone), behaviour.bimodal(own), behaviour.top_skill(done)
    parts = [
        _measure("weekday_sessions", days, F.col("session_count"), F.col("weekday")),
        _measure("weekday_vibe", days, F.col("vibe_rate"), F.col("weekday")),
        _measure("timeslot", behaviour.timing(own, 2, zone), F.col("session_count"), F.col("label")),
        _measure("short_sessions", modes, F.col("short_share")),
        _measure("long_session_events", modes, F.col("long_avg_events")),
        _measure("project_switch", behaviour.project_switch(own, zone), F.col("median_projects")),
        _measure("ship_cadence", behaviour.ship_cadence(done, []), F.col("median_days")),
        _measure("late_night_ship", behaviour.late_night_ships(own, done, [], zone), F.col("rate")),
        _measure("overplanning", behaviour.overplanning(done, []), F.col("rate")),
        _measure("top_skill", top, F.col("share"), F.col("skill")),
    ]
    return reduce(DataFrame.unionByName, parts)


def watch_status(hits: DataFrame, day: str, zone: str = "UTC") -> DataFrame:
    """One row over accepted hits: total_catches, catches_today (a local day), tracked_files."""
    own = F.to_date(F.convert_timezone(None, F.lit(zone), F.col("seen_at").cast("timestamp_ntz"))) == F.lit(day).cast("date")
    return hits.agg(F.count("*").alias("total_catches"), F.count_if(own).alias("catches_today"), F.count_distinct("file").alias("tracked_files"))


def watch_totals(counters: DataFrame, day: str, zone: str = "UTC") -> DataFrame:
    """One row over the counters of all batches: total_catches, catches_today (a local day), dropped, new_findings, reopened, expired."""
    own = F.to_date(F.convert_timezone(None, F.lit(zone), F.col("seen_at").cast("timestamp_ntz"))) == F.lit(day).cast("date")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counters.agg(
        total("catches").alias("total_catches"), total(F.when(own, F.col("catches"))).alias("catches_today"),
        *[total(c).alias(c) for c in ("dropped", "new_findings", "reopened", "expired")])
