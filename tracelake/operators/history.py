"""Sessions, skills and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import is_recommended, is_suite_skill, matches_recommended, normalize_skill_name, normalize_title, real_title, recommended_label

PROVIDERS = ("claude", "codex")


def skill_stats(invocations: DataFrame) -> DataFrame:
    """Counts per skill by provider, distinct working folders, last use, and whether it came with the suite prefix."""
    rows = invocations.withColumn("skill_name", normalize_skill_name(F.col("raw_name"))).where(F.col("skill_name") != "")
    return rows.groupBy("skill_name").agg(
        *[F.count_if(F.col("provider") == p).alias(f"count_{p}") for p in PROVIDERS], F.count("*").alias("total"),
        F.count_distinct(F.nullif(F.col("cwd"), F.lit(""))).alias("unique_cwd_count"), F.max("ts").alias("last_used"), F.bool_or(is_suite_skill(F.col("raw_name"))).alias("is_gstack"),
    )


def newest_first(df: DataFrame, ts: str, limit: int | None = None, nulls_first: bool = True, *ties: str) -> DataFrame:
    """Newest rows first; rows without a time lead unless asked otherwise; a limit of 0 or less is none."""
    order = F.desc_nulls_first(ts) if nulls_first else F.desc_nulls_last(ts)
    ordered = df.orderBy(order, *ties)
    return ordered.limit(limit) if limit and limit > 0 else ordered


def session_titles(messages: DataFrame) -> DataFrame:
    """Per session: first tool title, else first real user text; lines counted."""
    user = F.when(F.col("role") == "user", real_title(F.col("text")))
    told = F.when(F.col("role") == "ai-title", F.nullif(normalize_title(F.col("text")), F.lit("")))
    return messages.groupBy("session_id").agg(
        F.coalesce(F.min_by(told, F.when(told.isNotNull(), F.col("line"))), F.min_by(user, F.when(user.isNotNull(), F.col("line")))).alias("title"), F.count("*").alias("event_count")
    )


def pick_title(*candidates: Column) -> Column:
    """First candidate that is not blank."""
    return F.coalesce(*[F.nullif(normalize_title(c), F.lit("")) for c in candidates])


def first_per_id(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has each id."""
    ranked = None
    for n, df in enumerate(sources):
        one = df.withColumn("_source", F.lit(n))
        ranked = one if ranked is None else ranked.unionByName(one)
    kept = ranked.groupBy(key).agg(F.min_by(F.struct(*[c for c in ranked.columns if c != key]), "_source").alias("r"))
    return kept.select(key, "r.*").drop("_source")


def question_options(questions: DataFrame) -> DataFrame:
    """Clean labels, the first recommended one, and whether the choice took it."""
    labels = F.transform("raw_options", lambda x: recommended_label(x))
    first = F.try_element_at(F.filter("raw_options", lambda x: is_recommended(x)), F.lit(1))
    rows = questions.withColumn("options", labels).withColumn("recommended_option", F.when(first.isNotNull(), recommended_label(first)))
    return rows.withColumn("matched", F.when(F.col("recommended_option").isNotNull() & (F.coalesce("chosen_option", F.lit("")) != ""), matches_recommended(F.col("chosen_option"), F.col("recommended_option"))))


def question_summary(questions: DataFrame) -> DataFrame:
    """Asked, unanswered, answered with a recommendation, and the share that followed it."""
    return questions.agg(
        F.count("*").alias("questions"), F.count_if(F.coalesce("chosen_option", F.lit("")) == "").alias("unanswered"),
        F.count("matched").alias("with_recommendation"), F.count_if(F.col("matched")).alias("followed"), F.avg(F.col("matched").cast("double")).alias("hit_rate"),
    )


def pair_answers(asks: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Asks with the last answer of the same id; asks without one stay."""
    last = answers.groupBy(*by).agg(F.max_by(F.struct("answer", F.col("line").alias("answer_line")), "line").alias("a")).select(*by, "a.*")
    return asks.join(last, by, "left")


def real_sessions(headers: DataFrame, bubbles: DataFrame, key: str) -> DataFrame:
    """Headers with at least one bubble, and how many."""
    counts = bubbles.groupBy(key).agg(F.count("*").alias("event_count"))
    return headers.join(counts, key)


def unmapped(sessions: DataFrame, workspaces: DataFrame, key: str) -> DataFrame:
    """Sessions whose workspace is unknown."""
    return sessions.join(workspaces.select(key).distinct(), key, "left_anti")
