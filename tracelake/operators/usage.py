"""Cost roll-ups, activity reports, period differences and projections over token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import dims
from tracelake.functions.money import nano_cost, price_key, usd
from tracelake.functions.text import basename, normalize_title

TOKENS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "reasoning_output_tokens")


def total_tokens() -> Column:
    return sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))


def label(by: str) -> Column:
    """Group label of a usage row: project, model, month or provider."""
    if by == "project":
        return F.coalesce(basename(F.col("cwd")), F.lit("(unknown cwd)"))
    if by == "model":
        return F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("(unknown model)"))
    if by == "month":
        return F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("(unknown)"))
    if by == "provider":
        return F.col("provider")
    raise ValueError(f"cannot group by {by}")


def by_model(usage: DataFrame, *keys: str | Column) -> DataFrame:
    """Token sums, events and exact cost (``nano``) by keys and model: prices are looked up once a group, not once a row."""
    grouped = usage.groupBy(*keys, "model").agg(*[F.sum(c).alias(c) for c in TOKENS], F.count("*").alias("event_count"))
    return grouped.withColumn("nano", nano_cost(F.col("model")))


def cost(usage: DataFrame, by: str) -> DataFrame:
    """Token sums, cost, events and model display by (label, provider), from one row a model."""
    display = F.when(F.count("model") == 1, F.max("model")).when(F.count("model") > 1, F.concat(F.lit("mixed ("), F.count("model").cast("string"), F.lit(")")))
    models = by_model(usage, label(by).alias("label"), F.col("provider").alias("provider_name"))
    grouped = models.groupBy("label", "provider_name").agg(
        *[F.sum(c).alias(c) for c in TOKENS], usd(F.sum("nano")).alias("cost_usd"), F.sum("event_count").alias("event_count"), display.alias("model")
    )
    return grouped.withColumnRenamed("provider_name", "provider")


def dearest_first(costs: DataFrame) -> DataFrame:
    """Cost rows in the order of a report: cost descending, then label and provider."""
    return costs.orderBy(F.desc("cost_usd"), *[c for c in ("label", "provider") if c in costs.columns])


def cost_footer(usage: DataFrame) -> DataFrame:
    """Grand total with the part whose provider has verified prices."""
    sure = F.col("provider") == "claude"
    part = lambda c: usd(F.coalesce(F.sum(c), F.lit(0)))
    return by_model(usage, "provider").agg(
        part("nano").alias("total_usd"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"),
        part(F.when(sure, F.col("nano"))).alias("verified_usd"), part(F.when(~sure, F.col("nano"))).alias("estimated_usd"),
    )


def price_lookup(usage: DataFrame) -> DataFrame:
    """Distinct models with the priced id each resolves to."""
    key = price_key(F.col("model"))
    return usage.where(F.col("model").isNotNull()).select("model").distinct().select("model", key.alias("price_id"), F.coalesce(key.startswith("claude-"), F.lit(False)).alias("verified"))


def in_window(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows in [start, end); rows without a time go."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def by_session(usage: DataFrame) -> DataFrame:
    """(provider, session_id, nano, tokens) sums by session and model, the rows that reports are made of."""
    return by_model(usage, "provider", "session_id").select("provider", "session_id", "nano", total_tokens().alias("tokens"))


def activity(usage: DataFrame) -> DataFrame:
    """One row: distinct (provider, session), cost and tokens."""
    return by_session(usage).agg(
        F.count_distinct(F.struct("provider", "session_id")).alias("session_count"), usd(F.coalesce(F.sum("nano"), F.lit(0))).alias("cost_usd"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    )


def activity_by_provider(usage: DataFrame) -> DataFrame:
    return by_session(usage).groupBy("provider").agg(F.count_distinct("session_id").alias("sessions"), usd(F.sum("nano")).alias("cost_usd"), F.sum("tokens").alias("total_tokens"))


def top_counts(df: DataFrame, value: Column, name: str, k: int = 5) -> DataFrame:
    """The k most frequent values; equal counts in order of name."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("count")).orderBy(F.desc("count"), name).limit(k)


def top_topics(usage: DataFrame, sessions: DataFrame, k: int = 5) -> DataFrame:
    """Topics (title, else project) of the sessions with usage in the window."""
    keys = usage.select("provider", "session_id").distinct()
    topic = F.coalesce(F.nullif(normalize_title(F.col("title")), F.lit("")), basename(F.col("cwd")))
    return top_counts(sessions.join(keys, ["provider", "session_id"], "left_semi"), topic, "topic", k)


def activity_diff(usage: DataFrame, start: str, end: str, previous_start: str) -> DataFrame:
    """This window against the one before it, in a single pass of conditional aggregates."""
    now = (F.col("ts") >= F.lit(start).cast("timestamp")).alias("now")
    both = by_model(in_window(usage, previous_start, end), now, "provider", "session_id").withColumn("tokens", total_tokens())
    sides, key = (F.col("now"), ~F.col("now")), F.struct("provider", "session_id")
    both = both.agg(
        *[F.count_distinct(F.when(c, key)).alias(f"s{i}") for i, c in enumerate(sides)],
        *[F.coalesce(F.sum(F.when(c, F.col("nano"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(sides)],
        *[F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).alias(f"t{i}") for i, c in enumerate(sides)],
    )
    return both.select(
        ((F.col("s1") > 0) | (F.col("c1") > 0)).alias("has_prior"), usd(F.col("c0") - F.col("c1")).alias("cost_delta"),
        (F.col("s0") - F.col("s1")).alias("session_delta"), (F.col("t0") - F.col("t1")).alias("token_delta"),
    )


def cost_trend(usage: DataFrame, start: str, end: str, previous_start: str) -> DataFrame:
    """(this - previous) / previous cost; null without previous cost."""
    now = (F.col("ts") >= F.lit(start).cast("timestamp")).alias("now")
    both = by_model(in_window(usage, previous_start, end), now).agg(F.sum(F.when(F.col("now"), F.col("nano"))).alias("a"), F.sum(F.when(~F.col("now"), F.col("nano"))).alias("b"))
    return both.select(F.when(F.col("b") > 0, (F.coalesce("a", F.lit(0)) - F.col("b")).cast("double") / F.col("b").cast("double")).alias("trend"))


def projection(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Cost of the window carried to 30 days; not for windows under an hour."""
    hours = (F.unix_timestamp(F.lit(end)) - F.unix_timestamp(F.lit(start))).cast("double") / 3600.0
    cost_usd = usd(F.coalesce(F.sum("nano"), F.lit(0)))
    enough = hours >= 1.0
    return by_model(in_window(usage, start, end)).agg(
        F.first(enough).alias("enough_data"), F.when(F.first(enough), cost_usd / F.first(hours) * 24.0 * 30.0).otherwise(0.0).alias("monthly_usd"), F.first(hours).alias("hours_elapsed")
    )


def last_cumulative(rows: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """Usage of files whose counters are cumulative: the last row by position, fresh input only."""
    last = rows.groupBy(*by).agg(F.max_by(F.struct("input_total", "cached_total", "output_total"), line).alias("u"))
    return last.select(*by, F.greatest(F.col("u.input_total") - F.col("u.cached_total"), F.lit(0)).alias("input_tokens"), F.col("u.cached_total").alias("cache_read_input_tokens"), F.col("u.output_total").alias("output_tokens"))


def prices(spark) -> DataFrame:
    """The price dimension as a table of thousandths of a dollar."""
    return spark.createDataFrame(dims.milli_prices(), "model string, input long, output long, cache_write long, cache_read long")
