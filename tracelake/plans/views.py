"""Canonical entities over the driver tables, as DataFrames and as the same views in SQL.

The driver has no assistant histories, so usage, sessions, skill events and the like are
derived from ``events``, ``conversations``, ``documents``, ``orders`` and ``customer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.secrets import pinned
from tracelake.functions.storage import dealt

PROVIDERS = ("claude", "codex", "opencode", "cursor")
SKILLS = {"purchase": ("ship", "completed"), "signup": ("office-hours", "started"), "view": ("plan-eng-review", "completed"), "click": ("review", "completed"), "error": ("qa", "failed")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("user_id") % 4 + 1).cast("int"))
    cwd = F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("/w/u"), F.col("user_id") % 11, F.lit("/p"), F.col("user_id") % 5))
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), provider.alias("provider"),
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), cwd.alias("cwd"),
    )


EVENTS_SQL = """v_events AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE user_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' ELSE 'cursor' END AS provider,
         user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
         CASE WHEN event_id % 97 <> 0 THEN '/w/u' || (user_id % 11) || '/p' || (user_id % 5) END AS cwd
  FROM events)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    model = (
        F.when(n % 7 == 0, "gpt-5.5").when(kind == "click", "claude-opus-4-7").when(kind == "purchase", "claude-sonnet-4-5-20250929")
        .when(kind == "view", "gpt-5-codex-high").when(kind == "error", "mystery-1")
    )
    return _events(spark, sf_dir).select(
        "event_id", "ts", "provider", "session_id", "cwd", model.alias("model"), F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), F.col("k").alias("output_tokens"),
        (n % 50).alias("cache_creation_input_tokens"), (n % 400).alias("cache_read_input_tokens"), F.when(n % 3 == 0, F.col("k")).otherwise(F.lit(0)).alias("reasoning_output_tokens"),
    )


USAGE_SQL = """v_usage AS (
  SELECT event_id, ts, provider, session_id, cwd,
         CASE WHEN event_id % 7 = 0 THEN 'gpt-5.5' WHEN event_type = 'click' THEN 'claude-opus-4-7' WHEN event_type = 'purchase' THEN 'claude-sonnet-4-5-20250929'
              WHEN event_type = 'view' THEN 'gpt-5-codex-high' WHEN event_type = 'error' THEN 'mystery-1' END AS model,
         CAST(floor(value * 10) AS BIGINT) AS input_tokens, k AS output_tokens, event_id % 50 AS cache_creation_input_tokens, event_id % 400 AS cache_read_input_tokens,
         CASE WHEN event_id % 3 = 0 THEN k ELSE 0 END AS reasoning_output_tokens
  FROM v_events)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, day) sessions; the title is missing for every third user."""
    rows = _events(spark, sf_dir).groupBy("user_id", "provider", "session_id").agg(F.min("ts").alias("started_at"), F.count("*").alias("event_count"), F.max("cwd").alias("cwd"))
    title = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit(" Task  no "), F.col("user_id") % 23, F.lit("\n")))
    return rows.withColumn("title", title)


SESSIONS_SQL = """v_sessions AS (
  SELECT user_id, provider, session_id, min(ts) AS started_at, count(*) AS event_count, max(cwd) AS cwd,
         CASE WHEN user_id % 3 <> 0 THEN 'Task no ' || (user_id % 23) END AS title
  FROM v_events GROUP BY user_id, provider, session_id)"""


def skill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for kind, v in SKILLS.items() for x in (kind, v[i])]), F.col("event_type"))
    return _events(spark, sf_dir).select("user_id", "ts", pick(0).alias("skill"), pick(1).alias("event"), F.when(F.col("k") % 2 == 0, "clean").otherwise("dirty").alias("outcome"))


SKILL_EVENTS_SQL = """v_skill_events AS (
  SELECT user_id, ts,
         CASE event_type WHEN 'purchase' THEN 'ship' WHEN 'signup' THEN 'office-hours' WHEN 'view' THEN 'plan-eng-review' WHEN 'click' THEN 'review' WHEN 'error' THEN 'qa' END AS skill,
         CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed' ELSE 'completed' END AS event,
         CASE WHEN k % 2 = 0 THEN 'clean' ELSE 'dirty' END AS outcome
  FROM v_events)"""

RAW_SKILLS = ("/gstack-ship", "ship", " /model ", "gstack-review", "/qa", "plan-eng-review", "review")


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, RAW_SKILLS)), (F.col("event_id") % len(RAW_SKILLS) + 1).cast("int"))
    return _events(spark, sf_dir).select("provider", "cwd", "ts", raw.alias("raw_name"))


INVOCATIONS_SQL = f"""v_invocations AS (
  SELECT provider, cwd, ts, raw_name, regexp_replace(regexp_replace(trim(raw_name), '^/', ''), '^gstack-', '') AS skill_name
  FROM (SELECT *, ([{', '.join(repr(x) for x in RAW_SKILLS)}])[event_id % {len(RAW_SKILLS)} + 1] AS raw_name FROM v_events))"""


def question_labels() -> Column:
    """Three labels of an event, one of which may carry a recommendation mark."""
    k, n = F.col("k"), F.col("event_id")
    marks = F.array(*map(F.lit, [" (recommended)", " [Recommended].", " (推荐)", ""]))
    label = lambda i: F.concat(F.lit(f"Option {i} of "), k % 9)
    mark = F.element_at(marks, (n % 4 + 1).cast("int"))
    return F.array(label(1), F.concat(label(2), F.when(k % 2 == 0, mark).otherwise("")), F.concat(label(3), F.when(k % 2 == 1, mark).otherwise("")))


def question_choice() -> Column:
    """A choice that may be missing or manifold."""
    k, n = F.col("k"), F.col("event_id")
    label = lambda i: F.concat(F.lit(f"Option {i} of "), k % 9)
    return F.when(n % 11 == 0, F.lit(None)).when(n % 5 == 0, F.concat(label(1), F.lit(", "), label(3))).when(n % 3 == 0, label(2)).otherwise(label(3))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and choices of all events."""
    return _events(spark, sf_dir).select("event_id", question_labels().alias("raw_options"), question_choice().alias("chosen_option"))


QUESTIONS_SQL = """v_questions AS (
  SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN k % 2 = 0 THEN 'Option 2 of ' || (k % 9) ELSE 'Option 3 of ' || (k % 9) END AS recommended_option,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'Option 1 of ' || (k % 9) || ', Option 3 of ' || (k % 9)
              WHEN event_id % 3 = 0 THEN 'Option 2 of ' || (k % 9) ELSE 'Option 3 of ' || (k % 9) END AS chosen_option
  FROM v_events),
v_matched AS (
  SELECT *, CASE WHEN recommended_option IS NOT NULL AND coalesce(chosen_option, '') <> ''
                 THEN list_contains(list_transform(string_split(chosen_option, ','), lambda x: trim(x)), recommended_option) END AS matched
  FROM v_questions)"""


def seeded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with made-up secrets of every kind, and with what only looks like one."""
    key = F.col("o_orderkey").cast("string")
    h = F.md5(key.cast("binary"))
    n = F.col("o_orderkey") % 16
    b64 = F.base64(F.unhex(F.sha2(key.cast("binary"), 256)))
    forms = [
        F.concat(F.lit("use sk-proj-"), h, F.lit(" now")), F.concat(F.lit("key sk-ant-"), h), F.concat(F.lit("ghp_"), h), F.concat(F.lit("x github_pat_"), h, h), F.concat(F.lit("ghs_"), h, F.lit(".")),
        F.concat(F.lit("id AKIA"), F.upper(F.left(h, F.lit(16))), F.lit(" end")), F.concat(F.lit("xoxb-"), h), F.concat(F.lit("t eyJ"), h, F.lit("."), h, F.lit("."), h, F.lit(" ")), F.concat(F.lit("Authorization: Bearer "), h),
        F.concat(F.lit("to u"), key, F.lit("@corp.io and u"), key, F.lit("@corp.io")), F.concat(F.lit("to u"), key, F.lit("@api.example.com")), F.concat(F.lit("from noreply@corp"), key, F.lit(".io")),
        F.concat(F.lit("to u"), key, F.lit("@yourdomain.com")), F.concat(F.lit("x \\u"), key, F.lit("@corp.io")), F.concat(F.lit("blob "), b64), F.concat(F.lit("plain words "), h, F.lit(" here")),
    ]
    line = forms[-1]
    for i in reversed(range(len(forms) - 1)):
        line = F.when(n == i, forms[i]).otherwise(line)
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.concat(F.lit("f"), F.col("o_orderkey") % 7).alias("file"), F.col("o_orderkey").alias("line_no"))
    return pinned(rows.withColumn("o_orderkey", F.col("line_no")), line.alias("line")).drop("o_orderkey")


SEEDED_SQL = r"""v_seeded AS (
  SELECT 'f' || (o_orderkey % 7) AS file, o_orderkey AS line_no,
    CASE o_orderkey % 16 WHEN 0 THEN 'use sk-proj-' || h || ' now' WHEN 1 THEN 'key sk-ant-' || h WHEN 2 THEN 'ghp_' || h WHEN 3 THEN 'x github_pat_' || h || h WHEN 4 THEN 'ghs_' || h || '.'
      WHEN 5 THEN 'id AKIA' || upper(left(h, 16)) || ' end' WHEN 6 THEN 'xoxb-' || h WHEN 7 THEN 't eyJ' || h || '.' || h || '.' || h || ' ' WHEN 8 THEN 'Authorization: Bearer ' || h
      WHEN 9 THEN 'to u' || o_orderkey || '@corp.io and u' || o_orderkey || '@corp.io' WHEN 10 THEN 'to u' || o_orderkey || '@api.example.com' WHEN 11 THEN 'from noreply@corp' || o_orderkey || '.io'
      WHEN 12 THEN 'to u' || o_orderkey || '@yourdomain.com' WHEN 13 THEN 'x \u' || o_orderkey || '@corp.io' WHEN 14 THEN 'blob ' || base64(unhex(sha256(CAST(o_orderkey AS VARCHAR)))) ELSE 'plain words ' || h || ' here' END AS line
  FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)),
v_detectors(category, pattern, confidence, grp) AS (VALUES
  ('anthropic_key', 'sk-ant-[A-Za-z0-9_\-]{20,}', 10, 0), ('openai_key', 'sk-(?:proj-)?[A-Za-z0-9_\-]{20,}', 10, 0), ('github_pat', 'ghp_[A-Za-z0-9]{30,}', 10, 0),
  ('github_fine_grained_pat', 'github_pat_[A-Za-z0-9_]{40,}', 10, 0), ('github_app_token', 'ghs_[A-Za-z0-9]{30,}', 10, 0), ('aws_access_key', '\bAKIA[0-9A-Z]{16}\b', 9, 0),
  ('slack_token', 'xox[baprs]-[A-Za-z0-9-]{10,}', 9, 0), ('jwt', '\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b', 8, 0),
  ('bearer_token', '(?i)bearer\s+([A-Za-z0-9_\-\.]{20,})', 7, 1), ('email', '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', 7, 0)),
v_raw AS (
  SELECT file, line_no, category, confidence, unnest(CASE WHEN grp = 1 THEN regexp_extract_all(line, pattern, 1) ELSE regexp_extract_all(line, '\\?(?:' || pattern || ')') END) AS m
  FROM v_seeded, v_detectors
  WHERE contains(line, 'sk-') OR contains(line, '@') OR contains(line, 'ghp_') OR contains(line, 'AKIA') OR contains(line, 'eyJ') OR contains(line, 'ghs_') OR contains(line, 'github_pat_')
     OR contains(line, 'xox') OR contains(line, 'Bearer ') OR contains(line, 'bearer ')),
v_entropy AS (
  SELECT file, line_no, m, sum(-n / length(m) * log2(n / length(m))) AS bits FROM (
    SELECT file, line_no, m, c, count(*) AS n FROM (
      SELECT file, line_no, m, unnest(string_split(m, '')) AS c FROM (SELECT DISTINCT file, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9+/=_\-]{40,200}')) AS m FROM v_seeded))
    GROUP BY file, line_no, m, c) GROUP BY file, line_no, m),
v_hits AS (
  SELECT file, line_no, category, confidence, ltrim(m, '\') AS value, starts_with(m, '\') AS escaped FROM v_raw
  UNION ALL
  SELECT file, line_no, 'high_entropy', CASE WHEN bits >= 5.5 THEN 6 WHEN bits >= 5.0 THEN 5 ELSE 4 END, m, false FROM v_entropy
  WHERE bits >= 4.5 AND NOT regexp_matches(m, '^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$')),
v_judged AS (
  SELECT *, CASE WHEN escaped THEN 'escape_prefix' WHEN contains(value, '@') AND regexp_matches(lower(value), '@(.*\.)?example\.(com|org|net)$|\.(test|example|invalid|localhost)$') THEN 'reserved_email_domain'
                 WHEN regexp_matches(lower(value), '^(noreply|no-reply|do-not-reply|donotreply)@') THEN 'noreply_local_part'
                 WHEN regexp_matches(lower(value), '@(domain|email|yourdomain|yoursite|mysite)\.com$') THEN 'placeholder_email_domain' END AS suppressed_by
  FROM v_hits),
v_scan AS (
  SELECT DISTINCT file, line_no, category, confidence, value,
    CASE WHEN length(value) <= 8 THEN repeat('…', length(value)) ELSE left(value, least(4, length(value) // 4)) || '…REDACTED…' || right(value, least(4, length(value) // 4)) END AS snippet_redacted
  FROM v_judged WHERE suppressed_by IS NULL)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line"), "role", "text")


def finding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of observations and decisions on 40 fingerprints."""
    kind = F.when(F.col("event_id") % 13 == 0, "resolve").when(F.col("event_id") % 17 == 0, "ack").when(F.col("event_id") % 19 == 0, "mute").otherwise("obs")
    until = F.when(kind == "mute", F.col("ts") + F.expr("INTERVAL 24 HOURS"))
    return _events(spark, sf_dir).select(F.concat(F.lit("fp"), F.col("k") % 40).alias("fingerprint"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), until.alias("muted_until"))


LOG_SQL = """v_log AS (
  SELECT 'fp' || (k % 40) AS fingerprint, event_id AS seq, ts,
         CASE WHEN event_id % 13 = 0 THEN 'resolve' WHEN event_id % 17 = 0 THEN 'ack' WHEN event_id % 19 = 0 THEN 'mute' ELSE 'obs' END AS kind,
         CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 = 0 THEN ts + INTERVAL 24 HOUR END AS muted_until
  FROM v_events),
v_marked AS (SELECT *, kind = 'obs' AND lag(kind) OVER (PARTITION BY fingerprint ORDER BY seq) = 'resolve' AS reopened FROM v_log),
v_opened AS (
  SELECT fingerprint, coalesce(max(seq) FILTER (WHERE reopened), min(seq) FILTER (WHERE kind = 'obs')) AS opened, min(ts) FILTER (WHERE kind = 'obs') AS first_seen
  FROM v_marked GROUP BY fingerprint),
v_findings AS (
  SELECT l.fingerprint, min(o.first_seen) AS first_seen, max(ts) FILTER (WHERE kind = 'obs') AS last_seen, count(*) FILTER (WHERE kind = 'obs') AS count,
         CASE arg_max(kind, seq) FILTER (WHERE kind <> 'obs') WHEN 'ack' THEN 'ack' WHEN 'mute' THEN 'muted' WHEN 'resolve' THEN 'resolved' ELSE 'new' END AS status,
         CASE WHEN arg_max(kind, seq) FILTER (WHERE kind <> 'obs') = 'mute' THEN max(muted_until) FILTER (WHERE kind = 'mute') END AS muted_until
  FROM v_log l JOIN v_opened o ON l.fingerprint = o.fingerprint AND l.seq >= o.opened GROUP BY l.fingerprint)"""


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
