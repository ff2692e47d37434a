"""Queries that write the assistants' stores and read them back, with SQL over the tables they were made of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.storage import mounted, new_folder
from tracelake.operators import findings, report
from tracelake.operators import usage as u
from tracelake.plans import fixtures as f
from tracelake.plans import views as v
from tracelake.plans.catalogue import BEFORE, END, PRICED_SQL, START, STAMP, USD, query
from tracelake.sinks import json as sink
from tracelake.sources import jsonl, providers, stores
from tracelake.streaming import watch

FOLDER = "'/w/u' || (user_id % 11) || '/p' || (user_id % 5)"
OF = """v_of AS (SELECT *, {folder} AS folder, user_id % 4 AS assistant, CAST(floor(value * 10) AS BIGINT) AS tenths,
  event_type IN ('click', 'signup') OR event_type = 'view' AND event_id % 11 <> 0 AS placed FROM v_events)""".replace("{folder}", FOLDER)
CLAUDE_SESSIONS = """v_claude_sessions AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, folder AS cwd, arg_min(ts, event_id) FILTER (WHERE placed) AS started_at, CAST(1 + count(*) + count(*) FILTER (WHERE event_type = 'view' AND placed) AS BIGINT) AS event_count,
         arg_min('Task no ' || k, event_id) FILTER (WHERE event_type = 'click') AS title
  FROM v_of WHERE assistant = 0 GROUP BY user_id, folder HAVING bool_or(placed))"""
CLAUDE_USAGE = """v_claude_usage AS (
  SELECT CAST(o.user_id AS VARCHAR) AS session_id, CASE WHEN p.user_id IS NOT NULL THEN folder END AS cwd, ts, 'claude-sonnet-4-5' AS model, tenths AS input_tokens, k AS output_tokens,
         event_id % 50 AS cache_creation_input_tokens, event_id % 400 AS cache_read_input_tokens, 0 AS reasoning_output_tokens
  FROM v_of o LEFT JOIN (SELECT DISTINCT user_id FROM v_of WHERE placed) p ON o.user_id = p.user_id WHERE assistant = 0 AND event_type = 'purchase')"""
CODEX_SESSIONS = """v_codex_sessions AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, folder AS cwd, min(ts) AS started_at, CAST(1 + count(*) AS BIGINT) AS event_count, arg_min('Fix it ' || k, event_id) FILTER (WHERE event_type = 'click') AS title
  FROM v_of WHERE assistant = 1 GROUP BY user_id, folder)"""
CODEX_USAGE = """v_codex_usage AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, folder AS cwd, arg_max(ts, event_id) FILTER (WHERE c) AS ts, CASE WHEN bool_or(event_type = 'view') THEN 'gpt-5-codex' END AS model, CAST(sum(tenths) FILTER (WHERE c) AS BIGINT) AS input_tokens,
         CAST(sum(k) FILTER (WHERE c) AS BIGINT) AS output_tokens, 0 AS cache_creation_input_tokens, 5 * count(*) FILTER (WHERE c) AS cache_read_input_tokens, CAST(sum(event_id % 3) FILTER (WHERE c) AS BIGINT) AS reasoning_output_tokens
  FROM (SELECT *, event_type IN ('purchase', 'signup', 'error') AS c FROM v_of WHERE assistant = 1) GROUP BY user_id, folder HAVING bool_or(c))"""
USERS = """v_users AS (
  SELECT user_id, folder, assistant, make_timestamp(min(epoch_us(ts) // 1000) * 1000) AS begun, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, CAST(sum(tenths) AS BIGINT) AS sum_value FROM v_of GROUP BY ALL)"""
OPENCODE_SESSIONS = """v_opencode_sessions AS (SELECT 'o' || user_id AS session_id, folder AS cwd, begun AS started_at, CAST(NULL AS BIGINT) AS event_count, 'A title' AS title FROM v_users WHERE assistant = 2)"""
OPENCODE_USAGE = """v_opencode_usage AS (
  SELECT 'o' || user_id AS session_id, folder AS cwd, begun AS ts, CASE user_id % 3 WHEN 0 THEN 'gpt-5 (p)' WHEN 1 THEN 'o3' END AS model, sum_value AS input_tokens, sum_k AS output_tokens, 2 AS cache_creation_input_tokens,
         n AS cache_read_input_tokens, 1 AS reasoning_output_tokens FROM v_users WHERE assistant = 2 AND user_id % 10 <> 0)"""
CURSOR_SESSIONS = """v_cursor_sessions AS (
  SELECT 'c' || user_id AS session_id, CASE WHEN user_id % 5 <> 0 THEN folder END AS cwd, begun AS started_at, n % 5 + 1 AS event_count, 'Chat ' || user_id AS title FROM v_users WHERE assistant = 3 AND user_id % 10 <> 0)"""
CURSOR_USAGE = """v_cursor_usage AS (
  SELECT 'c' || user_id AS session_id, CASE WHEN user_id % 5 <> 0 THEN folder END AS cwd, begun AS ts, CAST(NULL AS VARCHAR) AS model, sum_k AS input_tokens, 0 AS output_tokens, 0 AS cache_creation_input_tokens, 0 AS cache_read_input_tokens,
         0 AS reasoning_output_tokens FROM v_users WHERE assistant = 3 AND user_id % 10 <> 0 AND user_id % 3 = 0 AND sum_k > 0)"""
SESSION_COLUMNS = f"session_id, cwd, strftime(started_at, {STAMP}) AS started_at, event_count, title"
USAGE_COLUMNS = f"session_id, cwd, strftime(ts, {STAMP}) AS ts, model, " + ", ".join(f"CAST({t} AS BIGINT) AS {t}" for t in u.TOKENS)
EVERY_SESSION = "v_every AS (" + " UNION ALL ".join(f"SELECT '{p}' AS provider, session_id, cwd, started_at, event_count, title FROM v_{p}_sessions" for p in v.PROVIDERS) + ")"
EVERY_USAGE = "v_usage AS (" + " UNION ALL ".join(f"SELECT '{p}' AS provider, ts, cwd, session_id, model, {', '.join(u.TOKENS)} FROM v_{p}_usage" for p in v.PROVIDERS) + ")"
ALL_SESSIONS = (OF, USERS, CLAUDE_SESSIONS, CODEX_SESSIONS, OPENCODE_SESSIONS, CURSOR_SESSIONS, EVERY_SESSION)


def _sessions(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "session_id", "cwd", v.stamp("started_at").alias("started_at"), "event_count", "title")


def _usage(df: DataFrame) -> DataFrame:
    return df.select("session_id", "cwd", v.stamp("ts").alias("ts"), "model", *u.TOKENS)


@query("read_claude_sessions", OF, CLAUDE_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_claude_sessions")
def read_claude_sessions(spark, d):
    return _sessions(jsonl.claude_sessions(jsonl.read_lines(spark, f.claude(spark, d))))


@query("read_claude_usage", OF, CLAUDE_USAGE, f"SELECT {USAGE_COLUMNS} FROM v_claude_usage")
def read_claude_usage(spark, d):
    return _usage(jsonl.claude_usage(jsonl.read_lines(spark, f.claude(spark, d))))


@query("read_claude_skills", OF, f"SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN k % 2 = 0 THEN 'ship' ELSE 'review' END AS skill_name, folder AS cwd, strftime(ts, {STAMP}) AS ts, k % 2 = 0 AS is_gstack FROM v_of WHERE assistant = 0 AND event_type = 'signup'")
def read_claude_skills(spark, d):
    rows = jsonl.claude_skills(jsonl.read_lines(spark, f.claude(spark, d)))
    return rows.select(F.regexp_extract("source_path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "skill_name", "cwd", v.stamp("ts").alias("ts"), "is_gstack")


@query("read_claude_questions", OF, v.QUESTIONS_SQL, f"""SELECT 'Which of ' || k || '?' AS question, recommended_option, chosen_option, strftime(ts, {STAMP}) AS ts, folder AS cwd, CAST(user_id AS VARCHAR) AS session_id, 't' || event_id AS tool_use_id
FROM v_of JOIN v_questions USING (event_id) WHERE assistant = 0 AND event_type = 'view' AND user_id IN (SELECT user_id FROM v_of WHERE placed)""")
def read_claude_questions(spark, d):
    rows = jsonl.claude_questions(jsonl.read_lines(spark, f.claude(spark, d)))
    return rows.select("question", "recommended_option", "chosen_option", v.stamp("ts").alias("ts"), "cwd", "session_id", "tool_use_id")


@query("read_claude_folder", OF, CLAUDE_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_claude_sessions WHERE cwd = '/w/u4/p4'")
def read_claude_folder(spark, d):
    """Only the directories whose names begin like the folder's are listed; the folder itself decides."""
    return _sessions(providers.union(spark, [providers.claude(f.claude(spark, d))], "sessions", cwd="/w/u4/p4"))


@query("read_codex_sessions", OF, CODEX_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_codex_sessions")
def read_codex_sessions(spark, d):
    return _sessions(jsonl.codex_sessions(jsonl.read_lines(spark, f.codex(spark, d), pattern="rollout-*.jsonl")))


@query("read_codex_usage", OF, CODEX_USAGE, f"SELECT {USAGE_COLUMNS} FROM v_codex_usage")
def read_codex_usage(spark, d):
    return _usage(jsonl.codex_usage(jsonl.read_lines(spark, f.codex(spark, d))))


@query("read_codex_threads", OF, USERS, f"""SELECT CAST(user_id AS VARCHAR) AS session_id, folder AS cwd, CASE WHEN user_id % 7 <> 0 THEN strftime(begun, {STAMP}) END AS started_at, CAST(NULL AS BIGINT) AS event_count,
  CASE WHEN user_id % 3 = 0 THEN 'T ' || user_id WHEN user_id % 2 = 0 THEN 'seen' WHEN user_id % 5 = 0 THEN '[$gstack-qa](x) go' ELSE 'hello' END AS title FROM v_users WHERE assistant = 1""")
def read_codex_threads(spark, d):
    return _sessions(stores.codex_threads(spark, f.threads(spark, d)))


@query("read_codex_thread_skills", OF, USERS, f"SELECT 'qa' AS skill_name, folder AS cwd, CASE WHEN user_id % 7 <> 0 THEN strftime(begun, {STAMP}) END AS ts, true AS is_gstack FROM v_users WHERE assistant = 1 AND user_id % 5 = 0")
def read_codex_thread_skills(spark, d):
    return stores.codex_thread_skills(spark, f.threads(spark, d)).select("skill_name", "cwd", v.stamp("ts").alias("ts"), "is_gstack")


@query("read_codex_fallback", OF, CODEX_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_codex_sessions")
def read_codex_fallback(spark, d):
    """The thread store is not there, so the rollouts are read."""
    return _sessions(providers.union(spark, [providers.codex([f.codex(spark, d)], threads=mounted(new_folder(spark, "none")))], "sessions"))


@query("read_opencode_sessions", OF, USERS, OPENCODE_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_opencode_sessions")
def read_opencode_sessions(spark, d):
    return _sessions(stores.opencode_sessions(spark, f.opencode(spark, d)))


@query("read_opencode_usage", OF, USERS, OPENCODE_USAGE, f"SELECT {USAGE_COLUMNS} FROM v_opencode_usage")
def read_opencode_usage(spark, d):
    return _usage(stores.opencode_usage(spark, f.opencode(spark, d)))


@query("read_cursor_sessions", OF, USERS, CURSOR_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_cursor_sessions")
def read_cursor_sessions(spark, d):
    return _sessions(stores.cursor_sessions(spark, *f.cursor(spark, d))[0])


@query("read_cursor_unmapped", OF, USERS, CURSOR_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_cursor_sessions WHERE cwd IS NULL")
def read_cursor_unmapped(spark, d):
    return _sessions(stores.cursor_sessions(spark, *f.cursor(spark, d))[1])


@query("read_cursor_usage", OF, USERS, CURSOR_USAGE, f"SELECT {USAGE_COLUMNS} FROM v_cursor_usage")
def read_cursor_usage(spark, d):
    return _usage(stores.cursor_usage(spark, *f.cursor(spark, d)))


@query("read_installed_skills", """SELECT CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 's' || n_nationkey END AS name, CASE WHEN n_nationkey % 3 <> 0 THEN CASE WHEN n_nationkey % 5 = 0 THEN 'One' || chr(10) || 'two' ELSE 'One two' END END AS description,
  'user' AS source, CASE WHEN n_nationkey % 3 <> 0 THEN '1.' || n_nationkey END AS version FROM nation""")
def read_installed_skills(spark, d):
    return stores.by_source(stores.installed_skills(spark, {"user": f.skill_files(spark, d)})).select("name", "description", "source", "version")


@query("read_skill_roots", """SELECT CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 's' || n_nationkey END AS name, CASE n_nationkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'plugin' ELSE 'system' END AS source,
  CASE WHEN n_nationkey % 4 = 1 THEN 'plug' || (n_nationkey % 3) END AS plugin, row_number() OVER (ORDER BY 2, lower(name)) AS place FROM nation""".replace("ORDER BY 2, lower(name)", "ORDER BY CASE n_nationkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'plugin' ELSE 'system' END, lower(CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 's' || n_nationkey END)"))
def read_skill_roots(spark, d):
    """Skills of a user's, the plugins' and the system's folders as one listing, in its order."""
    root = f.skill_files(spark, d, rooted=True)
    rows = stores.by_source(stores.installed_skills(spark, {"user": f"{root}/user", "plugin": f"{root}/plugins", "system": f"{root}/system"}))
    places = [(r["name"], r["source"], r["plugin"], i) for i, r in enumerate(rows.collect(), 1)]  # a row a nation
    return spark.createDataFrame(places, "name string, source string, plugin string, place long")


@query("read_claude_flat", OF, CLAUDE_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_claude_sessions WHERE cwd = '/w/u4/p4'")
def read_claude_flat(spark, d):
    """Only the files right in a directory."""
    root = f.claude(spark, d)
    above = jsonl.read_lines(spark, root, recursive=False)  # the root itself holds directories only
    return _sessions(jsonl.claude_sessions(jsonl.read_lines(spark, f"{root}/-w-u4-p4", recursive=False).unionByName(above)))


@query("read_codex_roots", OF, CODEX_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_codex_sessions")
def read_codex_roots(spark, d):
    """Rollouts under two roots, live and archived."""
    root = f.codex(spark, d)
    return _sessions(providers.union(spark, [providers.codex([f"{root}/sessions", f"{root}/archived_sessions"])], "sessions"))


@query("read_codex_broken_store", OF, CODEX_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_codex_sessions")
def read_codex_broken_store(spark, d):
    """One of the thread stores is broken, which shows half-way: all sessions come from the rollouts, none from both."""
    path = f.threads(spark, d)
    with open(f"{path}/broken.db", "wb") as store:
        store.write(b"SQLite format 3\0" + bytes(2000))
    return _sessions(providers.union(spark, [providers.codex([f.codex(spark, d)], threads=path)], "sessions"))


@query("read_cursor_locked_store", OF, USERS, CURSOR_SESSIONS, f"SELECT {SESSION_COLUMNS} FROM v_cursor_sessions")
def read_cursor_locked_store(spark, d):
    """A store that another program has locked is skipped; the others are read."""
    import sqlite3

    path, spaces = f.cursor(spark, d)
    lock = sqlite3.connect(f"{path}/locked.db", isolation_level=None)
    lock.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
    lock.execute("BEGIN EXCLUSIVE")
    try:
        rows = _sessions(stores.cursor_sessions(spark, path, spaces)[0])
        kept = new_folder(spark, "unlocked")
        rows.write.parquet(kept)
    finally:
        lock.close()
    return spark.read.schema(rows.schema).parquet(kept)


@query("provider_skills", OF, USERS, f"""SELECT 'claude' AS provider, CASE WHEN k % 2 = 0 THEN 'ship' ELSE 'review' END AS skill_name, folder AS cwd, strftime(ts, {STAMP}) AS ts, k % 2 = 0 AS is_gstack FROM v_of WHERE assistant = 0 AND event_type = 'signup'
UNION ALL SELECT 'codex', 'qa', folder, CASE WHEN user_id % 7 <> 0 THEN strftime(begun, {STAMP}) END, true FROM v_users WHERE assistant = 1 AND user_id % 5 = 0""")
def provider_skills(spark, d):
    """Skills of all assistants that keep them, through the union."""
    every = [providers.claude(f.claude(spark, d)), providers.codex([f.codex(spark, d)], threads=f.threads(spark, d)), providers.opencode(f.opencode(spark, d))]
    return providers.union(spark, every, "skills").select("provider", "skill_name", "cwd", v.stamp("ts").alias("ts"), "is_gstack")


@query("provider_questions", OF, v.QUESTIONS_SQL, f"""SELECT 'claude' AS provider, 'Which of ' || k || '?' AS question, recommended_option, chosen_option, CAST(user_id AS VARCHAR) AS session_id
FROM v_of JOIN v_questions USING (event_id) WHERE assistant = 0 AND event_type = 'view' AND user_id IN (SELECT user_id FROM v_of WHERE placed)""")
def provider_questions(spark, d):
    rows = providers.union(spark, [providers.claude(f.claude(spark, d)), providers.codex([f.codex(spark, d)])], "questions")
    return rows.select("provider", "question", "recommended_option", "chosen_option", "session_id")


@query("provider_installed", """v_names AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 's' || n_nationkey END AS name FROM nation)""",
       "SELECT 'claude' AS provider, CASE k % 4 WHEN 0 THEN 'user' ELSE 'plugin' END AS source, name FROM v_names WHERE k % 4 < 2 UNION ALL SELECT 'codex', 'system', name FROM v_names WHERE k % 4 >= 2")
def provider_installed(spark, d):
    root = f.skill_files(spark, d, rooted=True)
    every = [providers.claude(f"{root}/none", {"user": f"{root}/user", "plugin": f"{root}/plugins"}), providers.codex([], skill_roots={"system": f"{root}/system"})]
    return providers.union(spark, every, "installed").select("provider", "source", "name")


@query("sessions_json", OF, CLAUDE_SESSIONS, """SELECT '{"provider":"claude","session_id":"' || session_id || '","cwd":"' || cwd || '","started_at":' || coalesce('"' || strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"', 'null')
  || ',"event_count":' || event_count || ',"title":' || coalesce('"' || title || '"', 'null') || '}' AS json FROM v_claude_sessions""")
def sessions_json(spark, d):
    """Sessions as lines of JSON with their fixed fields but the path, which differs from run to run."""
    rows = jsonl.claude_sessions(jsonl.read_lines(spark, f.claude(spark, d)))
    return sink.objects(rows, tuple(c for c in sink.FIELDS["sessions"] if c != "source_path"))


@query("scan_roots", v.SEEDED_SQL, "SELECT category, count(*) AS hits FROM v_scan WHERE confidence >= 7 GROUP BY 1")
def scan_roots(spark, d):
    """A scan of transcripts under roots of which one is missing."""
    lines = jsonl.scan_lines(spark, _transcripts(spark, d), mounted(new_folder(spark, "missing")))
    return findings.scan(lines, 7).groupBy("category").agg(F.count("*").alias("hits"))


LOGGED = """v_logged AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts END AS at_time, CASE WHEN event_id % 5 = 2 THEN date_trunc('day', ts) END AS at_day, 's' || (k % 7) AS skill, event_type AS event,
  CASE WHEN k % 3 > 0 THEN 'clean' END AS outcome, CASE WHEN k % 2 = 0 THEN 'yes' END AS user_choice, CASE WHEN k % 4 = 0 THEN 'yes' ELSE 'no' END AS recommended FROM v_events WHERE event_id % 11 <> 10)"""


@query("read_timeline", LOGGED, f"SELECT strftime(at_time, {STAMP}) AS ts, skill, event, outcome FROM v_logged WHERE at_time IS NOT NULL")
def read_timeline(spark, d):
    return jsonl.timeline(jsonl.read_lines(spark, f.logs(spark, d))).withColumn("ts", v.stamp("ts"))


@query("read_question_log", LOGGED, f"SELECT strftime(coalesce(at_time, at_day), {STAMP}) AS ts, skill, 'q' || event_id AS question_id, user_choice, recommended FROM v_logged WHERE at_time IS NOT NULL OR at_day IS NOT NULL")
def read_question_log(spark, d):
    return jsonl.question_log(jsonl.read_lines(spark, f.logs(spark, d))).withColumn("ts", v.stamp("ts"))


@query("reflection_from_logs", LOGGED, """SELECT 'compliance' AS measure, NULL AS label, avg(CAST(CAST(user_choice = recommended AS INT) AS DOUBLE)) AS value FROM v_logged
  WHERE coalesce(at_time, at_day) >= TIMESTAMP '{start}' AND coalesce(at_time, at_day) < TIMESTAMP '{end}' AND user_choice IS NOT NULL AND recommended IS NOT NULL""".replace("{start}", START).replace("{end}", END))
def reflection_from_logs(spark, d):
    """Of several sources the first one with rows serves: logs under a folder, behind a source that has none."""
    root = f.logs(spark, d)
    logs = report.ReflectionSource("logs", lambda s: jsonl.question_log(jsonl.read_lines(s, root)), lambda s: jsonl.timeline(jsonl.read_lines(s, root)))
    gone = report.ReflectionSource("gone", lambda s: jsonl.question_log(jsonl.read_lines(s, f"{root}-gone")))
    rows = report.reflect(spark, [report.ReflectionSource("none"), gone, logs], v.usage(spark, d), v.sessions(spark, d), START, END, BEFORE)
    return rows.where("measure = 'compliance'")


@query("provider_sessions", *ALL_SESSIONS, f"SELECT provider, {SESSION_COLUMNS} FROM v_every")
def provider_sessions(spark, d):
    """All assistants in one listing; one whose store is missing is left out."""
    return _sessions(providers.union(spark, f.registry(spark, d), "sessions"), "provider")


@query("provider_sessions_of_folder", *ALL_SESSIONS, f"SELECT provider, {SESSION_COLUMNS} FROM v_every WHERE cwd = '/w/u3/p3' AND provider IN ('codex', 'cursor')")
def provider_sessions_of_folder(spark, d):
    return _sessions(providers.union(spark, f.registry(spark, d), "sessions", ["CODEX", "Cursor"], "/w/u3//p3/"), "provider")


@query("provider_cost", OF, USERS, CLAUDE_USAGE, CODEX_USAGE, OPENCODE_USAGE, CURSOR_USAGE, EVERY_USAGE, "v_prices" + PRICED_SQL.split(",\nv_prices", 1)[1],
       f"SELECT provider, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in u.TOKENS)}, {USD.format('sum(nano)')} AS cost_usd, count(*) AS event_count FROM v_cost GROUP BY 1")
def provider_cost(spark, d):
    rows = u.dearest_first(u.cost(providers.union(spark, f.registry(spark, d), "usage"), "provider"))
    return rows.select("provider", *u.TOKENS, "cost_usd", "event_count")


def _transcripts(spark, d) -> str:
    """The seeded lines as growing files."""
    root = new_folder(spark, "watched")
    f.write_files(v.seeded_lines(spark, d).select(F.concat("file", F.lit(".jsonl")).alias("path"), F.col("line_no").alias("n"), "line"), root)
    return mounted(root)


@query("watch_tail", v.SEEDED_SQL, "SELECT file, category, count(*) AS hits FROM v_scan WHERE confidence >= 7 GROUP BY 1, 2")
def watch_tail(spark, d):
    """A stream that follows files, with detection, drained into a table."""
    out = new_folder(spark, "tailed")
    rows = watch.detect(watch.follow(spark, _transcripts(spark, d), f"{mounted(out)}/plans"))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    name = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return spark.read.schema(watch.HIT).parquet(f"{out}/rows").groupBy(name.alias("file"), "category").agg(F.count("*").alias("hits"))


@query("watch_findings", v.SEEDED_SQL, "SELECT DISTINCT left(sha1(category || ':' || snippet_redacted), 16) AS fingerprint, category, snippet_redacted, 'new' AS status, CAST(1 AS BIGINT) AS count FROM v_scan WHERE confidence >= 7")
def watch_findings(spark, d):
    """The whole watch job over one batch: repeats within the time to live count once."""
    hooks = spark.createDataFrame([("h", True, ["new_finding"], ["jwt"])], "hook_id string, enabled boolean, kinds array<string>, categories array<string>")
    out = new_folder(spark, "watch")
    watch.watch(spark, _transcripts(spark, d), f"{out}/tables", f"{out}/log", hooks, lambda hook, body, key: 200, waits=(0,)).awaitTermination()
    return watch.findings_of(spark, f"{out}/tables").read().select("fingerprint", "category", "snippet_redacted", "status", "count")


SCANNED = "v_found AS (SELECT left(sha1(category || ':' || snippet_redacted), 16) AS fingerprint, category, count(*) AS n FROM v_scan WHERE confidence >= 7 GROUP BY 1, 2)"


def _watched_twice(spark, d) -> str:
    """Tables of a watch over three runs: lines, then decisions by the fingerprint's first digit, then the same lines in new files."""
    out = new_folder(spark, "watched_twice")
    root, hooks = mounted(f"{out}/lines"), spark.createDataFrame([("h", True, ["reopened"], [])], "hook_id string, enabled boolean, kinds array<string>, categories array<string>")
    lines = v.seeded_lines(spark, d)
    spark.createDataFrame([], watch.DECISION).write.parquet(f"{out}/said")
    said = spark.readStream.schema(watch.DECISION).parquet(f"{out}/said")

    def run(n: int) -> None:
        f.write_files(lines.select(F.concat(F.lit(f"{n}/"), "file", F.lit(".jsonl")).alias("path"), F.col("line_no").alias("n"), "line"), f"{out}/lines")

    def drain() -> None:
        watch.watch(spark, root, f"{out}/tables", f"{out}/log", hooks, lambda hook, body, key: 404, said, ttl=dt.timedelta(0)).awaitTermination()

    run(1)
    drain()
    digit = F.left("fingerprint", F.lit(1))
    kind = F.when(digit < "4", "resolve").when(digit < "8", "mute").when(digit < "c", "ack").otherwise("note")
    found = watch.findings_of(spark, f"{out}/tables").read()
    found.select("fingerprint", kind.alias("kind"), F.current_timestamp().alias("seen_at"), F.lit(None).cast("timestamp").alias("muted_until"), F.lit("looked at").alias("note")).write.mode("append").parquet(f"{out}/said")
    drain()
    run(2)
    drain()
    return f"{out}/tables"


@query("watch_transitions", v.SEEDED_SQL, SCANNED, """SELECT fingerprint, category, CASE WHEN left(fingerprint, 1) < '4' THEN 'new' WHEN left(fingerprint, 1) < '8' THEN 'muted' WHEN left(fingerprint, 1) < 'c' THEN 'ack' ELSE 'new' END AS status,
  CAST(CASE WHEN left(fingerprint, 1) < '4' THEN 1 ELSE 2 END AS BIGINT) AS count, CASE WHEN left(fingerprint, 1) >= 'c' THEN 'looked at' END AS note, CASE WHEN left(fingerprint, 1) < '4' THEN 'dead' END AS delivery FROM v_found""")
def watch_transitions(spark, d):
    """Resolved findings open anew and are told to a hook that refuses; muted and acknowledged ones count on; a note stays."""
    tables = _watched_twice(spark, d)
    told = watch.queue_of(spark, tables).read().select("fingerprint", F.col("status").alias("delivery"))
    return watch.findings_of(spark, tables).read().join(told, "fingerprint", "left").select("fingerprint", "category", "status", "count", "note", "delivery")


@query("watch_totals", v.SEEDED_SQL, SCANNED, "SELECT CAST(2 * count(*) AS BIGINT) AS total_catches, CAST(2 * sum(n - 1) AS BIGINT) AS dropped, count(*) AS new_findings, count(*) FILTER (WHERE left(fingerprint, 1) < '4') AS reopened, CAST(0 AS BIGINT) AS expired FROM v_found")
def watch_totals(spark, d):
    """Counters that the stream has kept over its batches, drops included."""
    rows = spark.read.schema(watch.COUNTER).parquet(f"{_watched_twice(spark, d)}/counters/batch=*")
    return report.watch_totals(rows, "2024-01-01").drop("catches_today")


@query("watch_sweep", v.SEEDED_SQL, "SELECT file, line_no, left(sha1(category || ':' || snippet_redacted), 16) AS fingerprint FROM v_scan WHERE confidence >= 7 AND left(sha1(category || ':' || snippet_redacted), 1) >= '8'")
def watch_sweep(spark, d):
    """What a full scan finds beyond the findings that a watch knows."""
    lines = v.seeded_lines(spark, d)
    known = findings.scan(lines, 7).where(F.left("fingerprint", F.lit(1)) < "8")
    rows = watch.sweep(lines.withColumn("byte_offset", F.col("line_no").cast("long")), known)
    return rows.select("file", F.col("byte_offset").alias("line_no"), "fingerprint")


@query("requeue_dead", """SELECT 'h' || (o_orderkey % 3) AS hook_id, CAST(o_orderkey AS VARCHAR) AS fingerprint, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 1 + CAST(o_orderkey % 3 = 1 AS INT) END AS attempts FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 5 = 0""")
def requeue_dead(spark, d):
    """Dead letters sent once more: hook h0 takes them now, h1 still refuses, h2 is not asked; bodies that are no JSON stay."""
    n, none = F.col("o_orderkey"), F.lit(None)
    dead = v.table(spark, d, "orders").select(
        F.concat(F.lit("h"), n % 3).alias("hook_id"), n.cast("string").alias("fingerprint"), F.when(n % 5 == 0, "no json").otherwise("{}").alias("body"), F.lit(1).alias("attempts"),
        none.cast("string").alias("last_error"), none.cast("timestamp").alias("attempted_at"))
    send = lambda hook, body, key: 200 if hook == "h0" else 404
    first, second = (watch.requeue(dead.where(F.col("hook_id") == h), send, h) for h in ("h0", "h1"))
    return first.unionByName(second).unionByName(dead.where("hook_id = 'h2'")).select("hook_id", "fingerprint", "attempts")
