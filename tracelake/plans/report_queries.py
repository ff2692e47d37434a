"""Queries of whole reports, windows and exports, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracelake.functions import dims, text, windows
from tracelake.operators import findings, history, report
from tracelake.operators import usage as u
from tracelake.plans import views as v
from tracelake.plans.catalogue import BEFORE, END, PRICED_SQL, START, STAMP, USD, WINDOW, query
from tracelake.sinks import json as sink

_joined = lambda part, fields: F.array_join(F.transform(part, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in fields])), ",").alias(part)


@query("activity_report", PRICED_SQL, v.INVOCATIONS_SQL, v.SESSIONS_SQL, f"""v_inside AS (SELECT * FROM v_cost WHERE {WINDOW}),
v_by AS (SELECT provider, count(DISTINCT session_id) AS s, sum(nano) AS c, CAST(sum(tokens) AS BIGINT) AS t FROM v_inside GROUP BY 1),
v_skills AS (SELECT skill_name AS name, count(*) AS n FROM v_invocations WHERE {WINDOW} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
v_topics AS (SELECT coalesce(title, regexp_extract(cwd, '([^/]+)/*$', 1)) AS name, count(*) AS n FROM v_sessions WHERE (provider, session_id) IN (SELECT (provider, session_id) FROM v_inside) GROUP BY 1 HAVING name IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5)""",
       f"""SELECT (SELECT count(DISTINCT (provider, session_id)) FROM v_inside) AS session_count, (SELECT {USD.format('sum(nano)')} FROM v_inside) AS cost_usd, (SELECT CAST(sum(tokens) AS BIGINT) FROM v_inside) AS total_tokens,
  (SELECT string_agg(provider || ':' || s || ':' || t, ',' ORDER BY c DESC, provider) FROM v_by) AS by_provider, (SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM v_skills) AS top_skills,
  (SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM v_topics) AS top_topics""")
def activity_report(spark, d):
    row = report.activity_report(v.usage(spark, d), v.sessions(spark, d), v.invocations(spark, d), START, END)
    return row.select("session_count", "cost_usd", "total_tokens", _joined("by_provider", ("provider", "sessions", "total_tokens")), _joined("top_skills", ("name", "count")), _joined("top_topics", ("name", "count")))


@query("activity_diff_by_provider", PRICED_SQL, f"""SELECT provider, count(DISTINCT session_id) FILTER (WHERE now) AS sessions, count(DISTINCT session_id) FILTER (WHERE NOT now) AS sessions_before,
  {USD.format('coalesce(sum(nano) FILTER (WHERE now), 0)')} AS cost_usd, {USD.format('coalesce(sum(nano) FILTER (WHERE NOT now), 0)')} AS cost_usd_before,
  CAST(coalesce(sum(tokens) FILTER (WHERE now), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(tokens) FILTER (WHERE NOT now), 0) AS BIGINT) AS total_tokens_before
FROM (SELECT *, ts >= TIMESTAMP '{START}' AS now FROM v_cost WHERE ts >= TIMESTAMP '{BEFORE}' AND ts < TIMESTAMP '{END}') GROUP BY 1""")
def activity_diff_by_provider(spark, d):
    return report.diff_by_provider(v.usage(spark, d), START, END, BEFORE)


@query("activity_windows", PRICED_SQL, """v_now AS (SELECT max(ts) AS now FROM v_usage),
v_windows AS (
  SELECT 'today' AS name, date_trunc('day', now) AS a, now AS b FROM v_now UNION ALL SELECT 'weekly', now - INTERVAL 7 DAY, now FROM v_now UNION ALL SELECT 'monthly', date_trunc('month', now), now FROM v_now
  UNION ALL SELECT 'previous_week', now - INTERVAL 14 DAY, now - INTERVAL 7 DAY FROM v_now UNION ALL SELECT 'custom', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12' UNION ALL SELECT 'since', now - INTERVAL 3 DAY, now FROM v_now)""",
       f"SELECT name AS window_name, count(DISTINCT (provider, session_id)) AS session_count, {USD.format('coalesce(sum(nano), 0)')} AS cost_usd, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens FROM v_windows JOIN v_cost ON ts >= a AND ts < b GROUP BY 1")
def activity_windows(spark, d):
    """Today, the last week, this month, the week before, two given days and the last three days, seen from the latest event."""
    used = v.usage(spark, d)
    now = dt.datetime.fromisoformat(used.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]).replace(tzinfo=dt.UTC)
    named = {
        "today": windows.today(now), "weekly": windows.weekly(now), "monthly": windows.monthly(now), "previous_week": windows.previous(windows.weekly(now)),
        "custom": windows.custom(dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12), now), "since": (windows.since("3d", 7, now), now),
    }
    found = None
    for name, (start, end) in named.items():
        one = u.activity(u.in_window(used, windows.stamp(start), windows.stamp(end))).select(F.lit(name).alias("window_name"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query("cost_dearest", PRICED_SQL, f"SELECT coalesce(model, '(unknown model)') AS label, provider, {USD.format('sum(nano)')} AS cost_usd, row_number() OVER (ORDER BY sum(nano) DESC, 1, 2) AS place FROM v_cost GROUP BY 1, 2 ORDER BY 4 LIMIT 10")
def cost_dearest(spark, d):
    """The ten dearest rows of the report by model, in its order."""
    from pyspark.sql import Window

    rows = u.dearest_first(u.cost(v.usage(spark, d), "model")).limit(10)
    return rows.select("label", "provider", "cost_usd", F.row_number().over(Window.orderBy(F.desc("cost_usd"), "label", "provider")).cast("long").alias("place"))


@query("scan_category_order", v.SEEDED_SQL, "SELECT category, hits, row_number() OVER (ORDER BY confidence DESC, category) AS place FROM (SELECT category, CASE WHEN category = 'high_entropy' THEN 6 ELSE max(confidence) END AS confidence, count(*) AS hits FROM v_scan GROUP BY 1)")
def scan_category_order(spark, d):
    """Hits by category in the order of danger, numbered."""
    rows = findings.scan(v.seeded_lines(spark, d), 4).groupBy("category").agg(F.count("*").alias("hits"))
    places = [(r["category"], r["hits"], i) for i, r in enumerate(findings.by_danger(rows).collect(), 1)]  # a row a detector
    return spark.createDataFrame(places, "category string, hits long, place long")


@query("scan_contexts", v.SEEDED_SQL, "SELECT file, line_no, category, value AS match_full, substr(line, greatest(place - 200, 1), least(place - 1, 200)) AS context_before, substr(line, place + length(value), 200) AS context_after FROM (SELECT *, unnest(list_filter(range(1, length(line) + 1), lambda i: substr(line, CAST(i AS INT), length(value)) = value)) AS place FROM v_scan JOIN v_seeded USING (file, line_no) WHERE confidence >= 7)")
def scan_contexts(spark, d):
    """Matches with the text around them, each where it stands."""
    return findings.scan_contexts(v.seeded_lines(spark, d), 7).select("file", "line_no", "category", "match_full", "context_before", "context_after")


@query("findings_export", v.LOG_SQL, """SELECT '{"fingerprint":"' || fingerprint || '","category":null,"snippet_redacted":null,"first_seen":"' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","last_seen":"' || strftime(last_seen, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","count":' || count || ',"status":"' || status || '","muted_until":'
  || coalesce('"' || strftime(muted_until, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"', 'null') || ',"notes":null}' AS json FROM v_findings""")
def findings_export(spark, d):
    return sink.export_findings(findings.fold(v.finding_log(spark, d)))


@query("watch_status", "SELECT count(*) AS total_catches, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS catches_today, count(DISTINCT user_id) AS tracked_files FROM v_events")
def watch_status(spark, d):
    return report.watch_status(v._events(spark, d).select(F.col("ts").alias("seen_at"), F.col("user_id").alias("file")), "2024-01-15")


HABIT_SQL = f"""v_s AS (SELECT * FROM v_sessions WHERE started_at >= TIMESTAMP '{START}' AND started_at < TIMESTAMP '{END}'), v_e AS (SELECT * FROM v_skill_events WHERE {WINDOW}),
v_sh AS (SELECT * FROM v_e WHERE event = 'completed' AND skill = 'ship')"""
_rate = "CASE WHEN count(*) >= 3 THEN avg(CAST(CAST({0} AS INT) AS DOUBLE)) END"
TIMED = "SELECT '{0}' AS measure, h.h || '-' || (h.h + {1}) AS label, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT unnest(range(0, 24, {1})) AS h) h LEFT JOIN (SELECT hour(started_at) // {1} * {1} AS h, count(*) AS n FROM v_s GROUP BY 1) x ON h.h = x.h"
FOCUS = "SELECT '{0}', {1}, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) FROM (SELECT {1}, count(*) AS n, sum(count(*)) OVER () AS total FROM {2} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"


@query("habits", v.SESSIONS_SQL, v.SKILL_EVENTS_SQL, HABIT_SQL, f"""{TIMED.format('timeslot', 2)}
UNION ALL SELECT 'weekday_sessions', CAST(w.w AS VARCHAR), CAST(coalesce(n, 0) AS DOUBLE) FROM (SELECT unnest(range(7)) AS w) w LEFT JOIN (SELECT isodow(started_at) - 1 AS w, count(*) AS n FROM v_s GROUP BY 1) x ON w.w = x.w
UNION ALL SELECT 'weekday_vibe', CAST(w.w AS VARCHAR), coalesce(n, CAST(0 AS DOUBLE)) FROM (SELECT unnest(range(7)) AS w) w LEFT JOIN (SELECT isodow(started_at) - 1 AS w, avg(CAST(CAST(event_count < 5 AS INT) AS DOUBLE)) AS n FROM v_s GROUP BY 1) x ON w.w = x.w
UNION ALL SELECT 'short_sessions', NULL, avg(CAST(CAST(event_count < 5 AS INT) AS DOUBLE)) FROM v_s
UNION ALL SELECT 'long_session_events', NULL, avg(event_count) FILTER (WHERE event_count >= 5) FROM v_s
UNION ALL SELECT 'project_switch', NULL, median(CAST(n AS DOUBLE)) FROM (SELECT CAST(started_at AS DATE) AS day, count(DISTINCT regexp_extract(cwd, '([^/]+)/*$', 1)) AS n FROM v_s WHERE cwd IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'ship_cadence', NULL, median(gap) FROM (SELECT min(CAST(epoch_us(a.ts) - epoch_us(b.ts) AS DOUBLE)) / CAST(86400000000 AS DOUBLE) AS gap FROM v_sh b LEFT JOIN v_sh a ON a.ts > b.ts GROUP BY b.user_id, b.ts)
UNION ALL SELECT 'late_night_ship', NULL, {_rate.format('ok')} FROM (SELECT EXISTS (SELECT 1 FROM v_sh a WHERE a.ts >= b.started_at AND a.ts <= b.started_at + INTERVAL 1 DAY) AS ok FROM v_s b WHERE hour(b.started_at) >= 22)
UNION ALL SELECT 'overplanning', NULL, {_rate.format('NOT ok')} FROM (SELECT EXISTS (SELECT 1 FROM v_sh a WHERE a.ts >= b.ts AND a.ts <= b.ts + INTERVAL 7 DAY) AS ok FROM v_e b WHERE event IN ('completed', 'started') AND contains(skill, 'office-hours'))
UNION ALL {FOCUS.format('top_skill', 'skill', "(SELECT * FROM v_e WHERE event IN ('completed', 'started'))")}""")
def habits(spark, d):
    return report.habits(v.sessions(spark, d), v.skill_events(spark, d), START, END)


@query("reflection", v.USAGE_SQL, *PRICED_SQL.split(f"{v.USAGE_SQL},\n", 1)[1:], v.SESSIONS_SQL, v.SKILL_EVENTS_SQL, v.QUESTIONS_SQL, HABIT_SQL, f"""{TIMED.format('timing', 6)}
UNION ALL SELECT 'compliance', NULL, avg(CAST(CAST(chosen_option = recommended_option AS INT) AS DOUBLE)) FROM v_questions JOIN v_events USING (event_id) WHERE {WINDOW} AND chosen_option IS NOT NULL AND recommended_option IS NOT NULL
UNION ALL SELECT 'skill_diversity', NULL, CAST(count(DISTINCT skill) AS DOUBLE) / CAST(count(*) AS DOUBLE) FROM v_e WHERE event IN ('completed', 'started')
UNION ALL SELECT 'cost_trend', NULL, CAST(CAST(sum(nano) FILTER (WHERE ts >= TIMESTAMP '{START}') - sum(nano) FILTER (WHERE ts < TIMESTAMP '{START}') AS BIGINT) AS DOUBLE) / CAST(CAST(sum(nano) FILTER (WHERE ts < TIMESTAMP '{START}') AS BIGINT) AS DOUBLE) FROM v_cost WHERE ts >= TIMESTAMP '{BEFORE}' AND ts < TIMESTAMP '{END}'
UNION ALL {FOCUS.format('project_focus', 'project', "(SELECT regexp_extract(cwd, '([^/]+)/*$', 1) AS project FROM v_s WHERE cwd IS NOT NULL)")}
UNION ALL SELECT 'plan_then_ship', NULL, avg(CAST(CAST(ok AS INT) AS DOUBLE)) FROM (SELECT EXISTS (SELECT 1 FROM v_e a WHERE a.event = 'completed' AND contains(a.skill, 'plan-eng-review') AND a.ts <= b.ts AND a.ts >= b.ts - INTERVAL 7 DAY) AS ok FROM v_sh b)
UNION ALL SELECT 'vibe_score', NULL, avg(CASE WHEN n < 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FROM (SELECT b.user_id, b.ts, arg_max(a.event_count, (a.started_at, a.session_id)) AS n FROM v_sh b LEFT JOIN v_s a ON a.started_at <= b.ts GROUP BY b.user_id, b.ts)
UNION ALL SELECT 'win', d || ' ' || skill, CAST(1 AS DOUBLE) FROM (SELECT DISTINCT skill, strftime(ts, '%Y-%m-%d') AS d FROM v_e WHERE event = 'completed' AND outcome = 'clean' ORDER BY d DESC, skill LIMIT 3)""")
def reflection(spark, d):
    from tracelake.operators import history

    q = history.question_options(v.questions(spark, d)).join(v._events(spark, d).select("event_id", "ts"), "event_id")
    entries = q.select("ts", F.col("chosen_option").alias("user_choice"), F.col("recommended_option").alias("recommended"))
    return report.reflection(v.usage(spark, d), v.sessions(spark, d), entries, v.skill_events(spark, d), START, END, BEFORE)


@query("top_skills_first_met", v.INVOCATIONS_SQL, "SELECT skill_name AS skill, count(*) AS count FROM v_invocations WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(ts), 1 LIMIT 5")
def top_skills_first_met(spark, d):
    return report.first_met_top(v.invocations(spark, d), text.normalize_skill_name(F.col("raw_name")), F.col("ts"), "skill")


@query("display_texts", """v_ages AS (SELECT o_orderkey, o_orderkey * 37 AS s FROM orders)""", """SELECT o_orderkey, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age,
  (s // 3600) || 'h' || (s % 3600 // 60) || 'm' AS left_over, left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS short_id, left(md5(CAST(o_orderkey AS VARCHAR)), 11) || '…' AS shown FROM v_ages""")
def display_texts(spark, d):
    rows = v.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 37).alias("s"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    return rows.select("o_orderkey", text.relative_time(F.col("s")).alias("age"), text.countdown(F.col("s")).alias("left_over"), text.short_id(F.col("h")).alias("short_id"), text.truncate(F.col("h"), 12).alias("shown"))


@query("repository_slugs", """SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN 'own' || (c_custkey % 9) || '-repo' || c_custkey END AS slug FROM customer""")
def repository_slugs(spark, d):
    n, tail = F.col("c_custkey"), F.concat(F.lit("own"), F.col("c_custkey") % 9, F.lit("/repo"), F.col("c_custkey"))
    url = F.when(n % 4 == 0, F.concat(F.lit("https://host.example/"), tail, F.lit(".git"))).when(n % 4 == 1, F.concat(F.lit("git@host.example:"), tail)).when(n % 4 == 2, F.concat(F.lit("ssh://git@host.example/"), tail, F.lit(".git"))).otherwise(F.concat(F.lit("https://host.example/"), n))
    return v.table(spark, d, "customer").select("c_custkey", text.repository_slug(url).alias("slug"))


@query("json_texts", """SELECT c_custkey, c_name || chr(10) || '"' || c_custkey || '"' || chr(9) || 'é/' || '\\' AS plain FROM customer""")
def json_texts(spark, d):
    escaped = F.concat("c_name", F.lit('\\n\\"'), "c_custkey", F.lit('\\"\\t\\u00e9\\/\\'))
    return v.table(spark, d, "customer").select("c_custkey", text.json_unescape(escaped).alias("plain"))


@query("sessions_newest", v.SESSIONS_SQL, f"""SELECT provider, session_id, CASE WHEN user_id % 13 > 0 THEN strftime(started_at, {STAMP}) END AS started_at FROM v_sessions ORDER BY CASE WHEN user_id % 13 > 0 THEN v_sessions.started_at END DESC NULLS FIRST, provider, session_id LIMIT 40""")
def sessions_newest(spark, d):
    """A page of a listing: sessions without a time lead."""
    rows = v.sessions(spark, d).withColumn("started_at", F.when(F.col("user_id") % 13 > 0, F.col("started_at")))
    return history.newest_first(rows, "started_at", 40, True, "provider", "session_id").select("provider", "session_id", v.stamp("started_at").alias("started_at"))


@query("sessions_newest_timed", v.SESSIONS_SQL, f"""SELECT provider, session_id, strftime(started_at, {STAMP}) AS started_at FROM v_sessions WHERE user_id % 13 > 0 ORDER BY v_sessions.started_at DESC, provider, session_id LIMIT 40""")
def sessions_newest_timed(spark, d):
    rows = v.sessions(spark, d).withColumn("started_at", F.when(F.col("user_id") % 13 > 0, F.col("started_at")))
    return history.newest_first(rows, "started_at", 40, False, "provider", "session_id").select("provider", "session_id", v.stamp("started_at").alias("started_at"))


@query("first_source", "SELECT user_id, CASE WHEN a > 0 THEN 'first' ELSE 'second' END AS origin, CASE WHEN a > 0 THEN a ELSE b END AS n FROM (SELECT user_id, count(*) FILTER (WHERE k % 40 = 0) AS a, count(*) FILTER (WHERE k % 3 = 1) AS b FROM v_events GROUP BY 1) WHERE a > 0 OR b > 0")
def first_source(spark, d):
    """Rows of the first source that has an id; the second one serves the rest."""
    e = v._events(spark, d)
    made = [e.where(c).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("origin", F.lit(name)) for c, name in (("k % 40 = 0", "first"), ("k % 3 = 1", "second"))]
    return history.first_per_id(made, "user_id").select("user_id", "origin", "n")


@query("picked_titles", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'a b' END, CASE WHEN event_id % 5 = 0 THEN 'c' END, event_type) AS title FROM v_events")
def picked_titles(spark, d):
    n = F.col("event_id")
    first, second = F.when(n % 3 == 0, F.lit(" a\n b ")).otherwise(" "), F.when(n % 5 == 0, F.lit("c"))
    return v._events(spark, d).select("event_id", history.pick_title(first, second, F.col("event_type")).alias("title"))


_books = ", ".join(f"('{c}', '{s}', '{a}')" for c, (s, a) in dims.PLAYBOOKS.items())
_LEVEL = "CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' WHEN 'low' THEN 'info' ELSE 'warning' END"


@query("alert_payloads", v.SEEDED_SQL, f"v_books(category, severity, advice) AS (VALUES {_books})", f"""v_alerts AS (
  SELECT DISTINCT s.category, left(sha1(s.category || ':' || snippet_redacted), 16) AS fingerprint, snippet_redacted AS snip, coalesce(severity, '{dims.PLAYBOOK_FALLBACK[0]}') AS severity, coalesce(advice, '{dims.PLAYBOOK_FALLBACK[1]}') AS advice
  FROM v_scan s LEFT JOIN v_books b ON s.category = b.category WHERE confidence >= 7)""", f"""SELECT fingerprint,
  '{{"event":"new_finding","fingerprint":"' || fingerprint || '","category":"' || category || '","snippet_redacted":"' || snip || '","first_seen":"2024-01-02T03:04:05.000Z","count":1,"rotation":{{"severity":"' || severity || '","advice":"' || advice || '"}}}}' AS plain,
  '{{"event_action":"trigger","dedup_key":"' || fingerprint || '","payload":{{"summary":"' || category || ' leaked","severity":"' || {_LEVEL} || '","custom_details":{{"snippet_redacted":"' || snip || '","advice":"' || advice || '","count":1}}}}}}' AS incident FROM v_alerts""")
def alert_payloads(spark, d):
    hits = findings.scan(v.seeded_lines(spark, d), 7).select("category", "fingerprint", "snippet_redacted").distinct()
    rows = findings.with_playbook(hits).withColumns({"kind": F.lit("new_finding"), "count": F.lit(1), "first_seen": F.lit("2024-01-02 03:04:05").cast("timestamp")})
    return rows.select("fingerprint", findings.payload().alias("plain"), findings.payload("incident").alias("incident"))


@query("real_titles", """v_said AS (SELECT *, CASE c_custkey % 7 WHEN 0 THEN '<command-name>x' WHEN 1 THEN '<local-command-stdout>' WHEN 2 THEN ' <system-reminder> ' || c_name WHEN 3 THEN 'Caveat: ' || c_name WHEN 4 THEN '[Request interrupted by user]'
  WHEN 5 THEN '  ' ELSE ' My ' || chr(10) || ' ' || c_name END AS said FROM customer)""", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN 'My ' || c_name END AS title FROM v_said")
def real_titles(spark, d):
    """Prompts that a tool has put in, and blank ones, are no titles."""
    n, name = F.col("c_custkey"), F.col("c_name")
    forms = [F.lit("<command-name>x"), F.lit("<local-command-stdout>"), F.concat(F.lit(" <system-reminder> "), name), F.concat(F.lit("Caveat: "), name), F.lit("[Request interrupted by user]"), F.lit("  "), F.concat(F.lit(" My \n "), name)]
    said = F.element_at(F.array(*forms), (n % 7 + 1).cast("int"))
    return v.table(spark, d, "customer").select("c_custkey", text.real_title(said).alias("title"))
