"""Registered queries of the analytics operators, each with its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import automaton, dims, secrets, text
from tracelake.operators import behaviour, findings, graph, history, ordered
from tracelake.operators import usage as u
from tracelake.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

START, END, BEFORE = "2024-01-15 00:00:00", "2024-01-22 00:00:00", "2024-01-08 00:00:00"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
_rates = ", ".join(f"('{m}', {', '.join(map(str, r))})" for m, *r in dims.milli_prices())
PRICED_SQL = f"""{v.USAGE_SQL},
v_prices(p, input, output, cache_write, cache_read) AS (VALUES {_rates}),
v_models AS (SELECT model, arg_max(p, length(p)) AS p FROM (SELECT DISTINCT model FROM v_usage WHERE model IS NOT NULL) JOIN v_prices ON model = p OR starts_with(model, p || '-') GROUP BY model),
v_cost AS (
  SELECT u.*, m.p AS price_id, input_tokens + output_tokens + cache_creation_input_tokens + cache_read_input_tokens + reasoning_output_tokens AS tokens,
         coalesce(input_tokens * input + (output_tokens + reasoning_output_tokens) * output + cache_creation_input_tokens * cache_write + cache_read_input_tokens * cache_read, 0) AS nano
  FROM v_usage u LEFT JOIN v_models m USING (model) LEFT JOIN v_prices x ON m.p = x.p)"""


def _with(*parts: str) -> str:
    return f"WITH RECURSIVE {', '.join((v.EVENTS_SQL, *parts[:-1]))}\n{parts[-1]}"


def query(name: str, *sql: str, events: bool = True):
    """Register a query; the last SQL part is its body, the others its views."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = _with(*sql)
        return f

    return register


USD = "CAST(CAST({0} AS BIGINT) AS DOUBLE) / 1e9"


def _cost(by: str, label: str) -> None:
    body = f"""SELECT {label} AS label, provider, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in u.TOKENS)}, {USD.format('sum(nano)')} AS cost_usd, count(*) AS event_count,
       CASE WHEN count(DISTINCT model) = 1 THEN max(model) WHEN count(DISTINCT model) > 1 THEN 'mixed (' || count(DISTINCT model) || ')' END AS model
FROM v_cost GROUP BY 1, 2"""
    query(f"cost_by_{by}", PRICED_SQL, body)(lambda spark, d: u.cost(v.usage(spark, d), by))


_cost("project", "coalesce(regexp_extract(cwd, '([^/]+)/*$', 1), '(unknown cwd)')")
_cost("model", "coalesce(model, '(unknown model)')")
_cost("month", "strftime(ts, '%Y-%m')")
_cost("provider", "provider")


@query("cost_footer", PRICED_SQL, f"""SELECT {USD.format('sum(nano)')} AS total_usd, count(*) AS events, {USD.format("coalesce(sum(nano) FILTER (WHERE provider = 'claude'), 0)")} AS verified_usd,
  {USD.format("coalesce(sum(nano) FILTER (WHERE provider <> 'claude'), 0)")} AS estimated_usd FROM v_cost""")
def cost_footer(spark, d):
    return u.cost_footer(v.usage(spark, d))


@query("price_lookup", PRICED_SQL, "SELECT DISTINCT model, price_id, coalesce(starts_with(price_id, 'claude-'), false) AS verified FROM v_cost WHERE model IS NOT NULL")
def price_lookup(spark, d):
    return u.price_lookup(v.usage(spark, d))


WINDOW = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"


@query("activity_summary", PRICED_SQL, f"SELECT count(DISTINCT (provider, session_id)) AS session_count, {USD.format('sum(nano)')} AS cost_usd, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM v_cost WHERE {WINDOW}")
def activity_summary(spark, d):
    return u.activity(u.in_window(v.usage(spark, d), START, END))


@query("activity_by_provider", PRICED_SQL, f"SELECT provider, count(DISTINCT session_id) AS sessions, {USD.format('sum(nano)')} AS cost_usd, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM v_cost WHERE {WINDOW} GROUP BY 1")
def activity_by_provider(spark, d):
    return u.activity_by_provider(u.in_window(v.usage(spark, d), START, END))


@query("activity_top_skills", v.INVOCATIONS_SQL, f"SELECT skill_name AS skill, count(*) AS count FROM v_invocations WHERE {WINDOW} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def activity_top_skills(spark, d):
    rows = u.in_window(v.invocations(spark, d), START, END)
    return u.top_counts(rows, text.normalize_skill_name(F.col("raw_name")), "skill")


@query("activity_top_topics", PRICED_SQL, v.SESSIONS_SQL, f"""SELECT topic, count(*) AS count FROM (
  SELECT coalesce(title, regexp_extract(cwd, '([^/]+)/*$', 1)) AS topic FROM v_sessions s WHERE EXISTS (SELECT 1 FROM v_usage x WHERE x.provider = s.provider AND x.session_id = s.session_id AND {WINDOW}))
WHERE topic IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def activity_top_topics(spark, d):
    return u.top_topics(u.in_window(v.usage(spark, d), START, END), v.sessions(spark, d))


PERIODS = f"""v_periods AS (
  SELECT ts >= TIMESTAMP '{START}' AS cur, count(DISTINCT (provider, session_id)) AS s, CAST(sum(nano) AS BIGINT) AS c, CAST(sum(tokens) AS BIGINT) AS t
  FROM v_cost WHERE ts >= TIMESTAMP '{BEFORE}' AND ts < TIMESTAMP '{END}' GROUP BY 1),
v_two AS (SELECT max(s) FILTER (WHERE cur) AS s0, max(s) FILTER (WHERE NOT cur) AS s1, max(c) FILTER (WHERE cur) AS c0, max(c) FILTER (WHERE NOT cur) AS c1, max(t) FILTER (WHERE cur) AS t0, max(t) FILTER (WHERE NOT cur) AS t1 FROM v_periods)"""


@query("activity_diff", PRICED_SQL, PERIODS, "SELECT s1 > 0 OR c1 > 0 AS has_prior, CAST(c0 - c1 AS DOUBLE) / 1e9 AS cost_delta, s0 - s1 AS session_delta, t0 - t1 AS token_delta FROM v_two")
def activity_diff(spark, d):
    return u.activity_diff(v.usage(spark, d), START, END, BEFORE)


@query("cost_trend", PRICED_SQL, PERIODS, "SELECT CAST(c0 - c1 AS DOUBLE) / CAST(c1 AS DOUBLE) AS trend FROM v_two")
def cost_trend(spark, d):
    return u.cost_trend(v.usage(spark, d), START, END, BEFORE)


@query("activity_projection", PRICED_SQL, f"SELECT true AS enough_data, {USD.format('sum(nano)')} / CAST(168 AS DOUBLE) * CAST(24 AS DOUBLE) * CAST(30 AS DOUBLE) AS monthly_usd, CAST(168 AS DOUBLE) AS hours_elapsed FROM v_cost WHERE {WINDOW}")
def activity_projection(spark, d):
    return u.projection(v.usage(spark, d), START, END)


def _stats(filtered: str) -> str:
    return f"""SELECT skill_name, {', '.join(f"count(*) FILTER (WHERE provider = '{p}') AS count_{p}" for p in history.PROVIDERS)}, count(*) AS total, count(DISTINCT cwd) AS unique_cwd_count,
  strftime(max(ts), {STAMP}) AS last_used, bool_or(regexp_matches(trim(raw_name), '^/?gstack-')) AS is_gstack FROM v_invocations {filtered} GROUP BY 1"""


@query("skill_stats", v.INVOCATIONS_SQL, _stats(""))
def skill_stats(spark, d):
    return history.skill_stats(v.invocations(spark, d)).withColumn("last_used", v.stamp("last_used"))


@query("skill_stats_by_provider", v.INVOCATIONS_SQL, _stats("WHERE provider = 'codex'"))
def skill_stats_by_provider(spark, d):
    return history.skill_stats(v.invocations(spark, d).where("provider = 'codex'")).withColumn("last_used", v.stamp("last_used"))


@query("session_list", v.SESSIONS_SQL, f"SELECT provider, session_id, cwd, strftime(started_at, {STAMP}) AS started_at, event_count, title FROM v_sessions")
def session_list(spark, d):
    rows = history.newest_first(v.sessions(spark, d), "started_at", None, True, "provider", "session_id")
    return rows.select("provider", "session_id", "cwd", v.stamp("started_at").alias("started_at"), "event_count", text.normalize_title(F.col("title")).alias("title"))


@query("sessions_of_project", v.SESSIONS_SQL, "SELECT provider, session_id FROM v_sessions WHERE cwd = '/w/u3/p4'")
def sessions_of_project(spark, d):
    return v.sessions(spark, d).where(F.col("cwd") == "/w/u3/p4").select("provider", "session_id")


@query("session_titles", r"""v_titles AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') END AS title FROM conversations)""",
       "SELECT conv_id AS session_id, arg_min(title, turn) FILTER (WHERE title IS NOT NULL) AS title, count(*) AS event_count FROM v_titles GROUP BY 1")
def session_titles(spark, d):
    return history.session_titles(v.messages(spark, d))


@query("question_hit_rate", v.QUESTIONS_SQL, "SELECT count(*) AS questions, count(*) FILTER (WHERE coalesce(chosen_option, '') = '') AS unanswered, count(matched) AS with_recommendation, count(*) FILTER (WHERE matched) AS followed, avg(CAST(CAST(matched AS INT) AS DOUBLE)) AS hit_rate FROM v_matched")
def question_hit_rate(spark, d):
    return history.question_summary(history.question_options(v.questions(spark, d)))


@query("recommended_split", v.QUESTIONS_SQL, "SELECT event_id, recommended_option, matched FROM v_matched")
def recommended_split(spark, d):
    return history.question_options(v.questions(spark, d)).select("event_id", "recommended_option", "matched")


@query("question_unanswered", v.QUESTIONS_SQL, "SELECT event_id, recommended_option FROM v_matched WHERE coalesce(chosen_option, '') = ''")
def question_unanswered(spark, d):
    return history.question_options(v.questions(spark, d)).where(F.coalesce("chosen_option", F.lit("")) == "").select("event_id", "recommended_option")


@query("question_answers", """v_asks AS (SELECT user_id, k % 10 AS ask, min(event_id) AS line FROM v_events WHERE event_type <> 'view' GROUP BY ALL),
v_answers AS (SELECT user_id, k % 10 AS ask, arg_max(value, event_id) AS answer, max(event_id) AS answer_line FROM v_events WHERE event_type = 'view' GROUP BY ALL)""",
       "SELECT user_id, ask, line, answer, answer_line FROM v_asks LEFT JOIN v_answers USING (user_id, ask)")
def question_answers(spark, d):
    rows = v._events(spark, d).withColumn("ask", F.col("k") % 10)
    asks = rows.where("event_type <> 'view'").groupBy("user_id", "ask").agg(F.min("event_id").alias("line"))
    answers = rows.where("event_type = 'view'").select("user_id", "ask", F.col("value").alias("answer"), F.col("event_id").alias("line"))
    return history.pair_answers(asks, answers, ["user_id", "ask"])


SCAN_COLUMNS = "file, line_no, category, snippet_redacted, CAST(confidence AS INT) AS confidence, CAST(length(value) AS INT) AS full_length, left(sha1(category || ':' || snippet_redacted), 16) AS fingerprint"


@query("scan_default", v.SEEDED_SQL, f"SELECT {SCAN_COLUMNS} FROM v_scan WHERE confidence >= 7")
def scan_default(spark, d):
    return findings.scan(v.seeded_lines(spark, d), 7)


@query("scan_all", v.SEEDED_SQL, f"SELECT {SCAN_COLUMNS} FROM v_scan")
def scan_all(spark, d):
    return findings.scan(v.seeded_lines(spark, d), 4)


@query("scan_entropy", v.SEEDED_SQL, "SELECT CAST(confidence AS INT) AS confidence, count(*) AS hits FROM v_scan WHERE category = 'high_entropy' GROUP BY 1")
def scan_entropy(spark, d):
    return findings.scan(v.seeded_lines(spark, d), 4).where("category = 'high_entropy'").groupBy("confidence").agg(F.count("*").alias("hits"))


@query("scan_by_category", v.SEEDED_SQL, "SELECT category, count(*) AS hits, count(DISTINCT file) AS files FROM v_scan WHERE confidence >= 7 GROUP BY 1")
def scan_by_category(spark, d):
    return findings.scan(v.seeded_lines(spark, d), 7).groupBy("category").agg(F.count("*").alias("hits"), F.count_distinct("file").alias("files"))


@query("scan_audit", v.SEEDED_SQL, "SELECT category, suppressed_by, count(*) AS hits FROM v_judged WHERE suppressed_by IS NOT NULL AND confidence >= 7 GROUP BY 1, 2")
def scan_audit(spark, d):
    return findings.audit(v.seeded_lines(spark, d), 7)


@query("document_scan_audit", v.SEEDED_SQL.replace("FROM v_seeded, v_detectors", "FROM (SELECT CAST(doc_id AS VARCHAR) AS file, 0 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents), v_detectors"),
       "SELECT category, suppressed_by, count(*) AS hits FROM v_judged WHERE suppressed_by IS NOT NULL AND confidence >= 7 GROUP BY 1, 2")
def document_scan_audit(spark, d):
    return findings.audit(v.dealt(v.table(spark, d, "documents").select("text")), 7, "text", limit=None, split=True)


@query("scan_prefilter", "v_lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)", f"SELECT count(*) AS lines, count(*) FILTER (WHERE {' OR '.join(f'contains(line, {a!r})' for a in dims.ANCHORS)}) AS anchored FROM v_lines")
def scan_prefilter(spark, d):
    return automaton.anchored(v.dealt(v.table(spark, d, "documents").select("text")), "text")


@query("redact", "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('…', length(c_name)) ELSE left(c_name, least(4, length(c_name) // 4)) || '…REDACTED…' || right(c_name, least(4, length(c_name) // 4)) END AS redacted, left(sha1('name:' || c_name), 16) AS fingerprint FROM customer")
def redact(spark, d):
    c = v.table(spark, d, "customer")
    return c.select("c_custkey", secrets.redact(F.col("c_name")).alias("redacted"), secrets.fingerprint(F.lit("name"), F.col("c_name")).alias("fingerprint"))


def _entries(spark, d):
    return history.question_options(v.questions(spark, d)).select(F.col("chosen_option").alias("user_choice"), F.col("recommended_option").alias("recommended"))


@query("compliance", v.QUESTIONS_SQL, "SELECT count(*) AS total_questions, count(*) FILTER (WHERE chosen_option = recommended_option) AS matched_count, avg(CAST(CAST(chosen_option = recommended_option AS INT) AS DOUBLE)) AS ratio FROM v_questions WHERE chosen_option IS NOT NULL AND recommended_option IS NOT NULL")
def compliance(spark, d):
    return behaviour.compliance(_entries(spark, d))


@query("skill_diversity", v.SKILL_EVENTS_SQL, "SELECT CAST(count(DISTINCT skill) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS diversity FROM v_skill_events WHERE event IN ('completed', 'started')")
def skill_diversity(spark, d):
    return behaviour.skill_diversity(v.skill_events(spark, d))


def _timing(name: str, g: int) -> None:
    body = f"""SELECT (h.h || '-' || (h.h + {g})) AS label, coalesce(n, 0) AS session_count, coalesce(mean, CAST(0 AS DOUBLE)) AS avg_event_count FROM (SELECT unnest(range(0, 24, {g})) AS h) h
LEFT JOIN (SELECT hour(started_at) // {g} * {g} AS h, count(*) AS n, avg(event_count) AS mean FROM v_sessions GROUP BY 1) x ON h.h = x.h"""
    query(name, v.SESSIONS_SQL, body)(lambda spark, d: behaviour.timing(v.sessions(spark, d), g))


_timing("timing_6h", 6)
_timing("timeslots_2h", 2)


@query("weekday", v.SESSIONS_SQL, """SELECT CAST(w.w AS INT) AS weekday, coalesce(n, 0) AS session_count, coalesce(vibe, CAST(0 AS DOUBLE)) AS vibe_rate, coalesce(mean, CAST(0 AS DOUBLE)) AS avg_event_count
FROM (SELECT unnest(range(7)) AS w) w LEFT JOIN (SELECT isodow(started_at) - 1 AS w, count(*) AS n, avg(CAST(CAST(event_count < 5 AS INT) AS DOUBLE)) AS vibe, avg(event_count) AS mean FROM v_sessions GROUP BY 1) x ON w.w = x.w""")
def weekday(spark, d):
    return behaviour.weekdays(v.sessions(spark, d))


@query("bimodal", v.SESSIONS_SQL, "SELECT avg(CAST(CAST(event_count < 5 AS INT) AS DOUBLE)) AS short_share, avg(event_count) FILTER (WHERE event_count >= 5) AS long_avg_events FROM v_sessions")
def bimodal(spark, d):
    return behaviour.bimodal(v.sessions(spark, d))


@query("project_switch", v.SESSIONS_SQL, "SELECT median(n) AS median_projects FROM (SELECT CAST(started_at AS DATE) AS day, count(DISTINCT regexp_extract(cwd, '([^/]+)/*$', 1)) AS n FROM v_sessions WHERE cwd IS NOT NULL GROUP BY 1)")
def project_switch(spark, d):
    return behaviour.project_switch(v.sessions(spark, d))


@query("project_focus", v.SESSIONS_SQL, "SELECT project, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM (SELECT regexp_extract(cwd, '([^/]+)/*$', 1) AS project, count(*) AS n, sum(count(*)) OVER () AS total FROM v_sessions WHERE cwd IS NOT NULL GROUP BY 1) ORDER BY n DESC, project LIMIT 1")
def project_focus(spark, d):
    return behaviour.project_focus(v.sessions(spark, d))


@query("top_skill", v.SKILL_EVENTS_SQL, "SELECT skill, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM (SELECT skill, count(*) AS n, sum(count(*)) OVER () AS total FROM v_skill_events WHERE event IN ('completed', 'started') GROUP BY 1) ORDER BY n DESC, skill LIMIT 1")
def top_skill(spark, d):
    return behaviour.top_skill(v.skill_events(spark, d))


@query("wins", v.SKILL_EVENTS_SQL, "SELECT DISTINCT skill, strftime(ts, '%Y-%m-%d') AS date FROM v_skill_events WHERE event = 'completed' AND outcome = 'clean' ORDER BY date DESC, skill LIMIT 3")
def wins(spark, d):
    return behaviour.wins(v.skill_events(spark, d))


def _by_user(name: str, sql: str, f: Callable[[SparkSession, str, list[str]], DataFrame], *ctes: str) -> None:
    """The per-user and the global form of a measure; {by} and {same} are filled in."""
    for suffix, by, select, group, same in (("", ["user_id"], "user_id, ", "GROUP BY user_id", "a.user_id = b.user_id AND "), ("_global", [], "", "", "")):
        query(name + suffix, *ctes, sql.format(by=select, group=group, same=same))(lambda spark, d, by=by: f(spark, d, by))


SHIP = "v_ships AS (SELECT * FROM v_skill_events WHERE event = 'completed' AND skill = 'ship')"
_by_user("ship_cadence",
         "SELECT {by}median(gap) AS median_days FROM (SELECT b.user_id, min(CAST(epoch_us(a.ts) - epoch_us(b.ts) AS DOUBLE)) / CAST(86400000000 AS DOUBLE) AS gap FROM v_ships b LEFT JOIN v_ships a ON {same}a.ts > b.ts GROUP BY b.user_id, b.ts) {group}",
         lambda spark, d, by: behaviour.ship_cadence(v.skill_events(spark, d), by), v.SKILL_EVENTS_SQL, SHIP)
_by_user("plan_then_ship", "SELECT {by}count(*) AS ships, avg(CAST(CAST(ok AS INT) AS DOUBLE)) AS ratio FROM (SELECT b.user_id, EXISTS (SELECT 1 FROM v_skill_events a WHERE {same}a.event = 'completed' AND contains(a.skill, 'plan-eng-review') AND a.ts <= b.ts AND a.ts >= b.ts - INTERVAL 7 DAY) AS ok FROM v_ships b) {group}",
         lambda spark, d, by: behaviour.plan_then_ship(v.skill_events(spark, d), by), v.SKILL_EVENTS_SQL, SHIP)
_by_user("vibe_score", "SELECT {by}count(*) AS ships, avg(CASE WHEN n < 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS score FROM (SELECT b.user_id, b.ts, arg_max(a.event_count, (a.started_at, a.session_id)) AS n FROM v_ships b LEFT JOIN v_sessions a ON {same}a.started_at <= b.ts GROUP BY b.user_id, b.ts) {group}",
         lambda spark, d, by: behaviour.vibe_score(v.sessions(spark, d), v.skill_events(spark, d), by), v.SESSIONS_SQL, v.SKILL_EVENTS_SQL, SHIP)
_by_user("late_night_ship", "SELECT {by}count(*) AS late_sessions, CASE WHEN count(*) >= 3 THEN avg(CAST(CAST(ok AS INT) AS DOUBLE)) END AS rate FROM (SELECT b.user_id, EXISTS (SELECT 1 FROM v_ships a WHERE {same}a.ts >= b.started_at AND a.ts <= b.started_at + INTERVAL 1 DAY) AS ok FROM v_sessions b WHERE hour(b.started_at) >= 22) {group}",
         lambda spark, d, by: behaviour.late_night_ships(v.sessions(spark, d), v.skill_events(spark, d), by), v.SESSIONS_SQL, v.SKILL_EVENTS_SQL, SHIP)
_by_user("overplanning", "SELECT {by}count(*) AS office_hours, CASE WHEN count(*) >= 3 THEN avg(CAST(CAST(NOT ok AS INT) AS DOUBLE)) END AS rate FROM (SELECT b.user_id, EXISTS (SELECT 1 FROM v_ships a WHERE {same}a.ts >= b.ts AND a.ts <= b.ts + INTERVAL 7 DAY) AS ok FROM v_skill_events b WHERE event IN ('completed', 'started') AND contains(skill, 'office-hours')) {group}",
         lambda spark, d, by: behaviour.overplanning(v.skill_events(spark, d), by), v.SKILL_EVENTS_SQL, SHIP)


FINDING = f"fingerprint, strftime(first_seen, {STAMP}) AS first_seen, strftime(last_seen, {STAMP}) AS last_seen, count, status"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("fingerprint", v.stamp("first_seen").alias("first_seen"), v.stamp("last_seen").alias("last_seen"), "count", "status")


@query("findings_upsert", v.LOG_SQL, f"SELECT {FINDING} FROM v_findings")
def findings_upsert(spark, d):
    return _shown(findings.fold(v.finding_log(spark, d)))


@query("findings_page", v.LOG_SQL, f"SELECT {FINDING} FROM v_findings WHERE last_seen >= TIMESTAMP '2024-01-20' ORDER BY v_findings.last_seen DESC, fingerprint LIMIT 10 OFFSET 5")
def findings_page(spark, d):
    return _shown(findings.page(findings.fold(v.finding_log(spark, d)), 10, 5, since="2024-01-20"))


@query("findings_status_counts", v.LOG_SQL, "SELECT CASE WHEN status = 'muted' AND muted_until <= TIMESTAMP '2024-01-30 12:00:00' THEN 'new' ELSE status END AS status, count(*) AS n FROM v_findings GROUP BY 1")
def findings_status_counts(spark, d):
    return findings.expire_mutes(findings.fold(v.finding_log(spark, d)), "2024-01-30 12:00:00").groupBy("status").agg(F.count("*").alias("n"))


@query("occurrences", v.LOG_SQL, f"SELECT f.fingerprint, f.status, seq, strftime(ts, {STAMP}) AS seen_at FROM v_findings f JOIN v_log l ON f.fingerprint = l.fingerprint WHERE kind = 'obs' AND f.fingerprint = 'fp7' ORDER BY ts DESC, seq LIMIT 50")
def occurrences(spark, d):
    log = v.finding_log(spark, d).where("fingerprint = 'fp7'")
    seen = log.where("kind = 'obs'").join(findings.fold(log).select("fingerprint", "status"), "fingerprint")
    return seen.orderBy(F.desc("ts"), "seq").limit(50).select("fingerprint", "status", "seq", v.stamp("ts").alias("seen_at"))


@query("dedupe_ttl", """v_first AS (SELECT event_type, min(ts) AS ts FROM v_events GROUP BY 1),
v_chain(event_type, ts) AS (SELECT event_type, ts FROM v_first UNION ALL SELECT c.event_type, (SELECT min(e.ts) FROM v_events e WHERE e.event_type = c.event_type AND e.ts > c.ts + INTERVAL 3600 SECOND) FROM v_chain c WHERE c.ts IS NOT NULL)""",
       f"SELECT event_type, strftime(ts, {STAMP}) AS ts FROM v_chain WHERE ts IS NOT NULL")
def dedupe_ttl(spark, d):
    return ordered.accept_after_quiet(v._events(spark, d).select("event_type", "ts"), ["event_type"], "ts", 3600).select("event_type", v.stamp("ts").alias("ts"))


@query("catches_by_day", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS catches FROM v_events WHERE {WINDOW} GROUP BY 1")
def catches_by_day(spark, d):
    return findings.catches_by_day(v._events(spark, d), START[:10], END[:10]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "catches")


HOOKS = [("h1", True, ["new_finding"], []), ("h2", True, ["new_finding", "reopened"], ["email", "jwt"]), ("h3", False, ["new_finding"], []), ("h4", True, ["reopened"], [])]
HOOKS_SQL = "v_hooks(hook_id, enabled, kinds, categories) AS (VALUES " + ", ".join(f"('{h}', {e}, {k}, CAST({c} AS VARCHAR[]))" for h, e, k, c in HOOKS) + ")"


def _alerts(spark, d):
    kind = F.when(F.col("line_no") % 5 == 0, "reopened").otherwise("new_finding")
    return findings.scan(v.seeded_lines(spark, d), 7).select(kind.alias("kind"), "category", "fingerprint", "line_no")


@query("webhook_fanout", v.SEEDED_SQL, HOOKS_SQL, """SELECT CASE WHEN line_no % 5 = 0 THEN 'reopened' ELSE 'new_finding' END AS kind, category, left(sha1(category || ':' || snippet_redacted), 16) AS fingerprint, line_no, hook_id
FROM v_scan, v_hooks WHERE confidence >= 7 AND enabled AND list_contains(kinds, CASE WHEN line_no % 5 = 0 THEN 'reopened' ELSE 'new_finding' END) AND (len(categories) = 0 OR list_contains(categories, category))""")
def webhook_fanout(spark, d):
    hooks = spark.createDataFrame(HOOKS, "hook_id string, enabled boolean, kinds array<string>, categories array<string>")
    return findings.fan_out(_alerts(spark, d), hooks)


_books = ", ".join(f"('{c}', '{s}', '{a}')" for c, (s, a) in dims.PLAYBOOKS.items())


@query("playbook_lookup", v.SEEDED_SQL, f"v_books(category, severity, advice) AS (VALUES {_books})", f"SELECT DISTINCT category, coalesce(severity, '{dims.PLAYBOOK_FALLBACK[0]}') AS severity, coalesce(advice, '{dims.PLAYBOOK_FALLBACK[1]}') AS advice FROM v_scan LEFT JOIN v_books USING (category)")
def playbook_lookup(spark, d):
    return findings.with_playbook(findings.scan(v.seeded_lines(spark, d), 4).select("category").distinct())


LABEL_SQL = """v_named AS (SELECT *, regexp_extract(cwd, '([^/]+)/*$', 1) AS name FROM v_sessions WHERE cwd IS NOT NULL),
v_labelled AS (
  SELECT n.*, CASE WHEN cwd = first_cwd THEN name ELSE name || '#' || left(sha1(cwd), 4) END AS label
  FROM v_named n JOIN (SELECT name, arg_min(cwd, (started_at, provider, session_id)) AS first_cwd FROM v_named GROUP BY 1) USING (name)),
v_nodes AS (
  SELECT provider || ':' || session_id AS id, 'session' AS kind, label, event_count AS size, event_count < 5 AS vibe FROM v_labelled
  UNION ALL SELECT 'hub:' || label, 'hub', label, count(*), false FROM v_labelled GROUP BY label)"""


@query("graph_nodes", v.SESSIONS_SQL, LABEL_SQL, "SELECT id, kind, label, size, vibe FROM v_nodes")
def graph_nodes(spark, d):
    return graph.nodes(v.sessions(spark, d))


@query("graph_links", v.SESSIONS_SQL, LABEL_SQL, "SELECT provider || ':' || session_id AS source, 'hub:' || label AS target FROM v_labelled")
def graph_links(spark, d):
    return graph.links(v.sessions(spark, d))


def _axis(salt: int) -> str:
    h = "CAST(CAST('0x' || left(md5('{0}:' || {1}), 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE)"
    hub, own = h.format(salt, "'hub:' || label"), h.format(salt, "id")
    at = f"round(CASE WHEN kind = 'hub' THEN {hub} * 2 - 1 ELSE {hub} * 2 - 1 + ({own} - CAST(0.5 AS DOUBLE)) * CAST(0.32 AS DOUBLE) END, 3)"
    return f"CASE WHEN {at} = 0 THEN CAST(0 AS DOUBLE) ELSE {at} END"


@query("graph_points", v.SESSIONS_SQL, LABEL_SQL, f"""SELECT id, {', '.join(f'{_axis(i)} AS {a}' for i, a in enumerate('xyz', 1))}, CASE WHEN kind = 'hub' THEN '{graph.HUB}' WHEN vibe THEN '{graph.COOL}' ELSE '{graph.WARM}' END AS c,
  round(CASE WHEN kind = 'hub' THEN greatest(CAST(2.5 AS DOUBLE), sqrt(size) * CAST(1.8 AS DOUBLE)) ELSE greatest(CAST(1.1 AS DOUBLE), sqrt(size + 1) * CAST(0.85 AS DOUBLE)) END, 2) AS s FROM v_nodes""")
def graph_points(spark, d):
    return graph.points(v.sessions(spark, d))


@query("codex_last_cumulative", "SELECT user_id, greatest(arg_max(CAST(floor(value * 10) AS BIGINT), event_id) - arg_max(k, event_id), 0) AS input_tokens, arg_max(k, event_id) AS cache_read_input_tokens, arg_max(event_id % 100, event_id) AS output_tokens FROM v_events GROUP BY 1")
def codex_last_cumulative(spark, d):
    rows = v._events(spark, d).select("user_id", F.col("event_id").alias("line"), F.floor(F.col("value") * 10).cast("long").alias("input_total"), F.col("k").alias("cached_total"), (F.col("event_id") % 100).alias("output_total"))
    return u.last_cumulative(rows, ["user_id"])


@query("real_sessions_semi", v.SESSIONS_SQL, "SELECT s.session_id, n AS event_count FROM v_sessions s JOIN (SELECT session_id, count(*) AS n FROM v_events WHERE event_type = 'purchase' GROUP BY 1) USING (session_id)")
def real_sessions_semi(spark, d):
    return history.real_sessions(v.sessions(spark, d).select("session_id"), v._events(spark, d).where("event_type = 'purchase'"), "session_id")


@query("unmapped_anti", v.SESSIONS_SQL, "SELECT provider, session_id FROM v_sessions s WHERE NOT EXISTS (SELECT 1 FROM v_events e WHERE e.event_type = 'purchase' AND e.session_id = s.session_id)")
def unmapped_anti(spark, d):
    return history.unmapped(v.sessions(spark, d), v._events(spark, d).where("event_type = 'purchase'"), "session_id").select("provider", "session_id")


@query("wide_cost", f"""v_prices(p, input, output, cache_write, cache_read) AS (VALUES {_rates}),
v_lines AS (SELECT c_mktsegment, strftime(l_shipdate, '%Y-%m') AS month, CASE p_size % 4 WHEN 0 THEN 'claude-opus-4-7' WHEN 1 THEN 'claude-sonnet-4-5' WHEN 2 THEN 'gpt-5' ELSE 'o3' END AS p, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)""",
       f"SELECT c_mktsegment, month, {USD.format('sum(q * 1000 * input + q * output)')} AS cost_usd, count(*) AS event_count FROM v_lines JOIN v_prices USING (p) GROUP BY 1, 2")
def wide_cost(spark, d):
    lines, orders, customer, part = (v.table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    model = F.element_at(F.array(*map(F.lit, ["claude-opus-4-7", "claude-sonnet-4-5", "gpt-5", "o3"])), (F.col("p_size") % 4 + 1).cast("int"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity").cast("long")
    usage = rows.select("c_mktsegment", F.date_format("l_shipdate", "yyyy-MM").alias("month"), model.alias("model"), (q * 1000).alias("input_tokens"), q.alias("output_tokens"), *[F.lit(0).cast("long").alias(c) for c in u.TOKENS[2:]])
    return u.by_model(usage, "c_mktsegment", "month").groupBy("c_mktsegment", "month").agg(u.usd(F.sum("nano")).alias("cost_usd"), F.sum("event_count").alias("event_count"))
