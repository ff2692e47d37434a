import datetime as dt
import random
import statistics

import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from tracelake.operators import behaviour, findings, graph, history, ordered, usage

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def history_rows(spark):
    r = random.Random(1)
    events = [(r.randint(0, 3), at(r.uniform(0, 900)), r.choice(["ship", "plan-eng-review", "office-hours", "qa"]), r.choice(["completed", "started"]), "clean") for _ in range(300)]
    sessions = [(r.randint(0, 3), f"s{i}", at(r.uniform(0, 900)), r.randint(1, 9), f"/w/p{r.randint(0, 4)}") for i in range(200)]
    sessions += [(0, "none", None, 3, None), (1, "empty", at(5), None, "")]
    return (
        spark.createDataFrame(events, "user_id int, ts timestamp, skill string, event string, outcome string"), events,
        spark.createDataFrame(sessions, "user_id int, session_id string, started_at timestamp, event_count int, cwd string"), sessions,
    )


@pytest.mark.parametrize("size", [7, 1_000_000])
def test_as_of_equals_a_scan(history_rows, monkeypatch, size):
    """As one window, and cut into pieces of a few rows."""
    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", size)
    events, e, sessions, s = history_rows
    for forward in (False, True):
        near = ordered.as_of(events, sessions, ["user_id"], "ts", "started_at", F.struct("started_at", "session_id"), "hit", forward=forward)
        rows = near.collect()
        assert len(rows) == len(e)
        for r in rows:
            same = [(x[2], x[1]) for x in s if x[0] == r["user_id"] and x[2] is not None and (x[2] >= r["ts"] if forward else x[2] <= r["ts"])]
            want = (min if forward else max)(same, default=None)
            assert (r["hit"] and (r["hit"]["started_at"], r["hit"]["session_id"])) == want


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_measures_equal_loops(history_rows, monkeypatch, size):
    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", size)
    events, e, sessions, s = history_rows
    ships = [(x[0], x[1]) for x in e if x[2] == "ship" and x[3] == "completed"]
    plans = [x[1] for x in e if x[2] == "plan-eng-review" and x[3] == "completed"]
    week, day = dt.timedelta(days=7), dt.timedelta(days=1)
    assert behaviour.plan_then_ship(events, []).first()["ratio"] == pytest.approx(sum(any(t - week <= p <= t for p in plans) for _, t in ships) / len(ships))
    prior = [max(((x[2], x[1], x[3]) for x in s if x[2] and x[2] <= t), default=None) for _, t in ships]
    assert behaviour.vibe_score(sessions, events, []).first()["score"] == pytest.approx(sum(p is not None and (p[2] or 0) < 5 for p in prior) / len(ships))
    late = [x[2] for x in s if x[2] and x[2].hour >= 22]
    assert behaviour.late_night_ships(sessions, events, []).first()["rate"] == pytest.approx(sum(any(t <= x <= t + day for _, x in ships) for t in late) / len(late))
    office = [x[1] for x in e if x[2] == "office-hours"]
    assert behaviour.overplanning(events, []).first()["rate"] == pytest.approx(sum(not any(t <= x <= t + week for _, x in ships) for t in office) / len(office))
    times = sorted(t for _, t in ships)
    gaps = sorted((b - a).total_seconds() / 86400 for a, b in zip(times, times[1:], strict=False))
    assert behaviour.ship_cadence(events, []).first()["median_days"] == pytest.approx((gaps[len(gaps) // 2] + gaps[(len(gaps) - 1) // 2]) / 2)


def test_measures_without_rows(history_rows):
    events, _, sessions, _ = history_rows
    none, no_sessions = events.where("false"), sessions.where("false")
    assert behaviour.timing(no_sessions).count() == 4 and behaviour.weekdays(no_sessions).agg(F.sum("session_count")).first()[0] == 0
    assert behaviour.skill_diversity(none).first()[0] is None and behaviour.project_focus(no_sessions).first()["project"] is None
    assert behaviour.project_switch(sessions.limit(2)).first()[0] is None
    assert behaviour.top_skill(events.limit(3)).first()["skill"] is None
    assert behaviour.wins(none).count() == 0


def test_quiet_time_is_from_the_last_accepted(spark):
    minutes = [0, 2, 5, 7, 9, 12, 12.5, 30]
    rows = spark.createDataFrame([("k", T0 + dt.timedelta(minutes=m)) for m in minutes] + [("k", T0)], "key string, ts timestamp")
    kept = ordered.accept_after_quiet(rows, ["key"], "ts", 300).orderBy("ts").collect()
    assert [(r["ts"] - T0).total_seconds() / 60 for r in kept] == [0, 7, 12.5, 30]


def accepted(times, ttl):
    found = []
    for t in sorted(times):
        if not found or t - found[-1] > ttl:
            found.append(t)
    return found


@pytest.mark.parametrize("size,ttl", [(50, 300), (1_000_000, 300), (30, 86_400), (50, 20)])
def test_quiet_time_of_dense_keys_collects_no_island(spark, monkeypatch, size, ttl):
    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", size)
    def refuse(*_):
        raise AssertionError("a key in one array")

    monkeypatch.setattr(F, "collect_set", refuse)
    monkeypatch.setattr(F, "collect_list", refuse)
    r = random.Random(8)
    rows = [(k, T0 + dt.timedelta(seconds=r.randint(0, n * 60))) for k, n in (("a", 3000), ("b", 40), (None, 500)) for _ in range(1500)]
    want = {(key, t) for key in ("a", "b", None) for t in accepted((t for k, t in rows if k == key), dt.timedelta(seconds=ttl))}
    found = [tuple(x) for x in ordered.accept_after_quiet(spark.createDataFrame([*rows, ("c", None)], "key string, ts timestamp"), ["key"], "ts", ttl).collect()]
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("ttl", [300, 7 * 86_400])
def test_no_task_gets_a_dense_key(spark, monkeypatch, ttl):
    """400,000 hits of one key, and a burst of as many: pieces stay near their size for a short and a long time to live."""
    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 20_000)
    sizes = spark.sparkContext.accumulator(0)
    largest = spark.sparkContext.accumulator(0, Largest())

    def measured(f):
        def run(table, *rest):
            sizes.add(1)
            largest.add(len(table))
            return f(table, *rest)
        return run

    monkeypatch.setattr(ordered, "_lasts", measured(ordered._lasts))
    monkeypatch.setattr(ordered, "_accepted", measured(ordered._accepted))
    # a hit each 10 seconds, and then one each microsecond
    micros = F.when(F.col("id") < 400_000, F.col("id") * 10_000_000).otherwise(4_000_000_000_000 + F.col("id"))
    rows = spark.range(800_000).select(F.lit("k").alias("key"), F.timestamp_micros(micros).alias("ts"))
    found = sorted(r[0] for r in ordered.accept_after_quiet(rows, ["key"], "ts", ttl).select(F.unix_micros("ts")).collect())
    assert found == accepted([i * 10_000_000 if i < 400_000 else 4_000_000_000_000 + i for i in range(800_000)], ttl * 1_000_000)
    assert sizes.value > 40 and largest.value <= 2 * 20_000


class Largest(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def test_a_burst_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 5_000)
    rows = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") % 7).alias("t"), "id", F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    pieces = [r["count"] for r in ordered.in_pieces(rows, 100_000, "k", "t", "id").groupBy("_piece").count().collect()]
    assert sum(pieces) == 100_000 and max(pieces) <= 10_000
    found = {r["id"]: r["p"] for r in ordered.carry_last(rows, [], ["t", "id"], F.col("v"), "p").collect()}
    last = None
    for t, i in sorted((i % 7, i) for i in range(100_000)):
        assert found[i] == last
        last = i if i % 1000 == 0 else last


@pytest.mark.parametrize("listed,parts", [(10_000, 64), (20, 4)])
def test_exact_median(spark, monkeypatch, listed, parts):
    """Also where brackets must be narrowed again and again."""
    monkeypatch.setattr(ordered, "LISTED_VALUES", listed)
    monkeypatch.setattr(ordered, "PARTS", parts)
    r = random.Random(5)
    rows = [(k, v) for k in ("a", "b", None) for v in [r.choice([r.gauss(0, 1), 3.0, None]) for _ in range(r.choice([1, 2, 501, 1000]))]] + [("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for by in (["k"], []):
        for accuracy in (10_000, 50, 5):
            found = {x[0] if by else 0: x["m"] for x in ordered.exact_median(df, by, "v", "m", accuracy).collect()}
            for k in {x[0] if by else 0 for x in rows}:
                own = [v for x, v in rows if v is not None and (not by or x == k)]
                assert found[k] == (statistics.median(own) if own else None)


def state(log):
    """The findings state machine, row by row."""
    found = {}
    for fp, seq, ts, kind, until in sorted(log, key=lambda x: x[1]):
        f = found.get(fp)
        if kind == "obs":
            if f is None:
                found[fp] = {"first": ts, "last": ts, "count": 1, "status": "new", "until": None}
            elif f["status"] == "resolved":
                f |= {"last": ts, "count": 1, "status": "new"}
            else:
                f |= {"last": ts, "count": f["count"] + 1}
        elif f is not None:
            f |= {"status": {"ack": "ack", "mute": "muted", "resolve": "resolved"}[kind], "until": until if kind == "mute" else None}
    return {(k, v["first"], v["last"], v["count"], v["status"], v["until"]) for k, v in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_the_state_machine(spark, seed):
    r = random.Random(seed)
    log = []
    for i in range(600):
        kind = r.choice(["obs", "obs", "obs", "ack", "mute", "resolve", "resolve"])
        log.append((f"f{r.randint(0, 25)}", i, at(i), kind, at(i + 24) if kind == "mute" else None))
    rows = findings.fold(spark.createDataFrame(log, "fingerprint string, seq long, ts timestamp, kind string, muted_until timestamp"))
    assert {tuple(x) for x in rows.select("fingerprint", "first_seen", "last_seen", "count", "status", "muted_until").collect()} == state(log)


def test_mutes_expire_on_reading(spark):
    rows = spark.createDataFrame([("a", "muted", at(1)), ("b", "muted", at(3)), ("c", "muted", None), ("d", "ack", None)], "fingerprint string, status string, muted_until timestamp")
    found = {r["fingerprint"]: r["status"] for r in findings.expire_mutes(rows, str(at(2))).collect()}
    assert found == {"a": "new", "b": "muted", "c": "muted", "d": "ack"}


def test_fan_out_and_payload(spark):
    events = spark.createDataFrame([("new_finding", "email", "f1", "s", 1, at(0)), ("reopened", "jwt", "f2", "s", 2, at(0)), ("new_finding", "odd", "f3", "s", 1, at(0))], "kind string, category string, fingerprint string, snippet_redacted string, count long, first_seen timestamp")
    hooks = spark.createDataFrame([("all", True, ["new_finding", "reopened"], None), ("jwt", True, ["reopened", "new_finding"], ["jwt"]), ("off", False, ["new_finding"], [])], "hook_id string, enabled boolean, kinds array<string>, categories array<string>")
    assert {(r["fingerprint"], r["hook_id"]) for r in findings.fan_out(events, hooks).collect()} == {("f1", "all"), ("f2", "all"), ("f3", "all"), ("f2", "jwt")}
    books = findings.with_playbook(events)
    assert {r["category"]: r["severity"] for r in books.collect()} == {"email": "low", "jwt": "critical", "odd": "high"}
    assert '"severity":"critical"' in books.where("category = 'jwt'").select(findings.payload("incident")).first()[0]


def test_scan_hides_values_and_clips(spark):
    secret = "sk-ant-" + "a1" * 20
    rows = spark.createDataFrame([("f", 1, "k " + secret), ("f", 2, "x" * 20_000 + " " + secret), ("f", 3, None)], "file string, line_no int, line string")
    found = findings.scan(rows, 4).collect()
    assert {(r["line_no"], r["category"]) for r in found} == {(1, "anthropic_key"), (1, "openai_key")}
    assert all(secret not in str(r) for r in found)


def test_documents_are_audited_behind_the_clip(spark, tmp_path):
    from tracelake.plans import catalogue

    spark.createDataFrame([(1, "x " * 10_000 + "noreply@example.com")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["hits"] for r in catalogue.QUERIES["document_scan_audit"](spark, str(tmp_path)).collect()] == [1]


def test_graph_disambiguates_equal_names(spark):
    rows = spark.createDataFrame([("c", "1", at(0), 3, "/a/app"), ("c", "2", at(1), 9, "/b/app"), ("x", "1", at(2), 9, "/a/app"), ("c", "3", at(3), 1, None)], "provider string, session_id string, started_at timestamp, event_count int, cwd string")
    nodes = graph.nodes(rows).collect()
    hubs = {r["label"]: r["size"] for r in nodes if r["kind"] == "hub"}
    assert hubs["app"] == 2 and len(hubs) == 2 and next(k for k in hubs if k != "app").startswith("app#")
    assert graph.links(rows).count() == 3 and graph.points(rows).count() == 5
    assert graph.points(rows.where("false")).count() == 0


def test_usage_reports(spark):
    u = spark.createDataFrame([("claude", "s", "/w/p", at(0), "claude-opus-4-7", 1000, 500, 10, 20, 0), ("codex", "s", None, at(1), "gpt-5", 10, 5, 0, 0, 7), ("codex", "t", "/w/p", None, "", 1, 1, 1, 1, 1)],
                              "provider string, session_id string, cwd string, ts timestamp, model string, " + ", ".join(f"{c} long" for c in usage.TOKENS))
    by = {(r["label"], r["provider"]): r for r in usage.cost(u, "project").collect()}
    assert by["p", "claude"]["cost_usd"] == pytest.approx((1000 * 5 + 500 * 25 + 10 * 6.25 + 20 * 0.5) / 1e6)
    assert by["(unknown cwd)", "codex"]["cost_usd"] == pytest.approx((10 * 2.5 + 12 * 10) / 1e6)
    assert {r["label"] for r in usage.cost(u, "model").collect()} == {"claude-opus-4-7", "gpt-5", "(unknown model)"}
    assert {r["label"] for r in usage.cost(u, "month").collect()} == {"2024-01", "(unknown)"}
    assert usage.activity(u).first()["session_count"] == 3  # a session is a provider and an id
    assert usage.in_window(u, str(at(0)), str(at(1))).count() == 1
    assert usage.projection(u, "2024-01-01 00:00:00", "2024-01-01 00:30:00").first()["enough_data"] is False
    with pytest.raises(ValueError):
        usage.label("color")


def test_order_and_first_source(spark):
    rows = spark.createDataFrame([("a", at(1)), ("b", None), ("c", at(2))], "id string, ts timestamp")
    assert [r["id"] for r in history.newest_first(rows, "ts", 2).collect()] == ["b", "c"]
    assert [r["id"] for r in history.newest_first(rows, "ts", 0, False).collect()] == ["c", "a", "b"]
    other = spark.createDataFrame([("a", at(9)), ("d", at(9))], "id string, ts timestamp")
    assert {r["id"]: r["ts"] for r in history.first_per_id([rows, other], "id").collect()} == {"a": at(1), "b": None, "c": at(2), "d": at(9)}


def test_fan_out_leaves_events_where_they_are(spark):
    """Hooks are broadcast whatever the sizes; events are neither broadcast nor shuffled by their few kinds, and worked out once."""
    from tracelake.operators import findings

    hooks = spark.createDataFrame(
        [("all", True, ["new_finding", "new_finding"], []), ("none", True, ["reopened"], None), ("some", True, ["new_finding"], ["jwt", "jwt", "email"]), ("off", False, ["new_finding"], [])],
        "hook_id string, enabled boolean, kinds array<string>, categories array<string>")
    events = spark.range(0, 60, 1, 3).selectExpr("id", "if(id % 3 = 0, 'reopened', 'new_finding') kind", "element_at(array('jwt', 'email', 'x', null), cast(id % 4 + 1 as int)) category")
    rows = findings.fan_out(events, hooks)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 60") == 1 and "hashpartitioning" not in plan and "BuildRight" in plan
    want = {(i, h) for i in range(60) for h in ([["all"] + ["some"] * (i % 4 < 2), ["none"]][i % 3 == 0])}
    assert rows.count() == len(want) and {(r["id"], r["hook_id"]) for r in rows.collect()} == want and rows.columns == ["id", "kind", "category", "hook_id"]
