import datetime as dt
import json
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tracelake.operators import report
from tracelake.sinks.tables import LastStates
from tracelake.sources import jsonl, sqlite, stores
from tracelake.streaming import watch


def write(path, *events):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events))


@pytest.fixture(scope="module")
def claude(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("claude")
    say = lambda content, **k: {"type": "user", "cwd": "/w/a-b", "timestamp": "2026-06-01T10:00:00Z", "message": {"content": content}, **k}
    ask = {"type": "assistant", "timestamp": "2026-06-01T10:01:00Z", "message": {"content": [{"type": "tool_use", "id": "t1", "name": "mcp__x__AskUserQuestion", "input": {"questions": [
        {"question": "Which  way?", "options": [{"label": "Left (recommended)"}, {"label": "Right"}]}, {"question": "And then?", "options": []}, {"question": " "}]}}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {}}]}}
    answer = say([{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": '"Which way?"="Right" Other: later'}]}])
    use = {"type": "assistant", "message": {"model": "claude-opus-4-7", "usage": {"input_tokens": 10, "output_tokens": 2.9, "cache_read_input_tokens": "7", "cache_creation_input_tokens": True}}}
    orphan = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "t9", "name": "AskUserQuestion", "input": {"questions": [{"question": "Alone?"}]}}]}}
    write(root / "-w-a-b/s1.jsonl", {"type": "last-prompt", "sessionId": "s1"}, "{not valid json", "", say("<command-name>/gstack-ship</command-name>\nbody"), say([{"type": "image"}, {"type": "text", "text": "Real\n title"}]), ask, answer, use, orphan, "[1, 2]")
    write(root / "-w-c/s2.jsonl", {"type": "ai-title", "aiTitle": " Told  title "}, say("hello", cwd="/w/c"))
    write(root / "-w-d/s3.jsonl", use, {"type": "user", "message": {"content": "<command-name>x</command-name>"}})
    return jsonl.read_lines(spark, str(root))


def test_line_numbers_and_blank_lines(claude):
    rows = claude.where(F.col("file").endswith("s1.jsonl")).orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_claude_sessions(claude):
    rows = {r["session_id"]: r for r in jsonl.claude_sessions(claude).collect()}
    assert set(rows) == {"s1", "s2"}
    assert rows["s1"]["title"] == "Real title" and rows["s1"]["event_count"] == 9 and rows["s1"]["cwd"] == "/w/a-b" and rows["s1"]["started_at"] == dt.datetime(2026, 6, 1, 10)
    assert rows["s2"]["title"] == "Told title"


def test_claude_usage_keeps_files_without_a_folder(claude):
    rows = {r["session_id"]: r for r in jsonl.claude_usage(claude).collect()}
    assert rows["s1"]["cwd"] == "/w/a-b" and rows["s3"]["cwd"] is None
    assert [rows["s1"][c] for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")] == [10, 2, 0, 0]


def test_claude_skills_and_questions(claude):
    assert [(r["skill_name"], r["is_gstack"], r["cwd"]) for r in jsonl.claude_skills(claude).collect()] == [("ship", True, "/w/a-b")]
    rows = {r["question"]: r for r in jsonl.claude_questions(claude).collect()}
    assert set(rows) == {"Which way?", "And then?", "Alone?"}
    q = rows["Which way?"]
    assert (q["options"], q["recommended_option"], q["chosen_option"], q["notes"]) == (["Left", "Right"], "Left", "Right", "later")
    assert rows["Alone?"]["chosen_option"] is None


def test_codex_rollouts(spark, tmp_path):
    meta = {"type": "session_meta", "timestamp": "2026-06-01T00:00:00Z", "payload": {"id": "r1", "cwd": "/w/x"}}
    count = lambda i, c, o: {"type": "event_msg", "timestamp": "2026-06-01T00:01:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": 1}}}}
    write(tmp_path / "sessions/2026/06/01/rollout-a.jsonl", meta, {"type": "turn_context", "payload": {"model": "gpt-5"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": " do  it"}}, count(100, 40, 9), count(50, 80, 3))
    write(tmp_path / "sessions/2026/06/01/rollout-b.jsonl", "{broken", meta)
    lines = jsonl.read_lines(spark, str(tmp_path))
    s = jsonl.codex_sessions(lines).collect()
    assert [(r["session_id"], r["title"], r["event_count"], r["cwd"]) for r in s] == [("r1", "do it", 5, "/w/x")]
    u = jsonl.codex_usage(lines).first()
    assert (u["input_tokens"], u["cache_read_input_tokens"], u["output_tokens"], u["model"]) == (0, 80, 3, "gpt-5")  # last by position


def test_logs(spark, tmp_path):
    write(tmp_path / "q.jsonl", {"date": "2026-06-01", "skill": "s", "question_id": "q", "user_choice": "a", "recommended": "a"}, {"skill": "no time"}, "{x")
    assert jsonl.question_log(jsonl.read_lines(spark, str(tmp_path))).count() == 1
    assert jsonl.timeline(jsonl.read_lines(spark, str(tmp_path))).count() == 0


def test_sqlite_sources(spark, tmp_path):
    path = f"{tmp_path}/state.sqlite"
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE threads ({stores.THREADS.replace('string', 'TEXT').replace('bigint', 'INTEGER')})")
        db.executemany("INSERT INTO threads VALUES (?,?,?,?,?,?,?,?)", [("a", "p", "/w", " ", "[$gstack-ship](x) go", "pre  view", 1_000, 1), ("b", "p", "/v", "T", "hi", None, 0, 0)])
        db.execute(f"CREATE TABLE session ({stores.SESSIONS.replace('string', 'TEXT').replace('bigint', 'INTEGER')})")
        db.executemany("INSERT INTO session VALUES (?,?,?,?,?,?,?,?,?,?,?)", [("x", "/w", "t", 5, '{"id":"m"}', None, 1, 0, None, 3, 4), ("y", "", "t", 5, "{bad", "x", 0, 0, 0, 9, 9)])
    rows = {r["session_id"]: r for r in stores.codex_threads(spark, path).collect()}
    assert rows["a"]["title"] == "pre view" and rows["a"]["started_at"] == dt.datetime(1970, 1, 1, 0, 0, 1) and rows["b"]["started_at"] is None
    assert [r["skill_name"] for r in stores.codex_thread_skills(spark, path).collect()] == ["ship"]
    assert [r["session_id"] for r in stores.opencode_sessions(spark, path).collect()] == ["x"]
    u = stores.opencode_usage(spark, path).collect()
    assert [(r["model"], r["reasoning_output_tokens"], r["cache_creation_input_tokens"]) for r in u] == [("m", 0, 4)]
    scoped = sqlite.read_table(spark, path, "threads", "id string, cwd string").where("cwd = '/w'")
    assert [r["id"] for r in scoped.collect()] == ["a"]
    assert sqlite.read_table(spark, path, "(SELECT count(*) AS n FROM threads)", "n bigint").first()["n"] == 2


def test_cursor_store(spark, tmp_path):
    path = f"{tmp_path}/state.vscdb"
    h = "0123456789abcdef" * 2
    write(tmp_path / "workspaceStorage" / h / "workspace.json", {"folder": "file:///w/p"})
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE ItemTable (key TEXT, value TEXT)")
        db.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
        heads = [{"composerId": "c1", "workspaceIdentifier": {"id": h}}, {"composerId": "c2", "workspaceIdentifier": {"id": "123"}}, {"composerId": "c3"}]
        db.execute("INSERT INTO ItemTable VALUES (?, ?)", ("composer.composerHeaders", json.dumps({"allComposers": heads})))
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(f"composerData:c{i}", json.dumps({"name": f"n{i}", "createdAt": 1000, "tokenCount": 5})) for i in (1, 2, 3)])
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [("bubbleId:c1:1", "{}"), ("bubbleId:c1:2", "{}"), ("bubbleId:c2:1", "{}")])
    rows, unmapped = stores.cursor_sessions(spark, path, f"{tmp_path}/workspaceStorage")
    assert {(r["session_id"], r["cwd"], r["event_count"]) for r in rows.collect()} == {("c1", "/w/p", 2), ("c2", None, 1)}  # c3 is an empty shell
    assert [r["session_id"] for r in unmapped.collect()] == ["c2"]


def test_skill_files(spark, tmp_path):
    assert stores.frontmatter('---\nname: "n"\ndescription: |\n  one\n  two\nversion: 1.2\ntags:\n  - a\n---\nbody') == ("n", "one\ntwo", "1.2")
    assert stores.frontmatter("no block") == (None, None, None)
    for place, body in (("user/one", "---\nname: first\n---"), ("plugins/pack/1.0/skills/two", "plain")):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "SKILL.md").write_text(body)
    rows = stores.installed_skills(spark, {"user": f"{tmp_path}/user", "plugin": f"{tmp_path}/plugins"}).collect()
    assert {(r["name"], r["source"], r["plugin"]) for r in rows} == {("first", "user", None), ("two", "plugin", "pack")}


def secret(n):
    return "sk-ant-" + f"{n:024d}"


def test_tail_detect_and_restart(spark, tmp_path):
    src, out, check = tmp_path / "src", f"{tmp_path}/out", f"{tmp_path}/check"
    src.mkdir()
    f = src / "a.jsonl"
    f.write_text(f"k {secret(1)}\npartial {secret(2)}")

    def drain():
        rows = watch.detect(watch.follow(spark, str(src), f"{tmp_path}/plans"))
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
        try:
            deadline = time.time() + 40
            while time.time() < deadline:
                q.processAllAvailable()
                if q.lastProgress is not None:
                    break
        finally:
            q.stop()
        return sorted(r["byte_offset"] for r in spark.read.parquet(out).where("category = 'anthropic_key'").collect())

    assert drain() == [0]  # the partial line waits
    with f.open("a") as a:
        a.write(f" end\nnext {secret(3)}\n")
    first = len(f"k {secret(1)}\n")
    assert drain() == [0, first, first + len(f"partial {secret(2)} end\n")]  # after a restart, only what is new


def memory_stream(spark, tmp_path, schema, batches, build, pause=0.0):
    """Run a streaming build over one file per batch, restarted for each; all rows it gives."""
    src, rows = tmp_path / "in", []
    src.mkdir()
    for i, batch in enumerate(batches):
        if i:
            time.sleep(pause)
        if batch is not None:
            (src / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in batch))
        with watch.stateful(spark):
            built = build(spark.readStream.schema(schema).json(str(src)))
            q = built.writeStream.foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    return rows


def hit(m):
    return {"category": "c", "fingerprint": "f", "snippet_redacted": "s", "file": "x", "byte_offset": int(m * 60), "seen_at": f"2026-06-01T10:{int(m):02d}:{int(m * 60) % 60:02d}Z"}


def test_repeats_are_dropped_for_five_minutes_from_the_first(spark, tmp_path):
    rows = memory_stream(spark, tmp_path, watch.HIT, [[hit(0), hit(2)], [hit(5), hit(7)], [hit(9), hit(12.5)]], watch.drop_repeats)
    assert [r["byte_offset"] / 60 for r in rows] == [0, 7, 12.5]
    assert rows[1]["seen_at"].minute == 7 and rows[1]["category"] == "c"


def test_the_state_of_repeats_is_gone_after_the_time_to_live(spark, tmp_path):
    """Hits of one moment: the second is let through only because nothing is known of the first any more."""
    ttl = lambda rows: watch.drop_repeats(rows, dt.timedelta(seconds=2))
    began = time.time()
    rows = memory_stream(spark, tmp_path, watch.HIT, [[hit(1)], [hit(1)]], ttl, pause=2.5)
    assert len(rows) == 2 and time.time() - began < 60


LOG = "fingerprint string, category string, snippet_redacted string, kind string, order_at long, muted_until long, note string, file string, byte_offset long"


def said(n, kind, **more):
    return {"fingerprint": "f", "category": "c", "snippet_redacted": "s", "kind": kind, "order_at": n, "byte_offset": n, **more}


def test_findings_reopen(spark, tmp_path):
    batches = [[said(0, "ack"), said(1, "obs"), said(2, "obs")], [said(3, "resolve"), said(3, "odd")], [said(4, "obs"), said(5, "mute"), said(6, "obs"), said(7, "note", note="n")]]
    rows = memory_stream(spark, tmp_path, LOG, batches, watch.keep_findings)
    assert [(r["kind"], r["status"], r["count"], r["note"]) for r in rows] == [
        ("new_finding", "new", 1, None), ("updated", "new", 2, None), ("updated", "resolved", 2, None), ("reopened", "new", 1, None), ("updated", "muted", 1, None), ("updated", "muted", 2, None), ("updated", "muted", 2, "n")]


def test_a_mute_ends_without_new_input(spark, tmp_path):
    """The timer of a mute makes the finding new again in a batch that only the clock gives; a mute taken back has none."""
    now = int(time.time() * 1e6)
    mute = said(2, "mute", muted_until=now + 1_500_000)
    other = lambda r: {**r, "fingerprint": "g"}
    batches = [[said(1, "obs"), mute, other(said(1, "obs")), other(mute), other(said(3, "ack"))], None, None]
    with_clock = lambda rows: watch.keep_findings(rows.unionByName(watch.ticks(spark).selectExpr("'' AS fingerprint", "'tick' AS kind", "micros AS order_at"), allowMissingColumns=True))
    rows = memory_stream(spark, tmp_path, LOG, batches, with_clock, pause=2.5)
    mine = [(r["event"], r["status"], r["muted_until"] is None) for r in rows if r["fingerprint"] == "f"]
    assert mine == [("obs", "new", True), ("mute", "muted", False), ("expire", "new", True)]
    assert [r["event"] for r in rows if r["fingerprint"] == "g"] == ["obs", "mute", "ack"]


def test_drops_are_counted(spark, tmp_path):
    rows = memory_stream(spark, tmp_path, LOG, [[said(i, "obs") for i in range(5)], [said(5, "obs")]], lambda rows: watch.keep_findings(rows, dt.timedelta(seconds=60)))
    assert [(r["kind"], r["count"]) for r in rows] == [("new_finding", 1), ("dropped", 4), ("dropped", 1)]


def delivery_frame(*hooks):
    import pandas as pd

    return pd.DataFrame([(f"{h}-{i}", h, "f", "b", tries, None, None, "open", None) for i, (h, tries) in enumerate(hooks)], columns=[c.split()[0] for c in watch.DELIVERY.split(", ")])


def test_deliveries_are_tried_once_and_due_again():
    import pandas as pd

    calls, at = [], dt.datetime(2026, 6, 1)

    def send(hook, body, key):
        calls.append(hook)
        if hook == "down":
            raise OSError("no route")
        return {"ok": 200, "bad": 404, "flaky": 503}[hook]

    part = delivery_frame(("down", 0), ("ok", 0), ("bad", 0), ("flaky", 2), ("down", 0), ("down", 0), ("down", 1), ("flaky", 3), ("ok", 1))
    out = pd.concat(watch.attempt(send, now=lambda: at)(iter([part])))
    seen = [(r.hook_id, r.attempts, r.status, None if pd.isna(r.due_at) else (r.due_at - at).total_seconds()) for r in out.itertuples()]
    assert seen == [
        ("down", 1, "open", 10), ("ok", 1, "done", None), ("bad", 1, "dead", None), ("flaky", 3, "open", 600), ("down", 1, "open", 10), ("down", 1, "open", 10),
        ("down", 1, "open", 60), ("flaky", 4, "dead", None), ("ok", 2, "done", None)]
    assert calls.count("down") == watch.TIRED  # a dead hook is left alone for the rest of the task


def counted_send(folder, status):
    """A ``send`` that notes its calls in a folder, as it runs in workers."""
    def send(hook, body, key):
        (folder / f"{hook}-{key}-{time.time_ns()}").write_text(body)
        return status[hook]
    return send


def test_whole_watch_job(spark, tmp_path):
    for name in ("src", "calls"):
        (tmp_path / name).mkdir()
    (tmp_path / "src/a.jsonl").write_text(f"x {secret(5)}\n")
    hooks = spark.createDataFrame([("h", True, ["new_finding"], ["anthropic_key"]), ("ok", True, ["new_finding"], ["anthropic_key"])], "hook_id string, enabled boolean, kinds array<string>, categories array<string>")
    send = counted_send(tmp_path / "calls", {"h": 500, "ok": 200})
    for _ in range(4):
        q = watch.watch(spark, f"{tmp_path}/src", f"{tmp_path}/t", f"{tmp_path}/c", hooks, send, waits=(0, 0.5, 0.5), compact_every=2)
        assert q.awaitTermination(60)
        time.sleep(1.1)
    assert {r["category"] for r in spark.read.parquet(f"{tmp_path}/t/hits").collect()} == {"anthropic_key", "openai_key"}
    queue = watch.queue_of(spark, f"{tmp_path}/t")
    assert [(r["hook_id"], r["attempts"], r["last_error"]) for r in watch.dead_letter(queue).collect()] == [("h", 3, "status 500")]
    names = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "calls").iterdir())
    assert len(names) == 4 and len(set(names)) == 2  # three tries of one delivery under one key, and one of the other hook


def test_watch_keeps_findings(spark, tmp_path):
    """Repeats, mutes and resolves of one finding through the whole job: it alerts when new and when reopened."""
    (tmp_path / "src").mkdir()
    (tmp_path / "said").mkdir()
    hooks = spark.createDataFrame([("n", True, ["new_finding"], ["anthropic_key"]), ("r", True, ["reopened"], ["anthropic_key"])], "hook_id string, enabled boolean, kinds array<string>, categories array<string>")
    decisions = spark.readStream.schema(watch.DECISION).json(f"{tmp_path}/said")

    def turn(n, decision=None):
        if decision is None:
            with (tmp_path / "src/a.jsonl").open("a") as f:
                f.write(f"x {secret(5)}\n")
        else:
            fingerprint = spark.read.parquet(f"{tmp_path}/t/hits").where("category = 'anthropic_key'").first()["fingerprint"]
            (tmp_path / f"said/{n}.json").write_text(json.dumps({"fingerprint": fingerprint, "kind": decision, "seen_at": "2026-06-01T10:00:00Z"}) + "\n")
        q = watch.watch(spark, f"{tmp_path}/src", f"{tmp_path}/t", f"{tmp_path}/c", hooks, lambda hook, body, key: 404, decisions, dt.timedelta(0), (0,))
        assert q.awaitTermination(60)

    for n, decision in enumerate([None, None, "mute", None, "resolve", None]):
        turn(n, decision)
    findings = watch.findings_of(spark, f"{tmp_path}/t")
    rows = findings.log().where("category = 'anthropic_key'").orderBy("batch").collect()
    assert [(r["kind"], r["status"], r["count"]) for r in rows] == [("new_finding", "new", 1), ("updated", "new", 2), ("updated", "muted", 2), ("updated", "muted", 3), ("updated", "resolved", 3), ("reopened", "new", 1)]
    assert [r["hook_id"] for r in watch.dead_letter(watch.queue_of(spark, f"{tmp_path}/t")).orderBy("hook_id").collect()] == ["n", "r"]
    assert [(r["status"], r["count"]) for r in findings.read().where("category = 'anthropic_key'").collect()] == [("new", 1)]
    total = report.watch_totals(spark.read.parquet(f"{tmp_path}/t/counters"), "2026-06-01").first()
    assert (total["total_catches"], total["dropped"], total["reopened"]) == (8, 0, 1)
    lines = spark.createDataFrame([("f", 0, f"x {secret(5)}"), ("f", 9, f"y {secret(6)}")], "file string, byte_offset long, line string")
    missed = watch.sweep(lines, findings.read()).collect()
    assert {r["byte_offset"] for r in missed} == {9}


def test_last_states(spark, tmp_path):
    """Snapshots and deltas give the last row of each key; a batch that runs again changes nothing, and only touched buckets are rewritten."""
    r, want = random.Random(3), {}
    table = LastStates(spark, f"{tmp_path}/t", "k string, v long, order_at long", "k", ["order_at"], buckets=8, over="v < 0")

    def put(n):
        rows = [(f"k{r.randint(0, 30)}", r.randint(0, 99), i) for i in range(r.randint(0, 6))]
        table.put(n, spark.createDataFrame(rows, "k string, v long, order_at long"))
        want.update({k: v for k, v, _ in rows})
        return rows

    now = lambda: {x["k"]: x["v"] for x in table.read().collect()}
    assert now() == {} and not table.has(0)
    for n in range(7):
        rows = put(n)
        table.put(n, spark.createDataFrame(rows, "k string, v long, order_at long"))  # again, as after a failure
        assert table.has(n) and now() == want
        if n in (2, 5):
            table.compact()
            table.put(n, spark.createDataFrame([("k0", -5, 9)], "k string, v long, order_at long"))  # too late: it is in the snapshot
            assert table.upto() == n and now() == want
    table.compact()
    table.vacuum()
    assert now() == want and table.log().count() == 0
    old = dict(table._versions())
    table.put(7, spark.createDataFrame([("k1", -1, 0), ("k2", 5, 0)], "k string, v long, order_at long"))
    table.compact()
    want.pop("k1", None)
    assert now() == want | {"k2": 5}  # what is over has left
    assert sum(v == 7 for v in table._versions().values()) <= 2 and {b for b, v in old.items() if table._versions().get(b) == v}


def test_requeue_of_dead_letters(spark):
    rows = spark.createDataFrame([("ok", "f", "{}", 4, "x", None), ("bad", "f", "{}", 1, "x", None), ("ok", "g", "no json", 1, "x", None), ("other", "h", "{}", 2, "x", None)], watch.DEAD_LETTER)
    send = lambda hook, body, key: 404 if hook == "bad" else 200
    left = {(r["hook_id"], r["fingerprint"], r["attempts"]) for r in watch.requeue(rows, send).collect()}
    assert left == {("bad", "f", 2), ("ok", "g", 1)}
    one = {(r["hook_id"], r["fingerprint"], r["attempts"]) for r in watch.requeue(rows, send, "other").collect()}
    assert one == {("ok", "f", 4), ("bad", "f", 1), ("ok", "g", 1)}
    assert watch.dead_letters(rows, 2).count() == 2


def test_tail_spans_and_long_lines(tmp_path):
    """Spans share a file out by line starts; a line longer than the batch limit is read all the same."""
    from tracelake.sources.tail import TailReader

    lines = [b"a" * 5, b"", b"b" * 90, b"c", b"\xff" * 7, b"d" * 200]
    f = tmp_path / "x.jsonl"
    f.write_bytes(b"".join(x + b"\n" for x in lines) + b"partial")
    for span in (1, 7, 64, 10_000):
        for limit in (1, 20, 10_000):
            options = {"path": str(tmp_path), "spanBytes": str(span), "maxBytesPerBatch": str(limit), "plans": f"{tmp_path}/plans-{span}-{limit}"}
            reader = TailReader(options)
            start, found = reader.initialOffset(), []
            for turn in range(20):
                if turn % 3 == 2:
                    reader = TailReader(options)  # a restart goes on from the log of plans
                end = reader.latestOffset()
                found += [r for p in reader.partitions(start, end) for r in reader.read(p)]
                start = end
            assert [x for _, _, x in found] == [x.decode("utf-8", "replace") for x in lines], (span, limit)
            assert [at for _, at, _ in found] == [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    f.write_bytes(b"new\n")  # a file that shrank begins anew
    end = reader.latestOffset()
    assert [r[2] for p in reader.partitions(start, end) for r in reader.read(p)] == ["new"]


def test_tail_of_many_files_has_small_offsets_and_starves_none(tmp_path):
    """100,000 files: offsets stay a number, a quick early file does not keep the others waiting, and old plans are forgotten."""
    from tracelake.sources import tail

    src = tmp_path / "src"
    for i in range(100):
        (src / f"{i:02d}").mkdir(parents=True)
        for j in range(1000):
            (src / f"{i:02d}/{j:03d}.jsonl").write_text(f"line {i} {j}\n")
    reader = tail.TailReader({"path": str(src), "plans": f"{tmp_path}/plans", "maxBytesPerBatch": "400000"})
    first, seen, start = src / "00/000.jsonl", set(), reader.initialOffset()
    for _ in range(8):
        with first.open("a") as f:
            f.write("again and again\n" * 100_000)  # over the limit of a batch by itself
        end = reader.latestOffset()
        assert len(json.dumps(end)) < 100
        taken = [p.value for p in reader.partitions(start, end)]
        seen |= {v[0] for v in taken}
        assert sum(v[2] - v[1] for v in taken) <= 2 * 400_000
        reader.commit(end)
        start = end
    assert len(seen) == 100_000
    log = tail.PlanLog(f"{tmp_path}/plans")
    for n in range(start["plan"] + 1, start["plan"] + 2 * tail.PLANS_PER_LIST + 1):
        log.add(n, [(str(first), n, n + 1)], {str(first): n + 1})
    log.forget(n)
    assert len(log.numbers()) < tail.PLANS_PER_LIST and log.state() == (n, {str(first): n + 1})


def test_providers_as_one_listing(spark, claude, tmp_path, recwarn):
    from tracelake.sources import providers

    db = sqlite3.connect(tmp_path / "o.db")
    db.execute("CREATE TABLE session (id TEXT, directory TEXT, title TEXT, time_created INT, model TEXT, parent_id TEXT, tokens_input INT, tokens_output INT, tokens_reasoning INT, tokens_cache_read INT, tokens_cache_write INT)")
    db.execute("INSERT INTO session VALUES ('o1', '/w/c', 'T', 1000, NULL, NULL, 5, 0, 0, 0, 0)")
    db.commit()
    root = str(claude) if isinstance(claude, (str, type(tmp_path))) else None
    root = root or str(next(iter(claude.select("file").collect()))[0]).removeprefix("file:").rsplit("/", 2)[0]
    registry = [providers.claude(root), providers.codex([f"{tmp_path}/none"]), providers.opencode(f"{tmp_path}/o.db"), providers.cursor(f"{tmp_path}/no.db", f"{tmp_path}/no")]
    every = {(r["provider"], r["session_id"]) for r in providers.union(spark, registry, "sessions").collect()}
    assert ("opencode", "o1") in every and ("claude", "s1") in every and {p for p, _ in every} == {"claude", "opencode"}
    assert any("codex" in str(w.message) for w in recwarn) and any("cursor" in str(w.message) for w in recwarn)
    assert {r["session_id"] for r in providers.union(spark, registry, "sessions", cwd="/w//c/").collect()} >= {"o1", "s2"}
    assert providers.union(spark, registry, "sessions", cwd="/W/C").count() == 0 and providers.union(spark, registry, "sessions", cwd="/W/C", ignore_case=True).count() > 0
    assert {r["provider"] for r in providers.union(spark, registry, "sessions", ["OpenCode"]).collect()} == {"opencode"}
    assert providers.union(spark, registry, "questions", ["opencode"]).count() == 0
    assert providers.run_query(spark, registry, "usage", sink=lambda df: df.count(), names=["opencode"]) == 1
    first = lambda rows: providers.either(rows, lambda s, _: s.range(3))(spark, None).count()
    assert first(lambda s, _: s.range(2)) == 2 and first(lambda s, _: s.read.parquet(f"{tmp_path}/gone")) == 3


def test_prefixes_are_pushed_as_ranges(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "k.db")
    db.execute("CREATE TABLE kv (key TEXT, value TEXT)")
    db.executemany("INSERT INTO kv VALUES (?, ?)", [(k, "v") for k in ("a", "ab", "b:1", "b:2", "b;", "c", None)])
    db.commit()
    rows = sqlite.read_table(spark, f"{tmp_path}/k.db", "kv", "key string, value string").where(F.col("key").startswith("b:"))
    assert sorted(r["key"] for r in rows.collect()) == ["b:1", "b:2"]
    reader = sqlite.SqliteReader({"path": "x", "table": "kv"}, rows.schema)
    from pyspark.sql.datasource import StringStartsWith

    assert list(reader.pushFilters([StringStartsWith(("key",), "b:")])) and reader.where == [('"key" >= ?', "b:"), ('"key" < ?', "b;")]
    db.execute("BEGIN EXCLUSIVE")
    assert sqlite.read_table(spark, f"{tmp_path}/k.db", "kv", "key string", skip_locked=True).count() == 0


def test_lines_of_a_file_in_many_blocks_are_numbered_through(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("one\n\nthree")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    try:
        rows = jsonl.read_lines(spark, str(tmp_path))
        found = {(r["file"][-7], r["line_no"]): r["line"] for r in rows.collect()}
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert found == {("a", i + 1): x for i, x in enumerate(lines) if x} | {("b", 1): "one", ("b", 3): "three"}


def test_missing_roots_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b.jsonl").write_text("y\n")
    found = jsonl.scan_lines(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/d", f"{tmp_path}/gone")
    assert {r["line"] for r in found.collect()} == {"x", "y"}
    assert jsonl.scan_lines(spark, f"{tmp_path}/gone").count() == 0


def test_a_union_reads_each_source_once(spark, tmp_path):
    """Sources are staged when the union is built: nothing is read again, and files that go afterwards change nothing."""
    from tracelake.sources import providers

    (tmp_path / "a.jsonl").write_text('{"type":"user","cwd":"/w/a","timestamp":"2024-01-01T00:00:00Z","message":{"content":"hello"}}\n')
    rows = providers.union(spark, [providers.claude(str(tmp_path))], "sessions")
    (tmp_path / "a.jsonl").unlink()
    assert [r["session_id"] for r in rows.collect()] == ["a"]


def test_short_files_are_read_once_for_their_numbers(spark, tmp_path):
    """Only files that can be cut are read for the lines of their blocks."""
    (tmp_path / "a.jsonl").write_text("one\n\nthree\n")
    plan = jsonl.read_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("file_size") and [(r["line_no"], r["line"]) for r in jsonl.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "one"), (3, "three")]


def test_a_finding_is_one_value_of_state():
    """A key's state is read once, and written once if it changes; the ttl counts from the finding's last observation."""
    from types import SimpleNamespace

    from tracelake.streaming import state

    calls, kept = [], {}

    def value(name, *_, **__):
        return SimpleNamespace(exists=lambda: calls.append("exists") or name in kept, get=lambda: calls.append("get") or kept.get(name), update=lambda v: calls.append("update") or kept.__setitem__(name, v))

    findings = state.Findings(dt.timedelta(seconds=60))
    findings.init(SimpleNamespace(getValueState=value))
    row = lambda s: {"kind": "obs", "order_at": s * 1_000_000, "byte_offset": 0, "category": "c", "snippet_redacted": "s", "note": None, "muted_until": None, "file": "f"}
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    out = [(r["kind"], r["count"]) for batch in ([row(0), row(1)], [row(60)], [row(61)]) for r in findings.handleInputRows(("k",), batch, clock)]
    assert out == [("new_finding", 1), ("dropped", 1), ("dropped", 1), ("updated", 2)]
    assert calls == ["get", "update", "get", "get", "update"]


def opencode_store(path):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE session ({stores.SESSIONS.replace('string', 'TEXT').replace('bigint', 'INTEGER')})")
        db.execute("INSERT INTO session VALUES ('o1', '/w/c', 'T', 1000, NULL, NULL, 5, 0, 0, 0, 0)")


def test_a_union_fails_with_a_provider_that_is_there(spark, tmp_path, recwarn):
    """Rows of the others alone would look like all; only a store that is not there has none."""
    from tracelake.sources import providers

    opencode_store(tmp_path / "o.db")
    (tmp_path / "broken.db").write_bytes(b"SQLite format 3\0" + bytes(2000))
    lock = sqlite3.connect(tmp_path / "locked.db", isolation_level=None)
    lock.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
    lock.execute("BEGIN EXCLUSIVE")
    whole, gone, broken = (providers.opencode(f"{tmp_path}/{n}.db") for n in ("o", "gone", "broken"))
    locked = providers.cursor(f"{tmp_path}/locked.db", f"{tmp_path}/none")
    job = providers.Provider("job", {"usage": lambda s, _: providers.opencode(f"{tmp_path}/o.db").builders["usage"](s, None).withColumn("cwd", F.raise_error(F.lit("a task died")))})
    for p, message in ((broken, "not a database"), (locked, "locked"), (job, "a task died")):
        with pytest.raises(Exception, match=message):
            providers.union(spark, [whole, p], "usage")
    failed = []
    assert [r["provider"] for r in providers.union(spark, [broken, locked, whole, job, gone], "usage", failed=failed).collect()] == ["opencode"]
    assert [name for name, _ in failed] == ["opencode", "cursor", "job"]
    assert providers.union(spark, [whole, gone], "usage").count() == 1 and any("gone.db is not there" in str(w.message) for w in recwarn)
    lock.close()


def test_a_union_lists_what_is_there_of_a_provider(spark, tmp_path, recwarn):
    """Of several roots some may be missing, as may Cursor's workspaces; a folder without transcripts is no failure."""
    from tracelake.sources import providers

    meta = {"type": "session_meta", "timestamp": "2026-06-01T00:00:00Z", "payload": {"id": "r1", "cwd": "/w/x"}}
    write(tmp_path / "sessions/rollout-a.jsonl", meta)
    write(tmp_path / "claude/-w-x/s1.jsonl", {"type": "user", "cwd": "/w/x", "timestamp": "2026-06-01T00:00:00Z", "message": {"content": "hello"}})
    (tmp_path / "skills/one").mkdir(parents=True)
    (tmp_path / "skills/one/SKILL.md").write_text("plain")
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("CREATE TABLE ItemTable (key TEXT, value TEXT)")
        db.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [("composerData:c1", json.dumps({"name": "n"})), ("bubbleId:c1:1", "{}")])
    every = [
        providers.claude(f"{tmp_path}/claude", {"user": f"{tmp_path}/skills", "plugin": f"{tmp_path}/none"}), providers.codex([f"{tmp_path}/sessions", f"{tmp_path}/archived_sessions"]),
        providers.cursor(f"{tmp_path}/c.db", f"{tmp_path}/none"),
    ]
    assert {(r["provider"], r["session_id"], r["cwd"]) for r in providers.union(spark, every, "sessions").collect()} == {("claude", "s1", "/w/x"), ("codex", "r1", "/w/x"), ("cursor", "c1", None)}
    assert [r["name"] for r in providers.union(spark, every, "installed").collect()] == ["one"]
    assert providers.union(spark, every[:1], "sessions", cwd="/other").count() == 0
    assert not [w for w in recwarn if "left out" in str(w.message)]


def test_a_long_file_among_many_short_ones_is_numbered(spark, tmp_path):
    """Spark cuts a file by all files of a scan, so a scan of the long ones alone has other blocks than one of all."""
    from tracelake.sources import providers

    say = '{"type":"user","cwd":"/w/a","timestamp":"2024-01-01T00:00:00Z","message":{"content":"hello"}}\n'
    for i in range(50):
        (tmp_path / f"s{i}.jsonl").write_text(say)
    (tmp_path / "long.jsonl").write_text(say * 500)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1000)
    try:
        numbers = [r["line_no"] for r in jsonl.read_lines(spark, str(tmp_path)).where(F.col("file").endswith("long.jsonl")).collect()]
        events = {r["session_id"]: r["event_count"] for r in providers.union(spark, [providers.claude(str(tmp_path))], "sessions").collect()}
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert sorted(numbers) == list(range(1, 501))
    assert events == {"long": 500} | {f"s{i}": 1 for i in range(50)}


def test_skills_of_codex_are_not_lost_with_its_thread_store(spark, tmp_path, recwarn):
    """Without a thread store the rollouts give the skills; a broken one is an error, as is any other failure of a job."""
    from tracelake.sources import providers

    meta = {"type": "session_meta", "timestamp": "2026-06-01T00:00:00Z", "payload": {"id": "r1", "cwd": "/w/x"}}
    say = lambda text: {"type": "event_msg", "payload": {"type": "user_message", "message": text}}
    for place in ("sessions", "archived_sessions"):
        write(tmp_path / place / "rollout-a.jsonl", meta, "{broken", say("  "), say("[$gstack-ship](x) go"), say("[$later](x)"))
    write(tmp_path / "sessions/rollout-b.jsonl", meta, say("go [$not-first](x)"))
    write(tmp_path / "sessions/rollout-c.jsonl", say("[$no-folder](x)"), say("[$no-folder](x)"))
    (tmp_path / "stores").mkdir()
    (tmp_path / "stores/broken.db").write_bytes(b"SQLite format 3\0" + bytes(2000))
    with sqlite3.connect(tmp_path / "stores/whole.db") as db:
        db.execute(f"CREATE TABLE threads ({stores.THREADS.replace('string', 'TEXT').replace('bigint', 'INTEGER')})")
        db.execute("INSERT INTO threads VALUES ('a', 'p', '/w', 'T', '[$qa](x) go', NULL, 1000, 0)")
    write(tmp_path / "claude/-w-x/s1.jsonl", {"type": "user", "cwd": "/w/x", "timestamp": "2026-06-01T10:00:00Z", "message": {"content": "<command-name>/review</command-name>"}})
    roots = [f"{tmp_path}/sessions", f"{tmp_path}/archived_sessions"]
    skills = lambda p: {(r["provider"], r["skill_name"], r["cwd"], r["is_gstack"], r["source_path"].rsplit("/", 2)[-2]) for r in providers.union(spark, [providers.claude(f"{tmp_path}/claude"), p], "skills").collect()}
    claude, ship = ("claude", "review", "/w/x", False, "-w-x"), ("codex", "ship", "/w/x", True, "sessions")
    with pytest.raises(Exception, match="not a database"):
        skills(providers.codex(roots, threads=f"{tmp_path}/stores"))
    assert skills(providers.codex(roots, threads=f"{tmp_path}/gone")) == {claude, ship} == skills(providers.codex(roots))
    assert [r["skill_name"] for r in providers.union(spark, [providers.codex(roots, threads=f"{tmp_path}/stores/whole.db")], "skills").collect()] == ["qa"]
    assert skills(providers.codex([f"{tmp_path}/none"], threads=f"{tmp_path}/gone")) == {claude} and any("codex is left out" in str(w.message) for w in recwarn)


def test_only_a_store_that_cannot_be_read_has_a_second_source(spark, tmp_path):
    from tracelake.sources import providers

    (tmp_path / "broken.db").write_bytes(b"SQLite format 3\0" + bytes(2000))
    broken = lambda s, _: stores.codex_threads(s, f"{tmp_path}/broken.db")
    died = lambda s, _: s.range(2).select(F.raise_error(F.lit("a task died")).alias("id")).where("id is null")
    gone = lambda s, _: s.createDataFrame([(providers.store(f"{tmp_path}/gone"),)])
    second = lambda s, _: s.range(3)
    for first, other, message in ((died, second, "a task died"), (broken, gone, "not a database"), (gone, gone, "is not there")):
        with pytest.raises(Exception, match=message):
            providers.either(first, other)(spark, None)
    assert providers.either(broken, second)(spark, None).count() == 3 == providers.either(gone, second)(spark, None).count()
