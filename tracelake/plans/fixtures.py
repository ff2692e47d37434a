"""Assistants' stores made of the driver tables: transcripts, rollouts, SQLite stores and skill files.

The users of ``events`` are dealt to the four assistants; what each did is written in its
assistant's form, one transcript or one row a user, and read back by the sources.
"""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.storage import mounted, new_folder
from tracelake.plans import views as v
from tracelake.sources import providers
from tracelake.sources.stores import SESSIONS, THREADS

CLAUDE, CODEX, OPENCODE, CURSOR = range(4)
MODEL = "claude-sonnet-4-5"


def iso(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def doings(spark: SparkSession, sf_dir: str, assistant: int) -> DataFrame:
    """The events of an assistant's users, each user with one folder."""
    cwd = F.concat(F.lit("/w/u"), F.col("user_id") % 11, F.lit("/p"), F.col("user_id") % 5)
    return v._events(spark, sf_dir).where(F.col("user_id") % 4 == assistant).withColumn("cwd", cwd).drop("provider", "session_id")


def write_files(lines: DataFrame, root: str) -> None:
    """Write (path, n, line) rows as files under a root, the lines of each in order of n."""

    def written(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        path, folder, stream = None, None, None
        for part in parts:
            for name, lines in part.groupby("path", sort=False)["line"]:
                if name != path:
                    if stream:
                        stream.close()
                    path = name
                    if path.rpartition("/")[0] != folder:
                        folder = path.rpartition("/")[0]
                        fs.create_dir(f"{base}/{folder}", recursive=True)
                    stream = fs.open_output_stream(f"{base}/{path}")
                stream.write("".join(f"{line}\n" for line in lines).encode())
        if stream:
            stream.close()
        yield pd.DataFrame({"files": [0]})

    lines.repartition("path").sortWithinPartitions("path", "n").select("path", "line").mapInPandas(written, "files long").count()


def claude(spark: SparkSession, sf_dir: str) -> str:
    """Transcripts: prompts, usage, skill markers, questions with and without answers, and lines that are no JSON."""
    e = doings(spark, sf_dir, CLAUDE)
    obj = lambda **k: F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in k.items()])
    say = lambda content: F.to_json(obj(type="user", cwd=F.col("cwd"), timestamp=iso(), message=obj(content=content)))
    usage = obj(input_tokens=F.floor(F.col("value") * 10), output_tokens=F.col("k"), cache_creation_input_tokens=F.col("event_id") % 50, cache_read_input_tokens=F.col("event_id") % 400)
    used = F.to_json(obj(type="assistant", timestamp=iso(), message=obj(model=MODEL, usage=usage)))
    skill = F.when(F.col("k") % 2 == 0, "/gstack-ship").otherwise("review")
    marker = say(F.concat(F.lit("<command-name>"), skill, F.lit("</command-name>\nbody")))
    tool, question = F.concat(F.lit("t"), "event_id"), F.concat(F.lit("Which  of "), F.col("k"), F.lit("?"))
    options = F.transform(v.question_labels(), lambda x: F.struct(x.alias("label")))
    asked = F.to_json(obj(type="assistant", timestamp=iso(), message=obj(content=F.array(obj(type="tool_use", id=tool, name="AskUserQuestion", input=obj(questions=F.array(obj(question=question, options=options))))))))
    pair = F.concat(F.lit('"Which of '), F.col("k"), F.lit('?"="'), v.question_choice(), F.lit('"'))
    answered = F.when(v.question_choice().isNotNull(), say(F.array(obj(type="tool_result", tool_use_id=tool, content=F.array(obj(type="text", text=pair))))))
    kind = F.col("event_type")
    lines = F.when(kind == "click", F.array(say(F.concat(F.lit(" Task\n no "), F.col("k"))))).when(kind == "purchase", F.array(used)).when(kind == "signup", F.array(marker)).when(kind == "view", F.array(asked, answered)).otherwise(F.array(F.lit("{not json")))
    path = F.concat(F.regexp_replace("cwd", "/", "-"), F.lit("/"), "user_id", F.lit(".jsonl"))
    body = e.select(path.alias("path"), "event_id", F.posexplode(F.array_compact(lines)).alias("i", "line")).select("path", (F.col("event_id") * 2 + F.col("i")).alias("n"), "line")
    head = e.select(path.alias("path")).distinct().select("path", F.lit(-1).cast("long").alias("n"), F.lit('{"type":"last-prompt"}').alias("line"))
    root = new_folder(spark, "claude")
    write_files(head.unionByName(body), root)
    return mounted(root)


def codex(spark: SparkSession, sf_dir: str) -> str:
    """Rollouts: meta data first, messages, models, and counters that run on."""
    e = doings(spark, sf_dir, CODEX)
    counted = F.col("event_type").isin("purchase", "signup", "error")
    run = Window.partitionBy("user_id").orderBy("event_id")
    total = lambda c: F.sum(F.when(counted, c).otherwise(0)).over(run)
    obj = lambda **k: F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in k.items()])
    sums = obj(input_tokens=total(F.floor(F.col("value") * 10) + 5), cached_input_tokens=total(F.lit(5)), output_tokens=total(F.col("k")), reasoning_output_tokens=total(F.col("event_id") % 3))
    counter = F.to_json(obj(timestamp=iso(), type="event_msg", payload=obj(type="token_count", info=obj(total_token_usage=sums))))
    message = F.to_json(obj(timestamp=iso(), type="event_msg", payload=obj(type="user_message", message=F.concat(F.lit("Fix  it "), F.col("k")))))
    model = F.to_json(obj(type="turn_context", payload=obj(model="gpt-5-codex")))
    line = F.when(counted, counter).when(F.col("event_type") == "click", message).otherwise(model)
    path = F.concat(F.when(F.col("user_id") % 8 < 4, "sessions").otherwise("archived_sessions"), F.lit("/2024/rollout-"), "user_id", F.lit(".jsonl"))
    first = e.groupBy("user_id", "cwd").agg(F.min("ts").alias("ts"))
    meta = F.to_json(obj(timestamp=iso(), type="session_meta", payload=obj(id=F.col("user_id").cast("string"), timestamp=iso(), cwd=F.col("cwd"))))
    root = new_folder(spark, "codex")
    write_files(e.select(path.alias("path"), F.col("event_id").alias("n"), line.alias("line")).unionByName(first.select(path.alias("path"), F.lit(-1).cast("long").alias("n"), meta.alias("line"))), root)
    return mounted(root)


#: Users of one store, so the number of stores grows with that of users.
USERS_PER_STORE = 32


def write_sqlite(tables: dict[str, tuple[str, DataFrame]], root: str) -> None:
    """Write tables (columns in SQL, rows with their ``store``) into SQLite files ``store.db`` under a root, each by the task that gets it."""
    rows = None
    for name, (_, df) in tables.items():
        values = [F.col(c).cast("string") for c in df.columns if c != "store"]
        one = df.select("store", F.lit(name).alias("name"), F.to_json(F.array(*values), {"ignoreNullFields": "false"}).alias("row"))
        rows = one if rows is None else rows.unionByName(one)
    columns = {name: sql for name, (sql, _) in tables.items()}

    def one_store(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import json
        import os
        import shutil

        with tempfile.NamedTemporaryFile(suffix=".db") as own:
            db = sqlite3.connect(own.name)
            db.execute("PRAGMA synchronous = OFF")  # a file of the task's own
            for name, sql in columns.items():
                db.execute(f"CREATE TABLE {name} ({sql})")
                values = [json.loads(x) for x in part.loc[part["name"] == name, "row"]]
                if values:
                    db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
            db.commit()
            db.close()
            os.makedirs(root, exist_ok=True)
            shutil.copy(own.name, f"{root}/{key[0]}.db")
        return pd.DataFrame({"files": [1]})

    rows.groupBy("store").applyInPandas(one_store, "files long").count()


def _sql(ddl: str) -> str:
    return ", ".join(f"{c.split()[0]} {'TEXT' if c.split()[1] == 'string' else 'INTEGER'}" for c in ddl.split(", "))


def _users(spark: SparkSession, sf_dir: str, assistant: int) -> DataFrame:
    """One row a user: first time in milliseconds, events, sums."""
    store = F.floor(F.col("user_id") / USERS_PER_STORE).alias("store")
    return doings(spark, sf_dir, assistant).groupBy("user_id", "cwd", store).agg(
        F.min(F.unix_millis("ts")).alias("ms"), F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.sum(F.floor(F.col("value") * 10)).alias("sum_value"), F.max("k").alias("k"))


def threads(spark: SparkSession, sf_dir: str) -> str:
    """Codex's thread store: titles that fall back, skill markers, archived rows."""
    u = _users(spark, sf_dir, CODEX)
    rest = {"id": F.col("user_id").cast("string"), "rollout_path": F.lit("/r"), "cwd": F.col("cwd"), "title": F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" T "), "user_id")).otherwise(""),
            "first_user_message": F.when(F.col("user_id") % 5 == 0, "[$gstack-qa](x) go").otherwise("hello"), "preview": F.when(F.col("user_id") % 2 == 0, "seen"),
            "created_at_ms": F.when(F.col("user_id") % 7 != 0, F.col("ms")).otherwise(0), "archived": F.col("user_id") % 2}
    path = mounted(new_folder(spark, "threads"))
    write_sqlite({"threads": (_sql(THREADS), u.select("store", *[rest[c.split()[0]].alias(c.split()[0]) for c in THREADS.split(", ")]))}, path)
    return path


def opencode(spark: SparkSession, sf_dir: str) -> str:
    u = _users(spark, sf_dir, OPENCODE)
    model = F.when(F.col("user_id") % 3 == 0, F.lit('{"modelID":"gpt-5","providerID":"p"}')).when(F.col("user_id") % 3 == 1, F.lit('{"id":"o3"}')).otherwise("{broken")
    some = lambda c: F.when(F.col("user_id") % 10 != 0, c).otherwise(0)
    rest = {"id": F.concat(F.lit("o"), "user_id"), "directory": F.col("cwd"), "title": F.lit("  A  title"), "time_created": F.col("ms"), "model": model, "parent_id": F.lit(None), "tokens_input": some(F.col("sum_value")),
            "tokens_output": some(F.col("sum_k")), "tokens_reasoning": F.lit(1), "tokens_cache_read": F.col("n"), "tokens_cache_write": F.lit(2)}
    path = mounted(new_folder(spark, "opencode"))
    write_sqlite({"session": (_sql(SESSIONS), u.select("store", *[rest[c.split()[0]].cast("string").alias(c.split()[0]) for c in SESSIONS.split(", ")]))}, path)
    return path


def cursor(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Two stores: sessions with and without bubbles, headers with and without a known workspace."""
    u = _users(spark, sf_dir, CURSOR)
    sid, hash_ = F.concat(F.lit("c"), "user_id"), F.md5(F.col("cwd"))
    bubbles = u.where(F.col("user_id") % 10 != 0).select("store", F.explode(F.sequence(F.lit(1), (F.col("n") % 5 + 1).cast("int"))).alias("i"), sid.alias("sid")).select("store", F.concat(F.lit("bubbleId:"), "sid", F.lit(":"), "i").alias("key"), F.lit("{}").alias("value"))
    data = u.select("store", F.concat(F.lit("composerData:"), sid).alias("key"), F.to_json(F.struct(F.concat(F.lit("Chat "), "user_id").alias("name"), F.col("ms").alias("createdAt"), F.when(F.col("user_id") % 3 == 0, F.col("sum_k")).alias("tokenCount"))).alias("value"))
    header = F.struct(sid.alias("composerId"), F.when(F.col("user_id") % 4 == 3, F.struct(F.when(F.col("user_id") % 5 != 0, hash_).otherwise("17").alias("id"))).alias("workspaceIdentifier"))
    heads = u.groupBy("store").agg(F.collect_list(header).alias("allComposers")).select("store", F.lit("composer.composerHeaders").alias("key"), F.to_json(F.struct("allComposers")).alias("value"))
    root = new_folder(spark, "cursor")
    folders = u.select("cwd").distinct().select(F.concat(F.md5("cwd"), F.lit("/workspace.json")).alias("path"), F.lit(0).alias("n"), F.to_json(F.struct(F.concat(F.lit("file://"), "cwd").alias("folder"))).alias("line"))
    write_files(folders, root)
    path = mounted(new_folder(spark, "cursor-state"))
    text = "key TEXT, value TEXT"
    write_sqlite({"cursorDiskKV": (text, bubbles.unionByName(data)), "ItemTable": (text, heads)}, path)
    return path, mounted(root)


def skill_files(spark: SparkSession, sf_dir: str, rooted: bool = False) -> str:
    """A SKILL.md of each nation: some with a block of data before the text, quoted or folded, some without; ``rooted`` under a user's, plugins' and a system's folder."""
    n = v.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    name = F.concat(F.lit("name: "), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(F.col("n_name")))
    about = F.when(F.col("n_nationkey") % 5 == 0, F.lit("description: |\n  One\n  two")).otherwise(F.lit("description: >\n  One\n  two"))
    text = F.when(F.col("n_nationkey") % 3 != 0, F.concat_ws("\n", F.lit("---"), name, about, F.concat(F.lit("version: 1."), "n_nationkey"), F.lit("tags:\n- a\n---\nbody"))).otherwise("# no data")
    root = new_folder(spark, "skills")
    k = F.col("n_nationkey")
    above = F.when(k % 4 == 0, "user/skills/").when(k % 4 == 1, F.concat(F.lit("plugins/plug"), k % 3, F.lit("/1.0/skills/"))).otherwise("system/skills/") if rooted else F.lit("")
    write_files(n.select(F.concat(above, F.lit("s"), "n_nationkey", F.lit("/SKILL.md")).alias("path"), F.lit(0).alias("n"), text.alias("line")), root)
    return mounted(root)


def logs(spark: SparkSession, sf_dir: str) -> str:
    """Behaviour logs: a time under one of three names, or none; fields that may be missing; lines that are no JSON."""
    e = v._events(spark, sf_dir)
    n = F.col("event_id")
    when = F.struct(F.when(n % 5 == 0, iso()).alias("ts"), F.when(n % 5 == 1, iso()).alias("timestamp"), F.when(n % 5 == 2, F.date_format("ts", "yyyy-MM-dd")).alias("date"))
    entry = F.struct(when["ts"].alias("ts"), when["timestamp"].alias("timestamp"), when["date"].alias("date"), F.concat(F.lit("s"), F.col("k") % 7).alias("skill"), F.col("event_type").alias("event"), F.when(F.col("k") % 3 > 0, "clean").alias("outcome"),
                     F.concat(F.lit("q"), n).alias("question_id"), F.when(F.col("k") % 2 == 0, "yes").alias("user_choice"), F.when(F.col("k") % 4 == 0, "yes").otherwise("no").alias("recommended"))
    root = new_folder(spark, "logs")
    line = F.when(n % 11 == 10, F.lit("{cut")).otherwise(F.to_json(entry))
    write_files(e.select(F.concat(F.lit("log-"), F.col("user_id") % 16, F.lit(".jsonl")).alias("path"), n.alias("n"), line.alias("line")), root)
    return mounted(root)


def registry(spark: SparkSession, sf_dir: str) -> list[providers.Provider]:
    """All four assistants, and one whose store is not there."""
    db, spaces = cursor(spark, sf_dir)
    return [
        providers.claude(claude(spark, sf_dir)), providers.codex([codex(spark, sf_dir)]), providers.opencode(opencode(spark, sf_dir)), providers.cursor(db, spaces),
        providers.opencode(mounted(new_folder(spark, "missing")) + ".db"),
    ]
