"""Sessions and usage of the assistants that keep SQLite stores, and installed-skill files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import is_suite_skill, leading_skill, local_path, normalize_skill_name, opencode_model
from tracelake.operators.history import pick_title
from tracelake.sources.jsonl import existing, get, integer
from tracelake.sources.sqlite import read_table

THREADS = "id string, rollout_path string, cwd string, title string, first_user_message string, preview string, created_at_ms bigint, archived int"
SESSIONS = "id string, directory string, title string, time_created bigint, model string, parent_id string, tokens_input bigint, tokens_output bigint, tokens_reasoning bigint, tokens_cache_read bigint, tokens_cache_write bigint"


def from_millis(c: Column) -> Column:
    """Epoch milliseconds as a timestamp; nothing for zero or less."""
    return F.when(c > 0, F.timestamp_millis(c))


def codex_threads(spark: SparkSession, path: str) -> DataFrame:
    t = read_table(spark, path, "threads", THREADS)
    title = pick_title(F.col("title"), F.col("preview"), F.col("first_user_message"))
    return t.select(F.lit("codex").alias("provider"), F.col("id").alias("session_id"), "cwd", from_millis(F.col("created_at_ms")).alias("started_at"), F.lit(None).cast("long").alias("event_count"), F.col("rollout_path").alias("source_path"), title.alias("title"))


def codex_thread_skills(spark: SparkSession, path: str) -> DataFrame:
    """Threads that begin with a skill marker ``[$name]``."""
    t = read_table(spark, path, "threads", THREADS).where(F.col("first_user_message").startswith("[$"))
    raw = leading_skill("first_user_message")
    return t.select(normalize_skill_name(raw).alias("skill_name"), F.lit("codex").alias("provider"), "cwd", from_millis(F.col("created_at_ms")).alias("ts"), F.col("rollout_path").alias("source_path"), is_suite_skill(raw).alias("is_gstack")).where("skill_name <> ''")


def opencode_sessions(spark: SparkSession, path: str) -> DataFrame:
    t = read_table(spark, path, "session", SESSIONS).where(F.coalesce("directory", F.lit("")) != "")
    return t.select(F.lit("opencode").alias("provider"), F.col("id").alias("session_id"), F.col("directory").alias("cwd"), from_millis(F.col("time_created")).alias("started_at"), F.lit(None).cast("long").alias("event_count"), F.lit(path).alias("source_path"), pick_title(F.col("title")).alias("title"))


def opencode_usage(spark: SparkSession, path: str) -> DataFrame:
    """One row per session with input or output tokens."""
    t = read_table(spark, path, "session", SESSIONS).where((F.col("tokens_input") > 0) | (F.col("tokens_output") > 0))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return t.select(
        F.lit("opencode").alias("provider"), F.col("id").alias("session_id"), F.col("directory").alias("cwd"), from_millis(F.col("time_created")).alias("ts"), opencode_model(F.col("model")).alias("model"),
        n("tokens_input").alias("input_tokens"), n("tokens_output").alias("output_tokens"), n("tokens_cache_write").alias("cache_creation_input_tokens"), n("tokens_cache_read").alias("cache_read_input_tokens"),
        n("tokens_reasoning").alias("reasoning_output_tokens"), F.lit(path).alias("source_path"),
    )


def cursor_sessions(spark: SparkSession, global_db: str, workspace_dir: str, skip_locked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Real sessions (those with bubbles), their folder where known, and the unmapped ones; a store that stays locked is skipped, or an error."""
    bubbles = read_table(spark, global_db, "cursorDiskKV", "key string", skip_locked).where(F.col("key").startswith("bubbleId:"))
    counts = bubbles.groupBy(F.split_part("key", F.lit(":"), F.lit(2)).alias("session_id")).agg(F.count("*").alias("event_count"))
    items = read_table(spark, global_db, "ItemTable", "key string, value string", skip_locked).where(F.col("key") == "composer.composerHeaders")
    headers = items.select(F.explode(get(F.try_parse_json("value"), "$.allComposers", "array<variant>")).alias("c")).select(get("c", "$.composerId").alias("session_id"), get("c", "$.workspaceIdentifier.id").alias("hash"))
    folders = spark.createDataFrame([], "hash string, folder string")
    if existing(spark, workspace_dir):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "workspace.json").text(workspace_dir, wholetext=True)
        folders = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/workspace\.json$", 1).alias("hash"), get(F.try_parse_json("value"), "$.folder").alias("folder")).where((F.col("hash") != "") & F.col("folder").startswith("file://"))
    mapped = headers.join(folders.select("hash", local_path(F.col("folder")).alias("cwd")), "hash", "left").select("session_id", "cwd")
    data = read_table(spark, global_db, "cursorDiskKV", "key string, value string", skip_locked).where(F.col("key").startswith("composerData:"))
    v = F.try_parse_json("value")
    known = data.select(F.split_part("key", F.lit(":"), F.lit(2)).alias("session_id"), get(v, "$.name").alias("title"), from_millis(integer(v, "$.createdAt")).alias("started_at"), integer(v, "$.tokenCount").alias("tokens"))
    every = counts.join(known, "session_id").join(mapped, "session_id", "left")
    rows = every.select(F.lit("cursor").alias("provider"), "session_id", "cwd", "started_at", "event_count", F.lit(global_db).alias("source_path"), pick_title(F.col("title")).alias("title"), "tokens")
    return rows, rows.where("cwd is null")


def cursor_usage(spark: SparkSession, global_db: str, workspace_dir: str, skip_locked: bool = True) -> DataFrame:
    """One row per real session with a token count; all tokens are input, and the model is unknown."""
    rows, _ = cursor_sessions(spark, global_db, workspace_dir, skip_locked)
    zero = F.lit(0).cast("long")
    return rows.where("tokens > 0").select(
        "provider", "session_id", "cwd", F.col("started_at").alias("ts"), F.lit(None).cast("string").alias("model"), F.col("tokens").alias("input_tokens"), zero.alias("output_tokens"),
        zero.alias("cache_creation_input_tokens"), zero.alias("cache_read_input_tokens"), zero.alias("reasoning_output_tokens"), "source_path",
    )


def by_source(skills: DataFrame) -> DataFrame:
    """Installed skills in the order of a listing: source, then name whatever its case."""
    return skills.orderBy("source", F.lower("name"), "source_path")


SKILL_FILE = "name string, description string, version string"


def frontmatter(text: str) -> tuple[str | None, str | None, str | None]:
    """Name, description and version of a leading block between dashes; quoted scalars and ``|`` / ``>`` blocks."""
    lines = (text or "").splitlines()
    found: dict[str, str] = {}
    if lines and lines[0].strip() == "---":
        key, block, folded = None, [], False
        for line in [*lines[1:], "---"]:
            if key and (line.startswith((" ", "\t")) or not line.strip()):
                block.append(line.strip())
                continue
            if key:
                found[key] = (" " if folded else "\n").join(block).strip()
                key = None
            if line.strip() == "---":
                break
            name, colon, value = line.partition(":")
            value = value.strip()
            if not colon or line.startswith((" ", "\t", "-")):
                continue
            if value[:1] in ("|", ">"):
                key, block, folded = name.strip(), [], value[0] == ">"
            else:
                found.setdefault(name.strip(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value)
    return tuple(found.get(k) or None for k in ("name", "description", "version"))


def installed_skills(spark: SparkSession, roots: dict[str, str], provider: str = "claude") -> DataFrame:
    """SKILL.md files under roots by source (user, plugin, system); the folder names a skill without a name."""

    @F.pandas_udf(SKILL_FILE)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([frontmatter(t) for t in texts], columns=["name", "description", "version"])

    found = None
    for source, root in roots.items():
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "SKILL.md").text(root, wholetext=True)
        path = F.col("_metadata.file_path")
        parts = F.split(path, "/")
        at = F.array_position(parts, "skills").cast("int")
        plugin = F.when(F.lit(source == "plugin") & (at > 2), F.element_at(parts, F.greatest(at - 2, F.lit(1))))
        rows = raw.select(path.alias("source_path"), parsed("value").alias("f"), F.regexp_extract(path, r"([^/]+)/SKILL\.md$", 1).alias("folder"), plugin.alias("plugin"))
        rows = rows.select(F.coalesce("f.name", "folder").alias("name"), "f.description", F.lit(provider).alias("provider"), F.lit(source).alias("source"), "source_path", "f.version", "plugin")
        found = rows if found is None else found.unionByName(rows)
    return found
