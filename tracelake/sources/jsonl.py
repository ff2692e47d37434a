"""Line-delimited JSON transcripts as typed DataFrames.

Lines are parsed to VARIANT once; a malformed line is NULL and simply matches nothing,
but still counts as a line.  Rows seen before a file's first folder get it afterwards,
through an aggregate per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.text import answer_map, command_names, is_recommended, leading_skill, normalize_skill_name, normalize_title, real_title, recommended_label, is_suite_skill


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """The paths, files, folders or patterns, that are there."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    there = lambda at, fs: fs.exists(at) or bool(len(fs.globStatus(at) or ()))
    return [p for p in paths if there(path(p), path(p).getFileSystem(conf))]


def scan_lines(spark: SparkSession, *roots: str) -> DataFrame:
    """Lines of transcripts under roots that may be files or folders; missing ones are skipped."""
    found = existing(spark, *roots)
    return read_lines(spark, *found) if found else spark.createDataFrame([], "file string, line_no int, line string")


def read_lines(spark: SparkSession, *paths: str, pattern: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(file, line_no, line) of every non-blank line under the paths, or right in them; numbers start at 1 in each file.

    Lines are numbered inside the block of a file that one task reads, and shifted by the
    lines of the blocks before, so a long file is not one task's work.  Only files that
    are long enough to be cut are read for their blocks' lines.  How Spark cuts a file depends
    on all files of a scan, so both scans of the long ones have these files and no others.
    """
    raw = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(list(paths))
    size, place = F.col("_metadata.file_size"), [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    conf = spark._jsparkSession.sessionState().conf()
    whole = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())  # Spark cuts no file of up to so many bytes
    short, long = raw.where(size <= whole), raw.where(size > whole)
    blocks = long.select(*place).groupBy("file", "block").agg(F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    numbered = lambda rows: rows.select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")).withColumn("n", inside)
    every = numbered(short).withColumn("start", F.lit(None).cast("long")).unionByName(numbered(long).join(starts, ["file", "block"], "left"))
    start = F.coalesce("start", F.when(F.col("block") == 0, F.lit(0)).otherwise(F.raise_error(F.lit("the size of partitions of files changed")).cast("long")))
    return every.select("file", (start + F.col("n")).cast("int").alias("line_no"), "line").where(F.trim("line") != "")


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def integer(v: str | Column, path: str) -> Column:
    """A JSON number as long (fractions cut off); strings and booleans count as 0."""
    text_kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = F.coalesce(get(v, path, "bigint"), get(v, path, "double").cast("long"))
    return F.when(text_kind.isin("STRING", "BOOLEAN"), F.lit(0)).otherwise(F.coalesce(number, F.lit(0))).cast("long")


def timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def events(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("line")).withColumn("type", get("v", "$.type"))


def content_text(v: str = "v") -> Column:
    """Message text: a string, or the first text block of an array."""
    kind = F.schema_of_variant(get(v, "$.message.content", "variant"))
    blocks = get(v, "$.message.content", "array<variant>")
    first = F.try_element_at(F.filter(blocks, lambda b: get(b, "$.type") == "text"), F.lit(1))
    return F.when(kind == "STRING", get(v, "$.message.content")).when(kind.startswith("ARRAY"), get(first, "$.text"))


def session_id() -> Column:
    return F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)


def with_folder(rows: DataFrame) -> DataFrame:
    """Adds the file's folder, from its first line that has one, wherever that line is."""
    found = rows.groupBy("file").agg(F.min_by("own_cwd", F.when(F.col("own_cwd").isNotNull(), F.col("line_no"))).alias("cwd"))
    return rows.join(found, "file")


def claude_sessions(lines: DataFrame) -> DataFrame:
    """One row per file that has a folder: first folder with its time, lines, title."""
    e = events(lines)
    cwd = F.nullif(get("v", "$.cwd"), F.lit(""))
    told = F.when(F.col("type") == "ai-title", F.nullif(normalize_title(get("v", "$.aiTitle")), F.lit("")))
    said = F.when(F.col("type") == "user", real_title(content_text()))
    at = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    grouped = e.groupBy("file").agg(
        F.min_by(F.struct(cwd.alias("cwd"), timestamp(get("v", "$.timestamp")).alias("ts")), at(cwd)).alias("s"), F.count("*").alias("event_count"),
        F.coalesce(F.min_by(told, at(told)), F.min_by(said, at(said))).alias("title"),
    ).where("s is not null")
    return grouped.select(F.lit("claude").alias("provider"), session_id().alias("session_id"), "s.cwd", F.col("s.ts").alias("started_at"), "event_count", F.col("file").alias("source_path"), "title")


def claude_usage(lines: DataFrame) -> DataFrame:
    """Every assistant usage event; files without a folder keep theirs with a null one."""
    e = events(lines).withColumn("own_cwd", F.nullif(get("v", "$.cwd"), F.lit("")))
    used = with_folder(e).where((F.col("type") == "assistant") & get("v", "$.message.usage", "variant").isNotNull())
    counts = [integer("v", f"$.message.usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    return used.select(
        F.lit("claude").alias("provider"), session_id().alias("session_id"), "cwd", timestamp(get("v", "$.timestamp")).alias("ts"), get("v", "$.message.model").alias("model"), *counts,
        F.lit(0).cast("long").alias("reasoning_output_tokens"), F.col("file").alias("source_path"),
    )


def claude_skills(lines: DataFrame) -> DataFrame:
    """One row per command marker of a user message, in files with a folder."""
    e = events(lines).withColumn("own_cwd", F.nullif(get("v", "$.cwd"), F.lit("")))
    rows = with_folder(e).where((F.col("type") == "user") & F.col("cwd").isNotNull())
    marked = rows.select("file", "cwd", timestamp(get("v", "$.timestamp")).alias("ts"), F.explode(command_names(content_text())).alias("raw_name"))
    return marked.select(normalize_skill_name(F.col("raw_name")).alias("skill_name"), F.lit("claude").alias("provider"), "cwd", "ts", F.col("file").alias("source_path"), is_suite_skill(F.col("raw_name")).alias("is_gstack"), "raw_name").where("skill_name <> ''")


ASK = r"^(AskUserQuestion|mcp__.*__AskUserQuestion)$"


def claude_questions(lines: DataFrame) -> DataFrame:
    """Questions asked through the ask tool with their answers; unanswered ones stay.

    Answers are found by tool id (the last result of an id counts) and, within it, by
    the normalized question.
    """
    e = events(lines).withColumn("own_cwd", F.nullif(get("v", "$.cwd"), F.lit("")))
    rows = with_folder(e).where("cwd is not null")
    blocks = rows.select("file", "line_no", "cwd", "type", timestamp(get("v", "$.timestamp")).alias("ts"), F.posexplode(get("v", "$.message.content", "array<variant>")).alias("pos", "b"))
    asks = blocks.where((F.col("type") == "assistant") & (get("b", "$.type") == "tool_use") & get("b", "$.name").rlike(ASK))
    asks = asks.select("file", "cwd", "ts", "line_no", get("b", "$.id").alias("tool_use_id"), F.posexplode(get("b", "$.input.questions", "array<variant>")).alias("q_no", "q"))
    kind = F.schema_of_variant(get("b", "$.content", "variant"))
    parts = F.transform(F.filter(get("b", "$.content", "array<variant>"), lambda x: get(x, "$.type") == "text"), lambda x: get(x, "$.text"))
    answer = F.when(kind == "STRING", get("b", "$.content")).otherwise(F.array_join(parts, "\n"))
    results = blocks.where((F.col("type") == "user") & (get("b", "$.type") == "tool_result")).select("file", "line_no", "pos", get("b", "$.tool_use_id").alias("tool_use_id"), answer.alias("answer"))
    last = results.groupBy("file", "tool_use_id").agg(F.max_by("answer", F.struct("line_no", "pos")).alias("answer"))
    labels = F.filter(F.transform(get("q", "$.options", "array<variant>"), lambda o: get(o, "$.label")), lambda x: x.isNotNull())
    first = F.try_element_at(F.filter(labels, is_recommended), F.lit(1))
    question = normalize_title(get("q", "$.question"))
    notes = F.nullif(F.trim(F.regexp_extract("answer", r'(?i)Other:\s*([^\n"]+)', 1)), F.lit(""))
    return asks.join(last, ["file", "tool_use_id"], "left").where(question != "").select(
        question.alias("question"), F.transform(labels, recommended_label).alias("options"), F.when(first.isNotNull(), recommended_label(first)).alias("recommended_option"),
        F.try_element_at(answer_map(F.coalesce("answer", F.lit(""))), question).alias("chosen_option"), notes.alias("notes"), "ts", "cwd", F.lit("claude").alias("provider"), session_id().alias("session_id"),
        F.col("file").alias("source_path"), "tool_use_id", "line_no", "q_no",
    )


def codex_sessions(lines: DataFrame) -> DataFrame:
    """Rollout files whose first line is valid meta data with a folder."""
    e = events(lines)
    first = F.col("line_no") == 1
    meta = F.when(first & (F.col("type") == "session_meta"), F.struct(get("v", "$.payload.id").alias("id"), get("v", "$.payload.cwd").alias("cwd"), timestamp(F.coalesce(get("v", "$.payload.timestamp"), get("v", "$.timestamp"))).alias("ts")))
    said = F.when((F.col("type") == "event_msg") & (get("v", "$.payload.type") == "user_message"), F.nullif(normalize_title(get("v", "$.payload.message")), F.lit("")))
    grouped = e.groupBy("file").agg(F.max(meta).alias("m"), F.min_by(said, F.when(said.isNotNull(), F.col("line_no"))).alias("title"), F.count("*").alias("event_count"))
    return grouped.where(F.coalesce("m.cwd", F.lit("")) != "").select(F.lit("codex").alias("provider"), F.col("m.id").alias("session_id"), "m.cwd", F.col("m.ts").alias("started_at"), "event_count", F.col("file").alias("source_path"), "title")


def codex_skills(lines: DataFrame) -> DataFrame:
    """Rollout files with a folder in their first line whose first message begins with a skill marker; of files of one name the last by path, a live one before an archived one."""
    e = events(lines)
    meta = F.when(F.col("line_no") == 1, F.struct(get("v", "$.payload.cwd").alias("cwd"), timestamp(F.coalesce(get("v", "$.payload.timestamp"), get("v", "$.timestamp"))).alias("ts")))
    message = get("v", "$.payload.message")
    said = F.when((F.col("line_no") > 1) & (F.col("type") == "event_msg") & (get("v", "$.payload.type") == "user_message") & message.rlike(r"\S"), message)
    grouped = e.groupBy("file").agg(F.max(meta).alias("m"), F.min_by(said, F.when(said.isNotNull(), F.col("line_no"))).alias("said")).where(F.coalesce("m.cwd", F.lit("")) != "")
    raw = leading_skill("said")
    rows = grouped.select(normalize_skill_name(raw).alias("skill_name"), F.lit("codex").alias("provider"), "m.cwd", "m.ts", F.col("file").alias("source_path"), is_suite_skill(raw).alias("is_gstack")).where("skill_name <> ''")
    name = F.regexp_extract("source_path", r"([^/]+)\.jsonl$", 1)
    return rows.groupBy(name.alias("name")).agg(F.max_by(F.struct(*rows.columns), "source_path").alias("r")).select("r.*")


def codex_usage(lines: DataFrame) -> DataFrame:
    """One row per file: the last cumulative counters by position, with the first model and folder."""
    e = events(lines)
    total = "$.payload.info.total_token_usage"
    counter = (F.col("type") == "event_msg") & (get("v", "$.payload.type") == "token_count") & get("v", total, "variant").isNotNull()
    fields = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
    at = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    model = F.when(F.col("type") == "turn_context", get("v", "$.payload.model"))
    cwd, sid = (F.when(F.col("type") == "session_meta", get("v", f"$.payload.{x}")) for x in ("cwd", "id"))
    last = F.when(counter, F.struct(*[integer("v", f"{total}.{f}").alias(f) for f in fields], timestamp(get("v", "$.timestamp")).alias("ts")))
    grouped = e.groupBy("file").agg(F.max_by(last, at(last)).alias("u"), *[F.min_by(c, at(c)).alias(n) for c, n in ((model, "model"), (cwd, "cwd"), (sid, "session_id"))]).where("u is not null")
    return grouped.select(
        F.lit("codex").alias("provider"), "session_id", "cwd", "u.ts", "model", F.greatest(F.col("u.input_tokens") - F.col("u.cached_input_tokens"), F.lit(0)).alias("input_tokens"), "u.output_tokens",
        F.lit(0).cast("long").alias("cache_creation_input_tokens"), F.col("u.cached_input_tokens").alias("cache_read_input_tokens"), "u.reasoning_output_tokens", F.col("file").alias("source_path"),
    )


def question_log(lines: DataFrame) -> DataFrame:
    """Logged answers (timestamp, skill, question_id, user_choice, recommended); rows without a time go."""
    v = F.try_parse_json("line")
    ts = timestamp(F.coalesce(get(v, "$.ts"), get(v, "$.timestamp"), get(v, "$.date")))
    return lines.select(ts.alias("ts"), *[get(v, f"$.{c}").alias(c) for c in ("skill", "question_id", "user_choice", "recommended")]).where("ts is not null")


def timeline(lines: DataFrame) -> DataFrame:
    """Logged skill events (ts, skill, event, outcome); rows without a time go."""
    v = F.try_parse_json("line")
    ts = timestamp(F.coalesce(get(v, "$.ts"), get(v, "$.timestamp")))
    return lines.select(ts.alias("ts"), *[get(v, f"$.{c}").alias(c) for c in ("skill", "event", "outcome")]).where("ts is not null")
