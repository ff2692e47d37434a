"""JSON sinks with fixed field lists: one object a row, times in ISO form, nulls written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of each listing, in order.
FIELDS = {
    "sessions": ("provider", "session_id", "cwd", "started_at", "event_count", "source_path", "title"),
    "skills": ("skill_name", "count_claude", "count_codex", "total", "unique_cwd_count", "last_used", "is_gstack"),
    "installed": ("name", "description", "provider", "source", "source_path", "version", "plugin"),
    "questions": ("question", "options", "recommended_option", "chosen_option", "notes", "ts", "cwd", "provider", "session_id"),
    "scan": ("file", "line_no", "category", "snippet_redacted", "confidence", "full_length", "fingerprint"),
    "cost": ("label", "provider", "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "reasoning_output_tokens", "cost_usd", "event_count", "model"),
    "findings": ("fingerprint", "category", "snippet_redacted", "first_seen", "last_seen", "count", "status", "muted_until", "notes"),
}


def iso(c: Column) -> Column:
    """An instant in ISO form with microseconds and the session's offset."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def objects(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One column ``json``; a field that the rows lack is null."""
    kinds = dict(rows.dtypes)
    shown = [(iso(F.col(f)) if kinds.get(f) == "timestamp" else F.col(f) if f in kinds else F.lit(None).cast("string")).alias(f) for f in fields]
    return rows.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def write(rows: DataFrame, listing: str, path: str) -> None:
    """Line-delimited JSON of a listing under a folder; an ordered input keeps its order over the files' names."""
    objects(rows, FIELDS[listing]).write.mode("overwrite").text(path)


def export_findings(findings: DataFrame, path: str | None = None) -> DataFrame:
    """Findings as line-delimited JSON, oldest sighting first; written by range partitions if a path is given."""
    ordered = objects(findings.orderBy("first_seen", "fingerprint"), FIELDS["findings"])
    if path:
        ordered.write.mode("overwrite").text(path)
    return ordered
