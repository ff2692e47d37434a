"""The assistants as one listing: a registry of sources, and unions over those that are asked for.

A provider names a builder per entity; an entity that it does not keep has none and gives
no rows.  Every builder returns the entity's columns, so a union needs no more than names.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import new_folder
from tracelake.functions.text import clean_folder, same_folder
from tracelake.sources import jsonl, stores
from tracelake.sources.sqlite import unreadable

ENTITIES = {
    "sessions": "provider string, session_id string, cwd string, started_at timestamp, event_count long, source_path string, title string",
    "usage": "provider string, session_id string, cwd string, ts timestamp, model string, input_tokens long, output_tokens long, cache_creation_input_tokens long, "
    "cache_read_input_tokens long, reasoning_output_tokens long, source_path string",
    "skills": "skill_name string, provider string, cwd string, ts timestamp, source_path string, is_gstack boolean",
    "questions": "question string, options array<string>, recommended_option string, chosen_option string, notes string, ts timestamp, cwd string, provider string, session_id string, "
    "source_path string, tool_use_id string",
    "installed": "name string, description string, provider string, source string, source_path string, version string, plugin string",
}


@dataclass(frozen=True)
class Provider:
    """Builders by entity, each from a session and an optional folder (a hint for pruning) to a DataFrame."""

    name: str
    builders: dict[str, Callable[[SparkSession, str | None], DataFrame]] = field(default_factory=dict)


class Missing(FileNotFoundError):
    """A source that is not there, so it has no rows."""


def there(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths that are there, one at least."""
    found = jsonl.existing(spark, *paths)
    if not found:
        raise Missing(f"{', '.join(paths) or 'its path'} is not there")
    return found


def store(path: str) -> str:
    """The path of a store that is there; its readers open it themselves."""
    try:
        os.stat(path)
    except FileNotFoundError:
        raise Missing(f"{path} is not there") from None
    return path


def chosen(providers: Iterable[Provider], names: Iterable[str] = ()) -> list[Provider]:
    """Providers of the names, whatever their case; all of them without names."""
    wanted = {n.lower() for n in names}
    return [p for p in providers if not wanted or p.name.lower() in wanted]


def union(spark: SparkSession, providers: Iterable[Provider], entity: str, names: Iterable[str] = (), cwd: str | None = None, ignore_case: bool = False, failed: list[tuple[str, Exception]] | None = None) -> DataFrame:
    """Rows of an entity over the chosen providers, of one folder if given.

    A provider whose source is not there has no rows and is left out with a warning.  One
    that fails otherwise, by a broken or locked store or in a job, fails the union, as the
    others' rows would look like all; a caller who wants them all the same gives a list
    ``failed``, which gets the names and errors.  Rows are written to the shared folder and
    read from there, so each builder runs once, to its end, and fails here and not later.
    """
    schema = ENTITIES[entity]
    columns = [c.split()[0] for c in schema.split(", ")]
    found = []
    for p in chosen(providers, names):
        if entity not in p.builders:
            continue
        try:
            rows = p.builders[entity](spark, cwd).select(columns)
            if cwd is not None and "cwd" in columns:
                rows = rows.where(same_folder(F.col("cwd"), cwd, ignore_case))
            kept = new_folder(spark, f"{entity}-{p.name}")
            rows.write.parquet(kept)
        except Missing as error:
            warnings.warn(f"provider {p.name} is left out: {error}", stacklevel=2)
            continue
        except Exception as error:
            if failed is None:
                error.add_note(f"provider {p.name} could not be read")
                raise
            failed.append((p.name, error))
            continue
        found.append(spark.read.schema(rows.schema).parquet(kept))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def encoded(cwd: str) -> str:
    """Name of a folder's transcripts: slashes become dashes, so other folders may share it or begin with it."""
    return clean_folder(cwd).replace("/", "-")


def _glob(text: str) -> str:
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in text)


def transcripts(spark: SparkSession, root: str, cwd: str | None) -> DataFrame:
    """Lines of transcripts; with a folder only those directories are listed whose names begin with its encoding, if any do."""
    there(spark, root)
    return jsonl.scan_lines(spark, f"{root}/{_glob(encoded(cwd))}*" if cwd else root)


def installed(roots: dict[str, str], provider: str) -> Callable[[SparkSession, str | None], DataFrame]:
    """Skill files under those of the roots that are there."""

    def build(spark: SparkSession, _: str | None) -> DataFrame:
        found = there(spark, *roots.values())
        return stores.installed_skills(spark, {source: root for source, root in roots.items() if root in found}, provider)

    return build


def claude(root: str, skill_roots: dict[str, str] | None = None) -> Provider:
    lines = lambda f: lambda spark, cwd: f(transcripts(spark, root, cwd))
    builders = {"sessions": lines(jsonl.claude_sessions), "usage": lines(jsonl.claude_usage), "skills": lines(jsonl.claude_skills), "questions": lines(jsonl.claude_questions)}
    if skill_roots:
        builders["installed"] = installed(skill_roots, "claude")
    return Provider("claude", builders)


def either(first: Callable[[SparkSession, str | None], DataFrame], second: Callable[[SparkSession, str | None], DataFrame], broken: bool = True) -> Callable[[SparkSession, str | None], DataFrame]:
    """The first source, or the second where the first is missing or, if ``broken`` allows, a store that cannot be read to its end; never parts of both.

    All other failures are errors, as is a broken store without a second source.
    """

    def build(spark: SparkSession, cwd: str | None) -> DataFrame:
        try:
            rows = first(spark, cwd)
            if broken:
                rows.count()
        except Exception as error:
            missing = isinstance(error, Missing) or isinstance(error, PySparkException) and error.getCondition() == "PATH_NOT_FOUND"
            if not missing and not (broken and unreadable(error)):
                raise
            try:
                rows = second(spark, cwd)
            except Missing:
                raise error from None
            warnings.warn(f"falling back: {str(error).splitlines()[0]}", stacklevel=2)
        return rows

    return build


def codex(rollouts: list[str], threads: str | None = None, skill_roots: dict[str, str] | None = None) -> Provider:
    """Rollout files under roots such as sessions and archived_sessions, of which some may be missing, and the thread store where there is one."""
    lines = lambda spark: jsonl.read_lines(spark, *there(spark, *rollouts))
    rolled = lambda spark, _: jsonl.codex_sessions(jsonl.read_lines(spark, *there(spark, *rollouts), pattern="rollout-*.jsonl"))
    sessions = either(lambda spark, _: stores.codex_threads(spark, store(threads)), rolled) if threads else rolled
    marked = lambda spark, _: jsonl.codex_skills(jsonl.read_lines(spark, *there(spark, *rollouts), pattern="rollout-*.jsonl"))
    skills = either(lambda spark, _: stores.codex_thread_skills(spark, store(threads)), marked, broken=False) if threads else marked
    builders = {"sessions": sessions, "usage": lambda spark, _: jsonl.codex_usage(lines(spark)), "skills": skills}
    if skill_roots:
        builders["installed"] = installed(skill_roots, "codex")
    return Provider("codex", builders)


def opencode(path: str, skill_roots: dict[str, str] | None = None) -> Provider:
    builders = {"sessions": lambda spark, _: stores.opencode_sessions(spark, store(path)), "usage": lambda spark, _: stores.opencode_usage(spark, store(path))}
    if skill_roots:
        builders["installed"] = installed(skill_roots, "opencode")
    return Provider("opencode", builders)


def cursor(global_db: str, workspace_dir: str) -> Provider:
    """Cursor's stores, none of which is skipped: one that stays locked is an error."""
    return Provider("cursor", {
        "sessions": lambda spark, _: stores.cursor_sessions(spark, store(global_db), workspace_dir, skip_locked=False)[0],
        "usage": lambda spark, _: stores.cursor_usage(spark, store(global_db), workspace_dir, skip_locked=False),
    })


def run_query(spark: SparkSession, providers: Iterable[Provider], entity: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, order: list[Column] | None = None, sink: Callable[[DataFrame], object] | None = None, names: Iterable[str] = (), cwd: str | None = None, failed: list[tuple[str, Exception]] | None = None):
    """A listing from end to end: union, transformation, order and sink; without a sink the DataFrame itself."""
    rows = transform(union(spark, providers, entity, names, cwd, failed=failed))
    rows = rows.orderBy(*order) if order else rows
    return sink(rows) if sink else rows
