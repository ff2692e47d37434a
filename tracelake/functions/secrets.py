"""Column builders for secret detection, suppression, redaction and fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import dims
from tracelake.functions.automaton import raw_hits

def redact(c: Column) -> Column:
    """Short values become dots; others keep up to four characters at each end."""
    n = F.length(c)
    keep = F.least(F.lit(4), F.floor(n / 4).cast("int"))
    return F.when(n <= 8, F.repeat(F.lit("…"), n)).otherwise(F.concat(F.left(c, keep), F.lit("…REDACTED…"), F.right(c, keep)))


def fingerprint(category: Column, snippet: Column) -> Column:
    return F.substring(F.sha1(F.concat(category, F.lit(":"), snippet).cast("binary")), 1, 16)


def character_runs(c: Column) -> Column:
    """How often each distinct character occurs, from the runs of the sorted characters."""
    ordered = F.array_join(F.sort_array(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))), "")
    return F.transform(F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0)), lambda r: F.length(r))


def entropy_of(runs: Column, length: Column) -> Column:
    """Bits per character of a text with such runs."""
    n = length.cast("double")
    return F.aggregate(runs, F.lit(0.0), lambda total, r: total - r / n * F.log2(r / n))


def shannon_entropy(c: Column) -> Column:
    """Bits per character."""
    return entropy_of(character_runs(c), F.length(c))


def unique_chars(c: Column) -> Column:
    return F.size(character_runs(c))


def _reserved(value: Column, domain: Column) -> Column:
    found = domain.isin(*dims.RESERVED_DOMAINS)
    for suffix in (*[f".{d}" for d in dims.RESERVED_DOMAINS], *dims.RESERVED_SUFFIXES):
        found = found | domain.endswith(suffix)
    return found


#: Rules by name, the first that holds counts: from a value, its domain, its local part (lower case), and whether a backslash stands before it.
SUPPRESSORS: tuple[tuple[str, Callable[[Column, Column, Column, Column], Column]], ...] = (
    ("escape_prefix", lambda value, domain, local, escaped: escaped),
    ("reserved_email_domain", lambda value, domain, local, escaped: value.contains("@") & _reserved(value, domain)),
    ("noreply_local_part", lambda value, domain, local, escaped: value.contains("@") & local.isin(*dims.NOREPLY)),
    ("placeholder_email_domain", lambda value, domain, local, escaped: value.contains("@") & domain.isin(*dims.PLACEHOLDER_DOMAINS)),
)


def suppressed_by(value: Column, escaped: Column) -> Column:
    """Name of the first rule that takes a match for a false positive, or null."""
    domain, local = (F.lower(F.substring_index(value, "@", n)) for n in (-1, 1))
    found = F.lit(None).cast("string")
    for name, rule in reversed(SUPPRESSORS):
        found = F.when(rule(value, domain, local, escaped), name).otherwise(found)
    return found


def pinned(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are worked out once per row: no filter or projection behind can be moved before them."""
    one = F.explode(F.array(F.struct(*columns))).alias("_pinned")
    return df.select("*", one).select("*", "_pinned.*").drop("_pinned")


def judged(rows: DataFrame, min_confidence: int = 7) -> DataFrame:
    """Rows of (category, confidence, raw) with value, final confidence and the rule that suppresses them, if any."""
    escaped = F.col("raw").startswith("\\")
    found = rows.withColumn("value", F.when(escaped, F.substring("raw", 2, 1 << 30)).otherwise(F.col("raw"))).withColumn("escaped", escaped)
    if min_confidence > 6:
        return found.withColumn("suppressed_by", suppressed_by(F.col("value"), F.col("escaped"))).drop("raw", "escaped")
    random = F.col("category") == "high_entropy"
    found = pinned(found, F.when(random & ~F.col("value").rlike(dims.ENTROPY_SKIP), character_runs(F.col("value"))).alias("runs"))
    found = pinned(found, F.when(F.size("runs") >= dims.ENTROPY_MIN_UNIQUE, entropy_of(F.col("runs"), F.length("value"))).alias("bits"))
    band = F.lit(0)
    for least, confidence in reversed(dims.ENTROPY_BANDS):
        band = F.when(F.col("bits") >= least, F.lit(confidence)).otherwise(band)
    found = found.withColumn("confidence", F.when(random, band).otherwise(F.col("confidence"))).where(F.col("confidence") >= max(min_confidence, 4))
    return found.withColumn("suppressed_by", suppressed_by(F.col("value"), F.col("escaped"))).drop("raw", "escaped", "runs", "bits")


def hits(lines: DataFrame, min_confidence: int = 7, once: bool = False, text: str = "line", carry: list[str] | None = None, limit: int | None = None, split: bool = False) -> DataFrame:
    """A row (category, value, confidence, start, suppressed_by) beside the columns ``carry`` (all) for each hit; see ``raw_hits``."""
    return judged(raw_hits(lines, text, lines.columns if carry is None else carry, min_confidence, once, limit, split), min_confidence)


def contexts(lines: DataFrame, min_confidence: int = 7, around: int = 200) -> DataFrame:
    """Unsuppressed vendor hits with the text around them: context_before, match_full, context_after, raw_line.

    Of equal strings in a line each is met where it stands.
    """
    rows = hits(lines, max(min_confidence, 7)).where("suppressed_by is null")
    low = F.greatest(F.col("start") - around, F.lit(0))
    return rows.select(
        "*", F.substring("line", low + 1, F.col("start") - low).alias("context_before"), F.col("value").alias("match_full"),
        F.substring("line", F.col("start") + F.length("value") + 1, F.lit(around)).alias("context_after"), F.col("line").alias("raw_line"),
    ).drop("line", "value")
