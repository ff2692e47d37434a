"""Column builders for text, names, labels and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.dims import RECOMMENDED_WORDS

# Beginnings of injected messages, and the suffix of a recommended label.
INJECTED_PREFIXES = ("<command-", "<local-command-", "<system-reminder>", "Caveat:", "[Request interrupted")
RECOMMENDED = r"(?iU)\s*[\(\[]\s*(?:" + "|".join(RECOMMENDED_WORDS) + r")\s*[\)\]]\s*\.?\s*$"


def normalize_title(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_skill_name(c: Column) -> Column:
    """Trimmed, without one leading slash and the suite prefix."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^/", ""), "^gstack-", "")


def is_suite_skill(c: Column) -> Column:
    return F.trim(c).rlike("^/?gstack-")


def leading_skill(c: str | Column) -> Column:
    """The name in a skill marker ``[$name]`` that a message begins with, or an empty string."""
    return F.regexp_extract(c, r"^\[\$([^\]]+)\]", 1)


def basename(c: Column) -> Column:
    """Last path segment; null for null or empty paths."""
    return F.nullif(F.regexp_extract(c, r"([^/]+)/*$", 1), F.lit(""))


def recommended_label(c: Column) -> Column:
    """The label without its recommendation suffix."""
    return F.when(c.rlike(RECOMMENDED), F.rtrim(F.regexp_replace(c, RECOMMENDED, ""))).otherwise(c)


def is_recommended(c: Column) -> Column:
    return c.rlike(RECOMMENDED)


def matches_recommended(chosen: Column, recommended: Column) -> Column:
    """Whether one of the comma-separated choices is the recommended label."""
    return F.exists(F.split(chosen, ","), lambda x: F.trim(x) == F.trim(recommended))


def real_title(text: Column) -> Column:
    """The text as a title, or null if blank or injected by the tool."""
    title = normalize_title(text)
    injected = F.lit(False)
    for prefix in INJECTED_PREFIXES:
        injected = injected | title.startswith(prefix)
    return F.when((title != "") & ~injected, title)


def command_names(text: Column) -> Column:
    """Names in command markers of a message."""
    return F.regexp_extract_all(text, F.lit("<command-name>([^<]+)</command-name>"), F.lit(1))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def relative_time(seconds: Column) -> Column:
    """Age in words: just now, minutes, hours or days ago."""
    s = seconds.cast("long")
    return (
        F.when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d ago")))
    )


def countdown(seconds: Column) -> Column:
    """Whole hours and minutes as XhYm."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.concat(F.floor(s / 3600), F.lit("h"), F.floor(F.pmod(s, F.lit(3600)) / 60), F.lit("m"))


def opencode_model(c: Column) -> Column:
    """Model id and provider from a JSON model description, ``id (provider)``; null if unusable."""
    v = F.try_parse_json(c)
    get = lambda p: F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit(""))
    model, provider = F.coalesce(get("$.id"), get("$.modelID")), get("$.providerID")
    return F.when(model.isNotNull(), F.when(provider.isNotNull(), F.concat(model, F.lit(" ("), provider, F.lit(")"))).otherwise(model))


def answer_map(text: Column) -> Column:
    """question -> answer of quoted pairs, the last of equal questions winning."""
    pair = F.lit(r'"([^"]+)"="([^"]+)"')
    keys = F.transform(F.regexp_extract_all(text, pair, F.lit(1)), normalize_title)
    values = F.transform(F.regexp_extract_all(text, pair, F.lit(2)), lambda x: F.trim(x))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def hour_bucket(hour: Column, granularity: int) -> Column:
    g = granularity if granularity in (1, 2, 3, 4, 6, 8, 12) else 6
    low = F.floor(hour / g) * g
    return F.concat(low.cast("string"), F.lit("-"), (low + g).cast("string"))


def unit_hash(key: Column, salt: int) -> Column:
    """A stable number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def short_id(c: Column) -> Column:
    return F.left(c, F.lit(8))


def local_path(url: Column) -> Column:
    """Path of a file URL as it stands, null for other URLs."""
    return F.when(url.startswith("file://"), F.substring(url, 8, 1 << 20))


def repository_slug(url: Column) -> Column:
    """owner-repository from the last two segments of a remote's URL; null where the owner looks like a host."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.trim(url), r"\.git$", ""), ":", "/"), "/"), lambda x: x != "")
    owner, name = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    return F.when(owner.isNotNull() & ~owner.contains("."), F.concat(owner, F.lit("-"), name))


ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def json_unescape(c: Column) -> Column:
    """Text with its well-formed JSON escapes decoded; broken ones, as at a cut, stay as they are."""
    escape = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
    gaps, found = F.split(c, escape, -1), F.regexp_extract_all(c, F.lit(escape), F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])
    code = lambda m: F.decode(F.unhex(F.substring(m, 3, 4)), "UTF-16BE")
    plain = F.transform(found, lambda m: F.when(m.substr(2, 1) == "u", code(m)).otherwise(F.try_element_at(known, m.substr(2, 1))))
    pairs = F.zip_with(gaps, plain, lambda g, p: F.concat(F.coalesce(g, F.lit("")), F.coalesce(p, F.lit(""))))
    return F.when(F.size(found) == 0, c).otherwise(F.array_join(pairs, ""))


def clean_folder(path: str) -> str:
    return re.sub("(?<=.)/$", "", re.sub("/+", "/", path))


def same_folder(cwd: Column, target: str, ignore_case: bool = False) -> Column:
    """Whether a folder is the wanted one, apart from doubled and trailing slashes, and case where asked."""
    clean = F.regexp_replace(F.regexp_replace(cwd, "/+", "/"), "(?<=.)/$", "")
    wanted = clean_folder(target)
    return F.lower(clean) == wanted.lower() if ignore_case else clean == wanted
