"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Everything here is DataFrame functions.  Base matches of a kind are located by splitting
the text at the pattern: matches and the gaps between them give every start and end.
Every word with a digit is a candidate; the words left and right of it make its lexical
patterns.  Seeds (candidates that are base matches, or long hex strings as secrets) speak
for patterns; seeds of other kinds, and unknown candidates that are also met where no seed
is, speak against them.  Patterns and candidates form a bipartite graph whose scores Spark
iterates to their fixed point.  Candidates in trusted patterns become seeds of the next
generation, so identifiers found through one pattern bring in the next, until no pattern
is added.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.common import Workspace, broadcast_if_small

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# The base patterns with possessive repeats and anchored starts, so they need linear time
# and constant stack on any text.  Runs of digits are maximal, so a card's length is asked
# for in its pattern; the other failing matches are dropped after matching.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}

#: A candidate is a run of letters, digits and inner marks; longer ones than MAX_VALUE are no identifiers.
VALUE = r"[\p{L}\p{N}._+/@~-]{6,}+"
MAX_VALUE = 128
SECRET = r"^[0-9a-f]{32,64}$"
#: Characters on each side that patterns are made of.
CONTEXT = 64
#: Seeds that a trusted pattern has at least.
MIN_SEEDS = 5
SHRINK = 4.0
#: What an unknown value that is met nowhere else counts against its pattern, of a seed: patterns of which a twentieth are seeds are still trusted.
PRIOR = 0.02
#: Values of a pattern without seeds from which on it is a place of doubt rather than a gap in what is known.
DOUBT = 10.0
TRUST = 0.6
#: Scores that change by less are at their fixed point.
CHANGE = 0.01
#: What a pattern and its scores take in a hash table, at most.
PATTERN_BYTES = 512
BLOCK = 64
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """Per element the joined elements before it (0 for none), in blocks of BLOCK, so that time is about linear."""
    total = lambda block: F.aggregate(block, F.lit(0), join)
    if not levels:
        append = lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x)))
        return F.aggregate(values, F.array(F.lit(0)), append)
    last = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))

    def inside(found: Column) -> Column:
        before = lambda own, b: F.transform(own, lambda _, i: join(F.get(found["before"], b), total(F.slice(own, 1, i))))
        return F.flatten(F.transform(found["blocks"], before))

    return let(blocks, lambda cut: let(F.struct(cut.alias("blocks"), running(F.transform(cut, total), join, levels - 1).alias("before")), inside))


def located(text: Column, pattern: str, needs: str) -> Column:
    """Array of (start, end, m, left, right) of a pattern's matches, leftmost and non-overlapping, in code points.

    ``left`` and ``right`` are up to CONTEXT characters between a match and its neighbours.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def one(s: Column, m: Column, i: Column) -> Column:
        gap = F.get(s["gaps"], i)
        return F.struct(F.length(gap).alias("g"), F.length(m).alias("n"), m.alias("m"), F.right(gap, F.lit(CONTEXT)).alias("left"), F.left(F.get(s["gaps"], i + 1), F.lit(CONTEXT)).alias("right"))

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda x: x["g"] + x["n"]), lambda a, b: a + b)
        return F.zip_with(pairs, F.slice(before, 1, F.size(pairs)), lambda x, at: F.struct(
            (at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("end"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))

    every = let(parts, lambda s: let(F.transform(s["found"], lambda m, i: one(s, m, i)), placed))
    none = F.array().cast("array<struct<start:int,end:int,m:string,left:string,right:string>>")
    return F.when(text.rlike(needs), every).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string's Luhn sum is a multiple of ten."""
    each = F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)))

    def part(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (i % 2 + 1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(each, part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(located(text, PATTERNS[kind], NEEDS[kind]), lambda x: _valid(kind, x["m"]))
    return F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def patterns_of(left: Column, right: Column) -> Column:
    """Lexical patterns of a place: the last word, the last two words, the last and the next word, the next two words.

    Words are in lower case with digits as 0; what stands between them and the place
    counts without white space and quotes.  A place without the words lacks the pattern.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s\"']+", " "), "[0-9]", "0")
    tail = lambda words: F.regexp_extract(bare(left), rf"((?:[\p{{L}}\p{{N}}_]+[^\p{{L}}\p{{N}}_]*){{{words}}})$", 1)
    head = lambda words: F.regexp_extract(bare(right), rf"^((?:[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+){{{words}}})", 1)
    tight = lambda c: F.regexp_replace(F.trim(c), r" ?([^\p{L}\p{N}_ ]) ?", "$1")
    one, two, next_one, next_two = tight(tail(1)), tight(tail(2)), tight(head(1)), tight(head(2))
    full = lambda name, *parts: F.when(F.least(*[F.length(p) for p in (*parts, *parts)]) > 0, F.concat_ws(" ", F.lit(name), *parts))
    return F.array_compact(F.array(full("L", one), full("LL", two), full("LR", one, next_one), full("RR", next_two)))


def occurrences(text: Column) -> Column:
    """Array of (value, start, end, left, right) of every candidate: a word of 6 to MAX_VALUE characters with a digit."""
    cut = lambda x: F.struct(
        F.regexp_replace(x["m"], r"[.~/-]+$", "").alias("value"), x["start"].alias("start"), x["left"].alias("left"), x["right"].alias("right"))
    likely = lambda x: x["value"].rlike("[0-9]") & F.length(x["value"]).between(6, MAX_VALUE)
    found = F.filter(F.transform(located(text, VALUE, "[0-9]"), cut), likely)
    return F.transform(found, lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["left"].alias("left"), x["right"].alias("right")))


def seed_kind(value: Column) -> Column:
    """Kind of a value that is an identifier in itself, else null."""
    found = F.lit(None).cast("int")
    for kind in reversed(BASE_KINDS):
        whole = F.regexp_extract(value, f"^(?:{PATTERNS[kind]})$", 0)
        found = F.when((F.length(whole) > 0) & _valid(kind, whole), F.lit(KINDS.index(kind))).otherwise(found)
    return F.coalesce(found, F.when(value.rlike(SECRET), F.lit(KINDS.index("secret"))))


def _scores(pairs: DataFrame) -> DataFrame:
    """(pattern, seeds, values, c0...) of rows (pattern, value, kind, against): seeds against other seeds, doubts and the prior."""
    kinds = range(len(KINDS))
    own = lambda k: F.count_if(F.col("kind") == k)
    sums = pairs.groupBy("pattern").agg(
        F.count("kind").alias("seeds"), F.count("*").alias("values"), F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.greatest("against", F.lit(PRIOR)))), F.lit(0.0)).alias("doubts"), *[own(k).alias(f"s{k}") for k in kinds])
    return sums.select("pattern", "seeds", "values", *[(F.col(f"s{k}") / (F.col("seeds") + F.col("doubts") + SHRINK)).alias(f"c{k}") for k in kinds])


def generation(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """Trusted patterns (pattern, pattern_kind, trust) of distinct edges (pattern, value, kind, left); a null kind is not known yet.

    A pattern's score for a kind is the share of that kind's seeds in all that it holds:
    other seeds count whole, an unknown value counts as much as it is doubtful, PRIOR at
    least, and SHRINK is added.  A value is as doubtful as the worst of the places where
    it is met otherwise.  A place is the word to the left of a value (``left``, the
    pattern of one word); its doubt is what its best score lacks, times the weight of its
    number of values.  Scores and doubts depend on each other and are iterated: scores
    only fall from round to round, so they end at a fixed point, up to CHANGE.
    """
    kinds = range(len(KINDS))
    top = F.greatest(*[F.col(f"c{k}") for k in kinds])
    scores, before = None, None
    for n in itertools.count():
        if scores is None:
            pairs = edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.lit(0.0).alias("against"))
        else:
            places = scores.where(F.col("pattern").startswith("L ")).select(F.col("pattern").alias("left"), ((1 - top) * F.col("values") / (F.col("values") + DOUBT)).alias("doubt"))
            free = workspace.keep(f"{name}-free{n}", edges.where("kind is null and left is not null").select("value", "left").distinct().join(broadcast_if_small(places, PATTERN_BYTES), "left"))
            worst = free.groupBy("value").agg(F.max(F.struct("doubt", "left")).alias("w"))
            other = free.join(worst, "value").where(F.col("left") != F.col("w.left")).groupBy("value").agg(F.max("doubt").alias("next"))
            worst = workspace.keep(f"{name}-worst{n}", worst.join(other, "value", "left").select("value", F.col("w.doubt").alias("doubt"), F.col("w.left").alias("worst"), F.coalesce("next", F.lit(0.0)).alias("next")))
            met = edges.join(worst, "value", "left")
            against = F.when(F.col("left") == F.col("worst"), F.col("next")).otherwise(F.col("doubt"))  # not by its own place
            pairs = met.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.coalesce(F.min(against), F.lit(0.0)).alias("against"))
        before, scores = scores, workspace.keep(f"{name}-scores{n}", _scores(pairs))
        if before is not None:
            old = before.select("pattern", *[F.col(f"c{k}").alias(f"o{k}") for k in kinds])
            moved = scores.join(old, "pattern").where(F.greatest(*[F.abs(F.col(f"c{k}") - F.col(f"o{k}")) for k in kinds]) >= CHANGE)
            if not moved.limit(1).count():
                break
    kind = F.coalesce(*[F.when(F.col(f"c{k}") == top, F.lit(k)) for k in kinds])
    return scores.where((F.col("seeds") >= MIN_SEEDS) & (top >= TRUST)).select("pattern", kind.alias("pattern_kind"), top.alias("trust"))


def bootstrap(graph: DataFrame, workspace: Workspace) -> DataFrame:
    """Trusted patterns (pattern, pattern_kind, trust) of a graph of distinct (pattern, value, seed, left) rows.

    Generations follow until one adds no pattern: values in trusted patterns are seeds of
    the next one, with the kind of the most trusted.  A pattern once trusted stays so.
    Patterns of under MIN_SEEDS values can never be trusted and are left out.
    """
    graph = workspace.keep("graph", graph)
    enough = graph.groupBy("pattern").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= MIN_SEEDS).select("pattern")
    enough = broadcast_if_small(workspace.keep("enough", enough), PATTERN_BYTES)
    edges = workspace.keep("edges-0", graph.join(enough, "pattern", "left_semi").select("pattern", "value", F.col("seed").alias("kind"), "left"))
    trusted, n_trusted = None, 0
    for n in itertools.count(1):
        now = generation(edges, workspace, f"generation{n}")
        if trusted is not None:
            now = trusted.unionByName(now.join(trusted, "pattern", "left_anti"))
        trusted = workspace.keep(f"trusted-{n}", now)
        before, n_trusted = n_trusted, trusted.count()
        if n_trusted == before:
            return trusted
        best = F.max_by("pattern_kind", F.struct("trust", -F.col("pattern_kind")))
        found = edges.where("kind is null").join(broadcast_if_small(trusted, PATTERN_BYTES), "pattern").groupBy("value").agg(best.alias("told"))
        edges = workspace.keep(f"edges-{n}", edges.join(found, "value", "left").select("pattern", "value", F.coalesce("kind", "told").alias("kind"), "left"))


def apart(added: Column, base: Column) -> Column:
    """The added spans that no base span overlaps, by one sweep over both in order of their starts."""
    far = 1 << 30
    item = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(kind).alias("added"))
    items = F.array_sort(F.concat(F.transform(base, item(0)), F.transform(added, item(1))))
    largest = lambda a, b: F.greatest(a, b)

    def swept(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: F.when(x["added"] == 0, x["end"]).otherwise(0)), largest)  # of base spans before
        behind = running(F.transform(F.reverse(s), lambda x: F.when(x["added"] == 0, far - x["start"]).otherwise(0)), largest)
        begins = F.reverse(F.slice(behind, 1, F.size(s)))  # of base spans behind
        return let(F.struct(s.alias("s"), ends.alias("ends"), begins.alias("begins")), clear)

    def clear(state: Column) -> Column:
        trio = F.transform(state["s"], lambda x, i: F.struct(x.alias("x"), F.get(state["ends"], i).alias("end"), (far - F.get(state["begins"], i)).alias("begin")))
        kept = F.filter(trio, lambda t: (t["x"]["added"] == 1) & (t["end"] <= t["x"]["start"]) & (t["begin"] >= t["x"]["end"]))
        return F.transform(kept, lambda t: F.struct(t["x"]["kind"].alias("kind"), t["x"]["start"].alias("start"), t["x"]["end"].alias("end")))

    return F.when(F.size(added) == 0, added).when(F.size(base) == 0, added).otherwise(let(items, swept))


def find(docs: DataFrame, workspace: Workspace, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of every whole text: doc_id, base and added arrays of (kind, start, end), and ``carry`` columns.

    Base spans of each kind are kept as they are; an added span is a candidate in a
    trusted pattern that no base span overlaps, with the kind of its own form or else of
    its most trusted pattern.  Both are sorted by kind and start.  A null or empty text
    has none.  Repeated rows each give a row, and rows of one id keep their own spans, as
    texts are told apart by SHA-256; columns outside ``carry`` are left out.  Long texts
    are worked on whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    said = docs.where(F.col("text").rlike("[0-9]")).select("doc_id", key.alias("_key"), F.explode(occurrences(F.col("text"))).alias("o"))
    said = said.select("doc_id", "_key", "o.value", "o.start", "o.end", patterns_of(F.col("o.left"), F.col("o.right")).alias("patterns")).distinct()
    said = workspace.keep("candidates", said.withColumn("seed", seed_kind(F.col("value"))))
    left = F.get(F.filter("patterns", lambda p: p.startswith("L ")), 0).alias("left")
    met = said.select("doc_id", "_key", "value", "seed", "start", "end", left, F.explode("patterns").alias("pattern"))
    trusted = bootstrap(met.select("pattern", "value", "seed", "left").distinct(), workspace)
    best = F.coalesce("seed", F.max_by("pattern_kind", F.struct("trust", -F.col("pattern_kind")))).alias("kind")
    spans = met.join(broadcast_if_small(trusted, PATTERN_BYTES), "pattern").groupBy("doc_id", "_key", "start", "end", "seed").agg(best)
    added = spans.groupBy(F.col("_key").alias("_akey"), F.col("doc_id").alias("_adoc")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("_added"))
    base = F.concat(*[base_spans(text, k) for k in BASE_KINDS])
    rows = docs.select("doc_id", *[c for c in carry if c != "doc_id"], key.alias("_key"), base.alias("base"))
    staged = workspace.keep("added", added)
    size = staged.agg(F.sum(F.size("_added") * 24 + 128)).first()[0] or 0
    joined = rows.join(F.broadcast(staged) if size <= common.BROADCAST_BYTES else staged, (F.col("_key") == F.col("_akey")) & F.col("doc_id").eqNullSafe(F.col("_adoc")), "left")
    clear = apart(F.col("_added"), F.col("base"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return joined.select("doc_id", *[c for c in carry if c != "doc_id"], "base", F.coalesce(F.array_sort(clear), none).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, of the first's kind.

    Texts are cut into chunks of CHUNK characters, so a stretch is found without
    counting from the start of the text.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def between(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
        return F.substring(held, start - first * CHUNK + 1, end - start)

    def written(s: Column) -> Column:
        joined = F.zip_with(s["spans"], F.slice(s["before"], 1, F.size(s["spans"])), lambda x, b: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), b.alias("before")))
        first = F.filter(joined, lambda x: x["start"] >= x["before"])  # begins behind all before it
        pieces = F.transform(first, lambda x: F.concat(between(s["chunks"], x["before"], x["start"]), F.get(names, x["kind"])))
        end = F.array_max(F.transform(s["spans"], lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), between(s["chunks"], end, F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    state = let(ordered, lambda o: F.struct(o.alias("spans"), running(F.transform(o, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("before"), chunks.alias("chunks")))
    return F.when(F.size(spans) == 0, text).otherwise(let(state, written))
