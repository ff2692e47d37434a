"""Candidate places of secrets, by one automaton over the bytes of a batch of texts.

An Aho-Corasick automaton of all detectors' needles and all anchors runs once over the
UTF-8 bytes of a whole Arrow batch.  Only lines in which it stops are decoded, and an
expression is tried only at its needle's places; texts without any are never cut into
lines.  Runs of characters that may be random are found in the same bytes by a table.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.functions import dims

HIT = "category string, confidence int, raw string, start int"
RANDOM = np.zeros(256, bool)
RANDOM[list(dims.ENTROPY_CHARACTERS.encode())] = True


def either_case(word: str) -> Iterator[str]:
    return map("".join, itertools.product(*[sorted({c, c.upper()}) for c in word]))


class Rule:
    """A detector as expressions anchored at its needle: what stands before the needle, and it with what follows."""

    def __init__(self, detector: dims.Detector):
        self.detector, self.ignores_case = detector, detector.pattern.startswith("(?i)")
        self.head = None
        if detector.before:
            left, right = detector.pattern.split(detector.needle)
            self.head, self.tail = re.compile(rf"\\?(?:{left})"), re.compile(re.escape(detector.needle) + right)
        else:
            self.tail = re.compile(detector.pattern if detector.group else rf"\\?(?:{detector.pattern})")

    def needles(self) -> Iterator[str]:
        return either_case(self.detector.needle) if self.ignores_case else iter([self.detector.needle])

    def match(self, line: str, at: int, free: int, last: int) -> tuple[int, int, int] | None:
        """Start of the raw match, its end, and the end of the whole one, for a needle at ``at``.

        Nothing before ``free`` is left to match; ``last`` is where the needle before this one stood.
        """
        if self.head:
            right = self.tail.match(line, at)
            if not right:
                return None
            begin = max(free, last + 1)
            begin += len(line[begin:at].rstrip(self.detector.before))
            left = self.head.search(line, max(begin - 1, free) if line[begin - 1 : begin] == "\\" else begin, at)
            return (left.start(), right.end(), right.end()) if left else None
        found = self.tail.match(line, at - 1 if at > free and line[at - 1] == "\\" and not self.detector.group else at)
        return (found.start(self.detector.group), found.end(self.detector.group), found.end()) if found else None


class Matcher:
    """Detectors from a confidence on; lines count up to ``limit`` characters, if one is given."""

    def __init__(self, min_confidence: int, limit: int | None):
        self.rules = [Rule(d) for d in dims.DETECTORS if d.confidence >= min_confidence]
        self.entropy, self.limit = min_confidence <= 6, limit
        meaning: dict[str, list[int]] = {a: [] for a in dims.ANCHORS}
        for i, rule in enumerate(self.rules):
            for needle in rule.needles():
                meaning.setdefault(needle, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for needle, rules in meaning.items():
            self.automaton.add_word(needle, (len(needle), rules, needle in dims.ANCHORS))
        self.automaton.make_automaton()

    def places(self, data: str, raw: np.ndarray, edges: list[int]) -> list[tuple]:
        """(place, length, rules, anchor) of each needle inside a text, and (place, length, None, False) of each run that may be random, in order."""
        found = []
        for end, (n, rules, anchor) in self.automaton.iter(data):
            at = end + 1 - n
            if bisect.bisect_right(edges, at) == bisect.bisect_right(edges, end):
                found.append((at, n, rules, anchor))
        if self.entropy and len(raw):
            inside, cut = RANDOM[raw], np.zeros(len(raw) + 1, bool)
            cut[edges] = True
            starts = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | cut[:-1]))
            ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | cut[1:])) + 1
            long = ends - starts >= dims.ENTROPY_LENGTHS[0]
            found += [(a, b - a, None, False) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return sorted(found, key=lambda x: x[:2])

    def line(self, line: str, places: list[tuple]) -> Iterator[tuple[str, int, str, int]]:
        """(category, confidence, raw, start of the value) of a line with its places in characters."""
        if self.limit is not None and len(line) > self.limit:
            line = line[: self.limit]
            places = [p for p in places if p[0] + (p[1] if p[2] is not None else 1) <= self.limit]
        if any(anchor for *_, anchor in places):
            free, last, found = [0] * len(self.rules), [-1] * len(self.rules), []
            for at, _, rules, _ in places:
                for i in rules or ():
                    hit = self.rules[i].match(line, at, free[i], last[i]) if at >= free[i] else None
                    if hit:
                        free[i] = hit[2]
                        found.append((i, *hit))
                    last[i] = at
            for i, begin, end, _ in sorted(found):  # by detector
                d = self.rules[i].detector
                yield d.category, d.confidence, line[begin:end], begin + (line[begin] == "\\")
        low, high = dims.ENTROPY_LENGTHS
        for at, n, rules, _ in places:
            if rules is None:
                end = min(at + n, len(line))
                for begin in range(at, end, high):
                    if end - begin >= low:
                        first = begin - 1 if begin == at and at and line[at - 1] == "\\" else begin
                        yield "high_entropy", 0, line[first : min(begin + high, end)], begin

    def batch(self, column: pa.Array, split: bool) -> Iterator[tuple[int, int, tuple]]:
        """(row, line number, hit) of each hit of a column of texts; ``split`` cuts them at line feeds."""
        text, edges = packed(column)
        places = self.places(text, np.frombuffer(text.encode("latin-1"), np.uint8), edges)
        row = number = counted = 0
        i = 0
        while i < len(places):
            at = places[i][0]
            own = bisect.bisect_right(edges, at) - 1
            begin, stop = edges[own], edges[own + 1]
            if own != row or not i:
                row, number, counted = own, 0, begin
            if split:
                low, feed = text.rfind("\n", begin, at) + 1 or begin, text.find("\n", at, stop)
                stop = feed if feed >= 0 else stop
                number, counted = number + text.count("\n", counted, low), low
                begin = low
            here = []
            while i < len(places) and places[i][0] < stop:
                here.append(places[i])
                i += 1
            line = text[begin:stop].encode("latin-1").decode("utf-8", "replace")
            characters, before = 0, begin
            for j, (p, *rest) in enumerate(here):  # places in bytes become places in characters
                characters += p - before if len(line) == stop - begin else len(text[before:p].encode("latin-1").decode("utf-8", "replace"))
                before = p
                here[j] = (characters, *rest)
            for hit in self.line(line, here):
                yield row, number, hit


def packed(column: pa.Array) -> tuple[str, list[int]]:
    """The bytes of all texts of a column, one character a byte, and the edges of the texts; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    column = column if pa.types.is_string(column.type) else column.cast(pa.string())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = memoryview(data)[edges[0] : edges[-1]] if data is not None and len(column) else b""
    return str(raw, "latin-1"), (edges - edges[0]).tolist()


@functools.cache
def matcher(min_confidence: int, limit: int | None) -> Matcher:
    return Matcher(min_confidence, limit)


def raw_hits(rows: DataFrame, text: str, carry: list[str], min_confidence: int = 7, once: bool = False, limit: int | None = None, split: bool = False) -> DataFrame:
    """Columns ``carry`` with (category, confidence, raw, start) of every match in a column of texts.

    ``raw`` has the backslash before the match if there is one; ``start`` is that of the
    value, in characters of the line.  ``split`` texts are cut at line feeds, and
    ``line_no`` counts lines from 0.  ``once``: equal matches of a line count once.
    Strings that may be of high entropy come with confidence 0.  A null text has none.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(min_confidence, limit)
        for batch in batches:
            at, numbers, hits, seen = [], [], [], set()
            line = None
            for row, number, hit in own.batch(batch.column(len(carry)), split):
                if once:
                    if line != (row, number):
                        line, seen = (row, number), set()
                    if hit[:3] in seen:
                        continue
                    seen.add(hit[:3])
                at.append(row)
                numbers.append(number)
                hits.append(hit)
            if hits:
                kept = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(carry))]
                columns = [pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)]
                lines = [pa.array(numbers, pa.int32())] if split else []
                yield pa.RecordBatch.from_arrays([*kept, *lines, *columns], names=names)

    names = [*carry, *(["line_no"] if split else []), *[c.split()[0] for c in HIT.split(", ")]]
    schema = StructType([*rows.select(*carry).schema, *StructType.fromDDL(f"{'line_no int, ' if split else ''}{HIT}")])
    return rows.select(*carry, F.col(text).alias("_text")).mapInArrow(found, schema)


def anchored(rows: DataFrame, text: str) -> DataFrame:
    """(lines, anchored): lines of all texts, and those with an anchor."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = ahocorasick.Automaton()
        for a in dims.ANCHORS:
            anchors.add_word(a, len(a))
        anchors.make_automaton()
        lines = hit = 0
        for batch in batches:
            data, edges = packed(batch.column(0))
            lines += data.count("\n") + batch.num_rows - batch.column(0).null_count
            stop = 0
            for end, n in anchors.iter(data):
                if end + 1 - n >= stop and bisect.bisect_right(edges, end + 1 - n) == bisect.bisect_right(edges, end):
                    hit += 1
                    feed, row_end = data.find("\n", end), edges[bisect.bisect_right(edges, end)]
                    stop = min(feed, row_end) if feed >= 0 else row_end
        yield pa.RecordBatch.from_arrays([pa.array([lines]), pa.array([hit])], names=["lines", "anchored"])

    made = rows.select(F.col(text).alias("_text")).mapInArrow(counted, "lines long, anchored long")
    return made.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("anchored"), F.lit(0)).alias("anchored"))
