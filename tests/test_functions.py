import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelake.functions import automaton, dims, money, secrets, text

SAMPLES = {
    "anthropic_key": "sk-ant-" + "a1B2" * 6, "openai_key": "sk-proj-" + "Zx9_" * 6, "github_pat": "ghp_" + "A1b2C3" * 6, "github_fine_grained_pat": "github_pat_" + "a1_B2" * 9,
    "github_app_token": "ghs_" + "Q1w2E3" * 6, "aws_access_key": "AKIA" + "ABCD1234" * 2, "slack_token": "xoxb-" + "123-abc" * 3, "jwt": "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12,
    "bearer_token": "Bearer " + "t0ken.-_" * 3, "email": "jane.doe@corp.io",
}


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first()["r"]


def kept(spark, lines, least=7):
    """Unsuppressed (category, value, confidence) of each line."""
    rows = secrets.hits(spark.createDataFrame(list(enumerate(lines)), "i int, line string").coalesce(1), least, once=True).where("suppressed_by is null").collect()
    return [[(r["category"], r["value"], r["confidence"]) for r in rows if r["i"] == i] for i in range(len(lines))]


def test_every_detector_sample_has_an_anchor_and_is_found(spark):
    assert {d.category for d in dims.DETECTORS} == set(SAMPLES)
    rows = spark.createDataFrame([*SAMPLES.items(), ("none", "plain\nwords"), ("null", None)], "category string, line string")
    assert tuple(automaton.anchored(rows, "line").first()) == (len(SAMPLES) + 2, len(SAMPLES))
    for category, hits in zip(SAMPLES, kept(spark, [f"x {line} y" for line in SAMPLES.values()]), strict=True):
        assert category in {h[0] for h in hits}, category
    assert all(d.needle in (SAMPLES[d.category].lower() if d.pattern.startswith("(?i)") else SAMPLES[d.category]) for d in dims.DETECTORS)


def brute_hits(line, least=7):
    """First-seen unsuppressed (category, value) pairs by Python's expressions."""
    found = []
    if any(a in line for a in dims.ANCHORS):
        for d in dims.DETECTORS:
            for m in re.finditer(d.pattern, line):
                value, start = m[d.group], m.start(d.group)
                mail = "@" in value
                domain, local = value.rpartition("@")[2].lower(), value.partition("@")[0].lower()
                reserved = domain in dims.RESERVED_DOMAINS or domain.endswith(tuple("." + x for x in dims.RESERVED_DOMAINS) + dims.RESERVED_SUFFIXES)
                if start and line[start - 1] == "\\" or mail and (reserved or local in dims.NOREPLY or domain in dims.PLACEHOLDER_DOMAINS):
                    continue
                if d.confidence >= least and (d.category, value) not in found:
                    found.append((d.category, value))
    return found


LINES = [
    "", "no secrets", "a@b.io a@b.io", r"\nuser@corp.io and \\x@corp.io", "x@api.example.com noreply@corp.io me@yourdomain.com you@real.test you@sub.yourdomain.com",
    "Bearer " + "a" * 25 + " BEARER " + "b" * 25, "BEARER " + "b" * 25, "k=sk-ant-" + "q" * 30 + ";sk-proj-" + "w" * 25, r"\sk-" + "z" * 30, "AKIA" + "A" * 16 + "B", *SAMPLES.values(), " ".join(SAMPLES.values()),
]


def test_hits_equal_the_expressions(spark):
    for line, hits in zip(LINES, kept(spark, LINES), strict=True):
        assert [h[:2] for h in hits] == brute_hits(line), line


def test_automaton_equals_the_expressions_on_random_lines(spark):
    """Lines made of pieces of matches, as lines and as texts of many lines, against Python's expressions at every place."""
    r = random.Random(4)
    pieces = [*SAMPLES.values(), "sk-", "sk-ant-", "proj-", "@", "a@b.io", ".", "%", "\\", "é", "字", " ", " ", "bearer", "Bearer ", "BEARER  ", "eyJ", "AKIA", "A1" * 9, "x" * 45, "Qq9+/" * 50, "a.a" * 20, "xoxb-", "..", "_", "-", "noreply@x.test", ",", "\t"]
    lines = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(400)]

    def brute(line, limit):
        line, found = line[:limit], []
        if any(a in line for a in dims.ANCHORS):
            for d in dims.DETECTORS:
                for m in re.finditer(d.pattern if d.group else rf"\\?(?:{d.pattern})", line):
                    found.append((d.category, d.confidence, m[d.group], m.start(d.group) + m[d.group].startswith("\\")))
        return found + [("high_entropy", 0, m[0], m.start() + m[0].startswith("\\")) for m in re.finditer(r"\\?[A-Za-z0-9+/=_\-]{40,200}", line)]

    hit = lambda x: (x["category"], x["confidence"], x["raw"], x["start"])
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").coalesce(1)
    for limit in (None, 60):
        found = automaton.raw_hits(rows, "line", ["i"], 4, limit=limit).collect()
        assert Counter((x["i"], *hit(x)) for x in found) == Counter((i, *h) for i, line in enumerate(lines) for h in brute(line, limit))
    texts = [(i, "\n".join(lines[i : i + 40])) for i in range(0, 400, 40)] + [(1, None), (2, ""), (3, "\n")]
    found = automaton.raw_hits(spark.createDataFrame(texts, "i int, text string").coalesce(1), "text", ["i"], 4, split=True).collect()
    assert Counter((x["i"] + x["line_no"], *hit(x)) for x in found) == Counter((i, *h) for i, line in enumerate(lines) for h in brute(line, None))
    once = automaton.raw_hits(rows, "line", ["i"], 4, once=True).collect()
    assert Counter((x["i"], x["category"], x["raw"]) for x in once) == Counter({(i, *h[:3:2]) for i, line in enumerate(lines) for h in brute(line, None)})


def test_one_long_line_of_near_matches_takes_linear_time(spark):
    line = "a.a" * 200_000 + "@" + "b@" * 200_000 + "\\sk-" * 100_000
    assert automaton.raw_hits(spark.createDataFrame([(line,)], "line string"), "line", [], 7).count() == 0


def test_contexts_stand_where_the_matches_do(spark):
    """Offsets and text around by Python's expressions."""
    lines = [*LINES, "é" * 300 + " a@b.io " + "x" * 250 + " xa@b.io a@b.io"]
    rows = secrets.contexts(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), 7, 20).collect()
    found = Counter((r["i"], r["category"], r["start"], r["context_before"], r["match_full"], r["context_after"]) for r in rows)
    assert all(r["raw_line"] == lines[r["i"]] for r in rows)
    want = Counter()
    for i, line in enumerate(lines):
        if any(a in line for a in dims.ANCHORS):
            keep = {x[:2] for x in kept(spark, [line])[0]}
            for d in dims.DETECTORS:
                for m in re.finditer(d.pattern, line):
                    a, b = m.span(d.group)
                    if (d.category, m[d.group]) in keep and not (a and line[a - 1] == "\\"):
                        want[i, d.category, a, line[max(0, a - 20) : a], line[a:b], line[b : b + 20]] += 1
    assert found == want


def test_entropy_layer(spark):
    blob = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9St0Uv+Wx/Yz=aB3"
    line = f"{blob} {'ab' * 30} {hashlib.sha256(b'x').hexdigest()} \\{blob}x"
    hits = kept(spark, [line], 4)[0]
    assert [h[:2] for h in hits] == [("high_entropy", blob)]
    counts = Counter(blob)
    bits = -sum(n / len(blob) * math.log2(n / len(blob)) for n in counts.values())
    assert column(spark, blob, secrets.shannon_entropy) == pytest.approx(bits)
    assert hits[0][2] == (6 if bits >= 5.5 else 5 if bits >= 5 else 4)
    assert column(spark, "aabb", secrets.shannon_entropy) == 1.0


@pytest.mark.parametrize("value,want", [("short", "…" * 5), ("12345678", "…" * 8), ("123456789", "12…REDACTED…89"), ("a" * 40, "aaaa…REDACTED…aaaa")])
def test_redaction(spark, value, want):
    assert column(spark, value, secrets.redact) == want


def test_fingerprint_is_a_short_sha1(spark):
    assert column(spark, "s", lambda c: secrets.fingerprint(F.lit("cat"), c)) == hashlib.sha1(b"cat:s").hexdigest()[:16]


@pytest.mark.parametrize("model,key", [
    ("claude-opus-4-7", "claude-opus-4-7"), ("claude-sonnet-4-5-20250929", "claude-sonnet-4-5"), ("gpt-5-codex-high", "gpt-5-codex"), ("gpt-5.5", "gpt-5.5"), ("gpt-5.7", None),
    ("claude-sonnet-4-5 (x)", "claude-sonnet-4"), ("gpt-5 (x)", None), ("o1", "o1"), ("o1-mini-2", "o1-mini"), ("", None), (None, None),
])
def test_prices_go_by_the_longest_prefix(spark, model, key):
    assert column(spark, model, money.price_key) == key


@pytest.mark.parametrize("label,want,flag", [
    ("A) Add (recommended)", "A) Add", True), ("Add [Recommended] .", "Add", True), ("Plan (推荐)", "Plan", True), ("Los (Empfohlen)", "Los", True), ("Va (RECOMMANDÉ)", "Va", True), ("A) Add", "A) Add", False), ("(recommended) first", "(recommended) first", False),
])
def test_recommendation_marks(spark, label, want, flag):
    assert column(spark, label, text.recommended_label) == want
    assert column(spark, label, text.is_recommended) is flag


def test_names_titles_and_labels(spark):
    assert column(spark, "  /gstack-ship ", text.normalize_skill_name) == "ship"
    assert column(spark, "//x", text.normalize_skill_name) == "/x"
    assert column(spark, " a　\n b ", text.normalize_title) == "a b"
    assert column(spark, "<command-name>x</command-name>", text.real_title) is None
    assert column(spark, "/a/b/", text.basename) == "b" and column(spark, "", text.basename) is None
    assert column(spark, "<command-name>a</command-name> <command-name>b</command-name>", text.command_names) == ["a", "b"]
    assert column(spark, '"q  1"="x" "q 1"="y" "z"=" w "', text.answer_map) == {"q 1": "y", "z": "w"}
    assert column(spark, '{"modelID":"m","providerID":"p"}', text.opencode_model) == "m (p)"
    assert column(spark, "{broken", text.opencode_model) is None
    assert column(spark, "abcdef", lambda c: text.truncate(c, 4)) == "abc…"
    assert column(spark, "5400", text.countdown) == "1h30m" and column(spark, "7300", text.relative_time) == "2h ago"
    assert column(spark, "k", lambda c: text.unit_hash(c, 2)) == int(hashlib.md5(b"2:k").hexdigest()[:8], 16) / 2**32


def test_text_helpers(spark):
    from tracelake.functions import text as t

    rows = [(r'a\n\"b\" \u00e9\u5b57 \x \\n', "https://host.example/own/repo.git", "file:///w/a b"), ("plain\\", "git@host.example:own/repo.git", "http://x"), (None, "host.example/repo", None)]
    found = spark.createDataFrame(rows, "j string, u string, f string").select(t.json_unescape(F.col("j")), t.repository_slug(F.col("u")), t.local_path(F.col("f")), t.short_id(F.col("u"))).collect()
    assert [tuple(r)[:3] for r in found] == [('a\n"b" é字 \\x \\n', "own-repo", "/w/a b"), ("plain\\", "own-repo", None), (None, None, None)]
    assert found[0][3] == "https://"


def test_windows():
    import datetime as dt

    from tracelake.functions import windows as w

    zone = dt.timezone(dt.timedelta(hours=2))
    now = dt.datetime(2024, 3, 31, 9, 30, tzinfo=zone)
    assert w.today(now) == (dt.datetime(2024, 3, 31, tzinfo=zone), now) and w.weekly(now)[0] == now - dt.timedelta(days=7)
    assert w.monthly(now)[0] == dt.datetime(2024, 3, 1, tzinfo=zone)
    assert w.previous(w.weekly(now)) == (now - dt.timedelta(days=14), now - dt.timedelta(days=7))
    assert w.custom(dt.datetime(2024, 3, 1), None, now) == (dt.datetime(2024, 3, 1, tzinfo=zone), now)
    with pytest.raises(ValueError):
        w.custom(now, now, now)
    assert w.since("60d", 7, now) == now - dt.timedelta(days=60) and w.since("2024-01-02", 7, now) == dt.datetime(2024, 1, 2, tzinfo=zone)
    assert w.since("soon", 7, now) == w.since(None, 7, now) == now - dt.timedelta(days=7)
    assert w.elapsed_hours(w.today(now)) == 9.5 and w.elapsed_hours(w.weekly(now), now - dt.timedelta(days=6)) == 24
    assert w.stamp(now) == "2024-03-31 07:30:00.000000"


def test_json_objects_keep_fields_and_order(spark):
    import json

    from tracelake.sinks import json as sink

    df = spark.sql("SELECT 'f2' AS fingerprint, TIMESTAMP '2024-01-02 00:00:00' AS first_seen, 3L AS count UNION ALL SELECT 'f1', TIMESTAMP '2024-01-01 00:00:00', 1L")
    rows = [json.loads(r["json"]) for r in sink.export_findings(df).collect()]
    assert [r["fingerprint"] for r in rows] == ["f1", "f2"] and tuple(rows[0]) == sink.FIELDS["findings"]
    assert rows[0]["first_seen"] == "2024-01-01T00:00:00.000000+00:00" and rows[0]["notes"] is None
