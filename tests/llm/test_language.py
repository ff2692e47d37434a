import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelake.llm import common, language
from tracelake.llm.common import Workspace

SOUNDS = {"en": ["the", "ing", "th", "la"], "fr": ["eau", "ch", "é", "la"], "de": ["sch", "ung", "ß", "ei"]}


def speech(lang, seed, n=80):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = []
    for i in range(240):
        lang = ["en", "fr", "de"][i % 3]
        declared = lang if i % 10 else ["fr", "de", "en"][i % 3]  # one in ten is declared wrongly
        rows.append((i, speech(lang, i), declared, f"h{i % 3}.example.{lang}"))
    rows += [(1000, None, "en", "h0.example.en"), (1001, "", None, None), (1002, "12 34 !!", "fr", None), (1003, "3 q z", None, None)]
    rows += [(1004, "zqxj kwvz jxqk zzkq " * 40, None, None), (1005, speech("fr", 1), None, None), (1006, "Th", None, "h0.example.en"), (0, speech("en", 0), "fr", "h0.example.en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_truth_beats_wrong_declarations(spoken):
    found = language.identify(language.from_documents(spoken), Workspace(spoken.sparkSession, "language")).collect()
    assert len(found) == spoken.count()
    for r in found:
        if r["doc_id"] < 240:
            assert r["kept"] and r["language"] == ["en", "fr", "de"][r["doc_id"] % 3]
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1005]["language"] == "fr"
    for doc in (1000, 1001, 1002, 1003, 1004):
        assert by_id[doc]["language"] == "und" and not by_id[doc]["kept"], by_id[doc]


def test_host_prior_decides_where_text_cannot(spark, spoken):
    short = [(5000, "la la", None, "h0.example.en"), (5001, "la la", None, "h1.example.fr")]
    rows = language.from_documents(spoken).unionByName(language.from_documents(spark.createDataFrame(short, spoken.schema)))
    found = {r["doc_id"]: r["language"] for r in language.identify(rows, Workspace(spark, "language")).where("doc_id >= 5000").collect()}
    assert found == {5000: "en", 5001: "fr"}


def test_pages(spark, workspace):
    html = '<!DOCTYPE html><HTML class="x" lang="{0}-XX"><head><style>p{{}}</style><script>var thethethe="</p>";</script></head><body><!-- the --><p>{1}</p>&amp;</body>'
    rows = [(i, f"https://u@WWW.h{i % 3}.example.{lang}:80/a?b", html.format(lang, speech(lang, i))) for i in range(60) for lang in [["en", "fr", "de"][i % 3]]]
    rows += [(100, None, None), (101, "nonsense", "<html>"), (0, rows[0][1], rows[0][2])]
    pages = language.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    first = pages.where("page_id = 1").first()
    assert (first["host"], first["suffix"], first["declared"]) == ("www.h1.example.fr", "fr", "fr-XX")
    assert "script" not in first["text"] and "{" not in first["text"]
    found = language.identify(pages, workspace, id_col="page_id").collect()
    assert len(found) == len(rows)
    assert all(r["language"] == ["en", "fr", "de"][r["page_id"] % 3] for r in found if r["page_id"] < 60)


def test_awkward_rows(docs, no_docs, workspace):
    assert language.identify(language.from_documents(docs), workspace).count() == docs.count()
    assert language.identify(language.from_documents(no_docs), workspace).count() == 0


def plain(rows):
    """The fusion, row by row in plain Python: (id, language, probability, text_language) of each row."""
    logs, n_of = {}, {}
    counts = {}

    def grams(text):
        b = bytes((text or "").encode())
        letter = [c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else c if c >= 128 else 32 for c in b]
        for x, y, z in zip(letter, letter[1:], letter[2:], strict=False):
            if y != 32 and (x != 32 or z != 32):
                yield ((x << 16 | y << 8 | z) * 0x9E3779B1 & 0xFFFFFFFF) >> 17

    code = lambda d: m[1] if (m := re.fullmatch("([a-z]{2})([-_].*)?", (d or "").strip().lower())) else None
    rows = [(i, list(grams(t)), code(d), h or "", s or "") for i, t, d, h, s in rows]
    for _, g, d, _, _ in rows:
        if d:
            counts.setdefault(d, Counter()).update(g)
    counts = {d: c for d, c in counts.items() if c}
    pool = sum(counts.values(), Counter())
    size = language.BUCKETS
    share = lambda b: (pool[b] + 0.5) / (pool.total() + 0.5 * size)
    classes = [*sorted(counts), "und"]

    def text_log(g):
        scale = min(1, 4 / math.sqrt(len(g))) if g else 1
        logs = [scale * sum(math.log((counts[c][b] + language.POOLED * share(b)) / (counts[c].total() + language.POOLED)) for b in g) for c in classes[:-1]]
        return [*logs, scale * len(g) * -math.log(size) + math.log(language.UNKNOWN_PRIOR)]

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    lls = [text_log(r[1]) for r in rows]
    ps = [soft(x) for x in lls]
    add = lambda xs: [sum(v) for v in zip([0.0] * len(classes), *xs, strict=True)]
    total = lambda f: add([p for r, p in zip(rows, ps, strict=True) if r[1] and f(r)])
    tags = {r[2] for r in rows if r[2]}
    said = {t: total(lambda r, t=t: r[2] == t) for t in tags}
    overall = add(said.values())
    world = total(lambda r: True)
    world = [(v + 1) / (sum(world) + len(classes)) for v in world]
    out = []
    for r, ll, p in zip(rows, lls, ps, strict=True):
        suffix = total(lambda x: x[4] == r[4])
        prior = [(v + language.SMOOTHING * w) / (sum(suffix) + language.SMOOTHING) for v, w in zip(suffix, world, strict=True)]
        host = total(lambda x: x[3] == r[3] and x[4] == r[4])
        others = [max(v - q, 0) for v, q in zip(host, p if r[1] else [0.0] * len(p), strict=True)]
        final = []
        for i, v in enumerate(ll):
            told = math.log((said[r[2]][i] + language.DECLARED_SMOOTHING) / (overall[i] + language.DECLARED_SMOOTHING * max(len(said), 1))) if r[2] else 0.0
            final.append(v + told + math.log((others[i] + language.SMOOTHING * prior[i]) / (sum(others) + language.SMOOTHING)))
        final = soft(final)
        out.append((r[0], classes[final.index(max(final))] if r[1] else "und", max(final), classes[p.index(max(p))] if r[1] else "und"))
    return out


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_equals_plain_fusion(spark, monkeypatch, limit):
    """Text, declared, suffix and host evidence against a loop; with hosts broadcast, and with hot and other hosts apart."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(language, "HOT_ROWS", 12)
    r, rows = random.Random(6), []
    for i in range(70):
        lang = r.choice(["en", "fr", "de"])
        text = speech(lang, i, r.choice([1, 2, 20])) if i % 9 else r.choice([None, "", "12", "zq xj vk " * 5])
        rows.append((i, text, r.choice([lang, lang, None, "FR-ca", "nonsense", "xx"]), r.choice(["big.example.fr", f"h{r.randint(0, 9)}.example.{lang}", None]), r.choice(["fr", "de", None])))
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string").repartition(3)
    found = {x["doc_id"]: x for x in language.identify(frame, Workspace(spark, "language")).collect()}
    want = plain(rows)
    assert len(found) == len(rows)
    for doc, lang, chance, text in want:
        assert found[doc]["probability"] == pytest.approx(chance, abs=1e-4), doc
        assert (found[doc]["language"], found[doc]["text_language"]) == (lang, text) or chance < 0.52, doc


def test_address_suffix_changes_a_result(spark, spoken):
    rows = language.from_documents(spoken)
    short = [(5000, "la la", None, "new.example", "en"), (5001, "la la", None, "new.example", "fr")]
    rows = rows.withColumn("host", F.concat("suffix", F.lit("host"))).unionByName(spark.createDataFrame(short, "doc_id long, text string, declared string, host string, suffix string"))
    found = {r["doc_id"]: r["language"] for r in language.identify(rows, Workspace(spark, "language")).where("doc_id >= 5000").collect()}
    assert found == {5000: "en", 5001: "fr"}


def test_a_language_of_little_text_is_kept(spark, spoken):
    rare = [(6000 + i, "qo xu qoxu uxo " * 12, "qx", None) for i in range(2)]
    rows = language.from_documents(spoken.unionByName(spark.createDataFrame(rare, spoken.schema)))
    found = language.identify(rows, Workspace(spark, "language")).where("doc_id >= 6000").collect()
    assert {r["language"] for r in found} == {"qx"} and all(r["kept"] for r in found)


def test_many_declared_languages(spark, spoken, monkeypatch):
    """676 tags: evidence keeps the best ones, narrower than a text, and the right language is found."""
    tags = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    others = spark.createDataFrame([(9000 + i, f"{t}o{t}u {t}a{t} " * 6, t, None) for i, t in enumerate(tags) if t not in SOUNDS], spoken.schema)
    workspace = Workspace(spark, "language")
    found = language.identify(language.from_documents(spoken.unionByName(others)), workspace).where("doc_id < 240").collect()
    assert sum(r["language"] == ["en", "fr", "de"][r["doc_id"] % 3] for r in found) >= 0.95 * len(found)
    row = workspace.read("evidence").first()
    assert len(row["classes"]) == len(row["ll"]) == len(row["p"]) == language.TOP


def test_every_declared_language_can_win(spark):
    """60 tags against the loop over all classes: texts that tell few of them apart, so hosts and declarations decide beyond the TOP best."""
    tags = [a + b for a in "abcdef" for b in "ghijklmnop"]
    rows = [(i, f"{t}o{t}u {t}a{t} " * 4, t, f"h{i}.example.{t}", t) for i, t in enumerate(tags) for _ in range(2)]
    rows += [(1000 + i, f"wx{tags[j]}", None, f"h{i}.example.{t}", t) for i, t in enumerate(tags) for j in (i, (i + 7) % 60)]
    rows += [(2000 + i, f"{tags[i - 1]}o", t, None, None) for i, t in enumerate(tags)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string").repartition(3)
    found = {x["doc_id"]: x for x in language.identify(frame, Workspace(spark, "language")).collect()}
    want = plain(rows)
    assert len(found) == len(rows) == len(want)
    for doc, lang, chance, text in want:
        assert found[doc]["probability"] == pytest.approx(chance, abs=1e-4), doc
        assert (found[doc]["language"], found[doc]["text_language"]) == (lang, text) or chance < 0.52, doc
