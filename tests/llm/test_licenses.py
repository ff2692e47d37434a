import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import prose
from tracelake.llm import common, licenses

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def common_words(a, b):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def base(text):
    """n_words, n_base, first_word, last_word, base_labels by looking at every place."""
    own = words(text)
    found = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found] or [None]
    return len(own), len(found), min(places), max(places), ",".join(sorted({label for _, label in found}))


BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_base_equals_plain_search(spark, docs, workspace, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    r = random.Random(5)
    parts = ["Under the MIT License", "cc by-nc", "CC BY NC 4.0", "Apache License, Version 2.0", "apache license version", "under the mit", "license", "the", "cc by", prose(3, 9), "é", "cc_by_nc", "version 2"]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(200, "cc by nc " * 4000), (201, "cc by " * 999), (5, "under the mit license"), rows[7], rows[7], (None, rows[8][1]), (None, rows[8][1])]
    both = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).repartition(3)
    found = licenses.scan(both, workspace).collect()
    expected = Counter((r["doc_id"], *base(r["text"])) for r in both.collect())
    assert Counter((r["doc_id"], *[r[c] for c in BASE]) for r in found) == expected
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found)


def changed(text, r, share):
    """The words of a text with some of them replaced, left out or followed by a new one."""
    out = []
    for w in words(text):
        kind = r.random()
        out += ["zz"] if kind < share / 3 else [] if kind < 2 * share / 3 else [w, "qq"] if kind < share else [w]
    return out


def test_changed_texts_are_found_and_shares_are_right(spark, workspace):
    r, rows, told = random.Random(9), [], {}
    for label, text in licenses.TEXTS:
        for share in (0.0, 0.1):
            own = changed(text, r, share) if len(words(text)) > 20 else words(text)
            told[len(rows)] = label
            rows.append((len(rows), " ".join([prose(len(rows), 60), *own, prose(len(rows) + 1, 60)])))
    clean = range(len(rows), len(rows) + 40)
    rows += [(i, prose(i, 300) + " the license of the software and the copyright holder in the software") for i in clean]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), workspace).collect()}
    hit = [i for i, label in told.items() if label in found[i]["labels"].split(",")]
    assert hit == list(told)  # every planted text, whole or with one word in ten changed
    assert all(found[i]["labels"].split(",") == [label] for i, label in told.items() if i % 2 == 0)
    assert all(found[i]["labels"] == "" and found[i]["score"] == 0 for i in clean)
    for i in told:
        if found[i]["score"] < 1:
            own = words(rows[i][1])
            shares = [common_words(words(text), own) / len(words(text)) for _, text in licenses.TEXTS]
            assert licenses.COVER <= found[i]["score"] <= max(shares)


def test_spans_merge_neighbouring_diagonals(spark):
    known = [licenses.Template("x", tuple(b"w%d" % i for i in range(30)), False)]
    hits = [(0, 7, 1, 2, p + 50 + (3 if p > 12 else 0), 0, p) for p in range(0, 28) if p != 12]  # three words put in
    hits += [(0, 7, 1, 2, p + 400, 0, p) for p in range(28)] + [(0, 7, 1, 2, 900, 0, 4)]  # a second copy, and a stray gram
    rows = spark.createDataFrame(hits, "row long, doc_id long, high long, low long, place int, template int, template_place int")
    assert sorted((r["first"], r["last"]) for r in licenses.spans(rows, known).collect()) == [(50, 53), (400, 400)]


def test_overlaps_go_to_the_longest():
    spans = [(5, 1.0, "a", 0, 9), (7, 0.7, "b", 8, 20), (7, 0.8, "c", 8, 20), (3, 1.0, "d", 20, 24), (3, 1.0, "e", 21, 23)]
    assert licenses.best_apart(spans) == [spans[2], spans[3]]
