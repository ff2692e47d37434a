import itertools
import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import prose
from tracelake.llm import common, filter_audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every order applied to every document, one after another."""
    def fails(doc, text):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        found["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
        return {f for f, bad in found.items() if bad}

    told = {"good_lost": {d for d, q, _ in labels if q == 1 and d is not None}, "toxic_lost": {d for d, _, t in labels if t == 1 and d is not None}}
    judged = [(doc, part or "", fails(doc, text or "")) for doc, text, part in rows]
    found, by_filter = {}, Counter()
    for part, order in itertools.product({p for _, p, _ in judged}, itertools.permutations("ABCDE")):
        left = [(doc, bad) for doc, p, bad in judged if p == part]
        every = list(left)
        for step, f in enumerate(order, 1):
            gone = [(doc, bad) for doc, bad in left if f in bad]
            left = [(doc, bad) for doc, bad in left if f not in bad]
            by_filter[part, f] += len(gone)
            lost = [sum(doc in told[c] for doc, _ in gone) for c in ("good_lost", "toxic_lost")]
            found[part, "".join(order), step] = (len(left), len(gone), sum(f in bad for _, bad in every) - len(gone), sum(bad == {f} for _, bad in every), *lost)
    return {key: (*value, by_filter[key[0], key[1][key[2] - 1]]) for key, value in found.items()}


def check(spark, rows, labels, workspace):
    docs = spark.createDataFrame(rows, DOCS).withColumn("part", filter_audit.F.lit("clash")).repartition(3)
    found = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), workspace).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == brute(rows, labels) and len(found) == len(brute(rows, labels))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_equals_plain_counting(spark, workspace, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    r = random.Random(3)
    texts = [prose(i, r.choice([20, 199, 200, 260])) for i in range(12)] + [None, "", " ", "ABC def", "x # y", "same " * 300, "Ä" * 50 + "A", "a" * 70_000 + " #"]
    rows = [(i, r.choice(texts), r.choice(["s1", "s2", None, ""])) for i in range(90)]
    rows = [(d, t.upper() if t and r.random() < 0.1 else t, s) for d, t, s in rows]
    rows += [rows[0], rows[0], (None, texts[0], "s1"), (None, None, None), (3, "another text of an id", "s3")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    check(spark, rows, labels, workspace)


def test_one_text_holds_most_rows(spark, workspace):
    rows = [(i, prose(1, 210) if i % 3 else prose(i, 205), "a" if i % 7 else "b") for i in range(200)]
    check(spark, rows, [(0, 1, 0)], workspace)


def test_table():
    assert filter_audit.FIRST.shape == (32, 120)
    assert filter_audit.FIRST[0].tolist() == [5] * 120 and filter_audit.FIRST[31].tolist() == [0] * 120
    assert filter_audit.FIRST[0b10100][filter_audit.NAMES.index("ABDEC")] == 3
