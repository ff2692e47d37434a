import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.conftest import prose
from tracelake.llm import common, spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """Counts of every occurrence, and all pairs of words compared."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [x for x in n if x != w and near(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in close.items() if x}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (c, len(close[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w, c in n.items()}


def check(df, workspace):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = spelling.variants(df, workspace).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found} == brute(rows)
    assert len(found) == len({r["word"] for r in found})
    return found


def edits(r, words, times):
    """Texts with words that are changed again and again, so that forms make ways of several steps."""
    texts = []
    for _ in range(times):
        out = []
        for w in r.choices(words, weights=[2 ** (i % 9) for i in range(len(words))], k=120):
            while r.random() < 0.25:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("aeéßx÷") + w[at:], w[:at] + r.choice("aoÀü") + w[at + 1 :]]) if len(w) > 4 else w + "a"
            out.append(w.upper() if r.random() < 0.1 else w)
        texts.append(" ".join(out))
    return texts


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_equals_all_pairs(spark, docs, workspace, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(spelling, "LIST_CHARACTERS", 60 if not limit else 1 << 17)  # lists in pieces on the far side
    monkeypatch.setattr(spelling, "HELD_WORDS", 50 if not limit else 1 << 18)
    r = random.Random(1)
    words = [*sorted({"".join(r.choice("abeéo") for _ in range(r.randint(4, 9))) for _ in range(60)}), "aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "z" * 300]
    rows = [(i, t) for i, t in enumerate(edits(r, words, 60))] + [(None, "nulls nulls nulls"), (4, None), (5, "")]
    rows += [(900, "kettenward " * 4), (901, "Kettenword " * 9), (902, "kettenwort " * 20)]
    both = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).repartition(3)
    found = check(both, workspace)
    assert {r["word"]: r["root"] for r in found}["kettenward"] == "kettenwort"


def test_one_list_holds_most_words(spark, workspace):
    """Words of one form but for two characters share their gram lists."""
    rows = [(i, " ".join(f"quatschwort{a}{b}ung" for a in "abcdefghij" for b in "klmnopqrst")) for i in range(3)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), workspace)


def test_merge_equals_counting():
    r = random.Random(2)
    for _ in range(200):
        lists = [sorted(r.sample(range(40), r.randint(1, 25))) for _ in range(r.randint(1, 9))]
        least = r.randint(1, 9)
        total = Counter(x for one in lists for x in one)
        assert list(spelling.merged(lists, least)) == [(x, total[x]) for x in sorted(total) if total[x] >= least]


def test_one_edit():
    assert all(spelling.one_edit(a, b) for a, b in [(b"ab", b"abc"), (b"ab", b"cab"), (b"ab", b"acb"), (b"ab", b"ac"), (b"aa", b"aaa")])
    assert not any(spelling.one_edit(a, b) for a, b in [(b"ab", b"ab"), (b"ab", b"ba"), (b"ab", b"bca"), (b"abc", b"abcde")])


def test_ids_that_are_strings(spark, workspace):
    rows = spark.createDataFrame([(f"id-{i}", prose(i, 80), "x") for i in range(8)], "doc_id string, text string, word string")
    check(rows, workspace)
