import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from tracelake.llm import decontaminate as dc
from tracelake.llm.common import Workspace

ITEMS = [(i, prose(500 + i, 20 + 3 * i).replace("\n", "")) for i in range(12)]
LONG = prose(900, 200)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_bit_parallel_subsequence():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(1, 40))] for _ in range(2))
        assert dc.common_length(dc.masks(a), len(a), b) == lcs(a, b)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(9)
    docs, leaks = [], set()
    for n in range(80):
        words = prose(2000 + n, 150).split(" ")
        if n % 4 == 0:
            item, text = ITEMS[n // 4 % len(ITEMS)]
            own = text.split()
            if n % 8 == 0:  # a paraphrase: one word in eight goes or changes, punctuation and case differ
                own = [w.upper() + "," if r.random() < 0.3 else w for i, w in enumerate(own) if i % 8 != 3 or r.random() < 0.5]
            at = r.randrange(len(words))
            words[at:at] = own
            leaks.add((n, item))
        docs.append((n, " ".join(words)))
    docs += [(500, LONG + " " + prose(901, 30)), (501, None), (502, ""), (503, "a b"), (None, ITEMS[3][1]), (0, docs[0][1])]
    leaks |= {(500, 99), (None, 3)}
    bench = spark.createDataFrame([*ITEMS, (99, LONG), (100, None), (101, "")], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string"), bench, leaks


def test_finds_leaks_and_nothing_else(tables):
    docs, bench, leaks = tables
    found = dc.leaks(docs, bench, Workspace(docs.sparkSession, "leaks")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == leaks
    assert sum((r["doc_id"], r["item_id"]) == (0, 0) for r in found) == 2  # the repeated row


def test_copies_beyond_the_rank(spark):
    """Several times RANK passages, some of few words: whole and 30%-changed copies are found, and nothing else."""
    r = random.Random(5)
    word = lambda: "w" + str(int(20_000 ** r.random()))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 60) if i % 40 else 5))) for i in range(4 * dc.RANK)]
    docs, leaks = [], set()
    for i, text in items:
        for kind in range(2 if i % 40 else 1):
            own = text.split()
            if kind:
                for at in r.sample(range(len(own) - max(3, len(own) // 4)), 3 * len(own) // 10):  # the answer stays
                    own[at] = "changed" + str(r.randint(0, 99))
            lead = [word() for _ in range(r.randint(0, 60))]
            docs.append((2 * i + kind, " ".join([*lead, *own, *[word() for _ in range(60)]])))
            leaks.add((2 * i + kind, i))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {tuple(x) for x in dc.leaks(frame, spark.createDataFrame(items, "item_id long, text string"), Workspace(spark, "leaks")).select("doc_id", "item_id").collect()}
    assert len(leaks - found) == 0
    assert len(found - leaks) <= len(leaks) // 100


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items):
    """Every window of every document against every passage, by the plain subsequence table."""
    found = set()
    for n, (doc, text) in enumerate(docs):
        t = words_of(text)
        for item, body in items:
            w = words_of(body)
            if not w:
                continue
            low = (body or "").rstrip().lower()
            marks = [[m.end() for m in re.finditer(p, low)] for p in (r"\b(?:answer|a)\s*:", r"\?", r"[.!?](?=\s)|\n")]
            at = next((m[-1] for i, m in enumerate(marks) if m and (m[-1] < len(low) or i == 2)), 0)
            answer = min(len(words_of(low[:at])), max(len(w) - 3, 0))
            parts = -(-len(w) // 64)
            edges = np.linspace(0, len(w), parts + 1).astype(int).tolist()
            common = told = 0
            for x, y in zip(edges, edges[1:], strict=False):
                part, m, best = w[x:y], y - x, (0, 0)
                for b in range(0, len(t), 16):
                    lo, hi = max(0, b - m), min(len(t), b + 32 + m)
                    text_here = t[lo:hi]
                    if len(w) < 3:
                        ok = (m, len(w) - answer) if t == w else (0, 0)
                    elif len(w) < 8:
                        ok = (m, len(w) - answer) if any(text_here[i : i + m] == part for i in range(len(text_here))) else (0, 0)
                    else:
                        n_common = lcs(part, text_here)
                        tail = part[max(answer - x, 0) :]
                        ok = (n_common, lcs(tail, text_here)) if n_common >= 0.6 * m - 1e-9 else (0, 0)
                    best = max(best, ok)
                common, told = common + best[0], told + best[1]
            if common >= 0.6 * len(w) - 1e-9 and told >= 0.5 * (len(w) - answer):
                found.add((n, item))
    return found


def test_equals_brute_force(spark):
    """All pairs of windows and passages: nothing beyond them is found, and at least 0.9 of them."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) + ("." if r.random() < 0.1 else "") for _ in range(n))
    items = [(i, say(r.choice([1, 2, 4, 7, 9, 20, 40, 90, 150]))) for i in range(40)]
    items += [(40, "What is it? Answer: " + say(4)), (41, "yes"), (42, " ".join(f"o{i}" for i in range(64)) + " zebra"), (43, say(20) + " who? " + say(5))]
    docs = [(0, "yes we did"), (1, "Yes!"), (2, "my zebra ran"), (3, None), (4, "")]
    for _ in range(150):
        words = say(r.randint(0, 90)).split()
        for _ in range(r.randint(0, 2)):
            own = r.choice(items)[1].split()
            share = r.choice([0, 0, 0.2, 0.35, 0.5])
            own = [("z" + str(r.randint(0, 99)) if r.random() < share else w) for w in own][: r.choice([None, None, len(own) // 2 + 1])]
            at = r.randint(0, len(words))
            words[at:at] = own
        docs.append((len(docs), " ".join(words).upper() if r.random() < 0.2 else " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = dc.leaks(frame, spark.createDataFrame(items, "item_id long, text string"), Workspace(spark, "leaks")).collect()
    found, want = {(x["doc_id"], x["item_id"]) for x in rows if x["kind"] == "copy"}, brute(docs, items)
    loose = {(x["doc_id"], x["item_id"]) for x in rows if x["kind"] == "paraphrase"}
    text_of, body_of = dict(docs), dict(items)
    for d, i in loose:  # half of its words are there in any order, and it was put in
        own = Counter(words_of(body_of[i]))
        assert (own & Counter(words_of(text_of[d]))).total() >= 0.5 * own.total()
    assert len(want) > 60 and found <= want
    assert len(found) >= 0.9 * len(want)
    assert (1, 41) in found and not any(d in (0, 2) for d, _ in found)


def changes(words, r):
    """Kinds of change to an item's words, its last five (the answer) too unless a kind leaves them."""
    body, answer = words[:-5], words[-5:]
    swap = lambda x: [y for i in range(0, len(x), 2) for y in reversed(x[i : i + 2])]
    runs = [words[i : i + 8] for i in range(0, len(words), 8)]
    other = lambda: "z" + str(r.randint(0, 10**6))
    return {
        "exact": words, "30 % changed": [other() if r.random() < 0.3 else w for w in body] + answer, "half changed": [other() if r.random() < 0.5 else w for w in body] + answer,
        "a foreign word after each": [y for w in words for y in (w, other())], "two after each": [y for w in words for y in (w, other(), other())],
        "neighbours swapped": swap(words), "clauses shuffled": [w for run in r.sample(runs, len(runs)) for w in run],
    }


def recall(spark, cosine=dc.MIN_COSINE):
    """Share found of 40 planted items for each kind of change, and what is found besides."""
    r = random.Random(12)
    word = lambda: "w" + str(int(20_000 ** r.random()))
    items = [(i, " ".join(word() for _ in range(47))) for i in range(40)]
    docs, planted = [], {}
    for i, text in items:
        for kind, own in changes(text.split(), r).items():
            planted[len(docs)] = (kind, i)
            docs.append((len(docs), " ".join([*[word() for _ in range(r.randint(0, 90))], *own, *[word() for _ in range(60)]])))
    docs += [(len(docs) + n, " ".join(word() for _ in range(400))) for n in range(100)]
    rows = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), Workspace(spark, "leaks"), cosine).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    hit = Counter(kind for d, (kind, i) in planted.items() if (d, i) in found)
    return {kind: hit[kind] / 40 for kind, _ in planted.values()}, found - {(d, i) for d, (_, i) in planted.items()}


def test_recall_by_kind_of_change(spark):
    shares, besides = recall(spark)
    print(shares)
    assert not besides
    assert shares["exact"] == shares["a foreign word after each"] == shares["clauses shuffled"] == 1
    assert shares["30 % changed"] >= 0.95 and shares["two after each"] >= 0.9 and shares["neighbours swapped"] >= 0.9 and shares["half changed"] >= 0.5


def test_paraphrases_come_from_the_latent_search(spark):
    """With the search off, what is no copy in order is not found."""
    shares, besides = recall(spark, 9.0)
    print(shares)
    assert not besides and shares["exact"] == 1
    assert shares["neighbours swapped"] <= 0.1 and shares["half changed"] <= 0.3 and shares["clauses shuffled"] < 0.5


def test_long_text_and_many_passages_stay_bounded():
    """Cosines and postings of a long text come in blocks, and agree with the whole."""
    r = np.random.default_rng(4)
    vector, latent = r.normal(size=(3000, 8)).astype(np.float32), r.normal(size=(50, 8)).astype(np.float32)
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    length = np.linalg.norm(vector, axis=1)
    whole = [x.tolist() for x in np.nonzero(vector @ latent.T >= dc.MIN_COSINE * length[:, None])]
    queries = [dc.Query(i, 0, [b"w%d" % x for x in r.integers(0, 60, 30)], 3, 30, 3) for i in range(50)]
    postings = dc.rare_terms(queries, r.random(dc.TERMS).astype(np.float32))
    words = [b"w%d" % x for x in r.integers(0, 90, 6000)]
    term, block = dc.terms_of(words), np.arange(6000) // 16
    args = (term, block, np.array([0, 200, 375]), np.repeat([0, 1], [200, 175]), postings, np.full(50, 2))
    shared = {tuple(x) for x in np.stack(dc.sharing(*args), axis=1).tolist()}
    before = dc.COSINE_BYTES, dc.SHARED_AT_ONCE, dc.RUN_BLOCKS
    dc.COSINE_BYTES, dc.SHARED_AT_ONCE, dc.RUN_BLOCKS = 4000, 500, 3
    try:
        assert [x.tolist() for x in dc.near(vector, length, latent)] == whole
        assert {tuple(x) for x in np.stack(dc.sharing(*args), axis=1).tolist()} == shared and len(shared) > 100
    finally:
        dc.COSINE_BYTES, dc.SHARED_AT_ONCE, dc.RUN_BLOCKS = before


def test_blocks_of_queries_agree(tables, monkeypatch):
    docs, bench, leaks = tables
    monkeypatch.setattr(dc, "QUERY_BLOCK", 6)
    found = dc.leaks(docs, bench, Workspace(docs.sparkSession, "leaks")).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in found} == leaks


def test_randomised_svd_spans_the_passages(tables):
    docs, bench, _ = tables
    idf = dc.inverse_frequencies(docs)
    rows = dc.passages(bench)
    terms, vectors = dc.randomised_svd(rows, idf)
    items = [[bytes(w) for w in r["words"]] for r in rows.collect()]
    dense = np.zeros((len(items), len(terms)))
    for i, words in enumerate(items):
        term, times = np.unique(dc.terms_of(words), return_counts=True)
        dense[i, np.searchsorted(terms, term)] = times * idf[term]
        dense[i] /= np.linalg.norm(dense[i])
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-4)
    assert np.allclose(dense @ vectors @ vectors.T, dense, atol=1e-3)  # the rank is under RANK here, so nothing is lost


def test_frequencies_count_blocks(spark):
    docs = spark.createDataFrame([("x y x " * 16,), ("x",), (None,)], "text string")
    idf = dc.inverse_frequencies(docs)
    x = dc.terms_of([b"x", b"y"])
    assert np.allclose(idf[x], [np.log(5 / 5) + 1e-3, np.log(5 / 4) + 1e-3], atol=1e-5)


def test_awkward_and_empty(docs, no_docs, spark, workspace):
    none = spark.createDataFrame([], "item_id long, text string, doc_id long")
    assert dc.leaks(docs, none, workspace).count() == 0
    assert dc.leaks(no_docs, spark.createDataFrame(ITEMS, "item_id long, text string"), Workspace(spark, "leaks")).count() == 0
    found = dc.leaks(docs, spark.createDataFrame([(7, prose(1, 120))], "item_id long, text string"), Workspace(spark, "leaks"))
    assert found.where("item_id = 7").count() == docs.where(docs["text"].isin(prose(1, 120), prose(1, 120).upper())).count()
