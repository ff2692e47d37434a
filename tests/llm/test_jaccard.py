import random
import re
from collections import Counter

import numpy as np
import pytest

from tracelake.llm import common, jaccard
from tracelake.llm.common import Workspace

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, k, percent):
    """Component of every row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), doc) if x is not None), default=None)
    return Counter((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def check(df, k, percent):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = jaccard.classes(df, Workspace(df.sparkSession, "jaccard"), k, percent).collect()
    assert Counter(tuple(r) for r in found) == brute(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_awkward_rows(docs, k, percent):
    check(docs, k, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_edits_and_small_sets(spark, seed):
    r = random.Random(seed)
    rows = []
    for group in range(12):
        words = [f"w{r.randint(0, 40 if group % 3 else 6)}" for _ in range(r.randint(4, 60))]
        for _ in range(14):
            rows.append((len(rows), " ".join(words)))
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(words))
                r.choice([lambda: words.insert(at, f"n{r.randint(0, 9)}"), lambda: words.__setitem__(at, "z"), lambda: words.pop(at) if len(words) > 4 else None])()
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)


def test_small_sets_list_what_links_need():
    for percent in (80, 85):
        for a in range(1, 15):
            for b in range(a, 15):
                if 100 * a >= percent * b:
                    c = jaccard.needed(a, a, percent)
                    assert c <= jaccard.needed(a, b, percent)
                    assert c in jaccard.subset_sizes(a, percent) and c in jaccard.subset_sizes(b, percent)
    assert jaccard.choose_boundary({}, 1.0, 85) == 0
    assert 5 < jaccard.choose_boundary({n: 1000 for n in range(1, 20)}, 3.0, 85) < 20


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100)], "u long, v long")
    found = jaccard.components(links, Workspace(spark, "components"), "c").collect()
    assert {(r["member"], r["root"]) for r in found} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}


def test_no_rows(no_docs, workspace):
    assert jaccard.classes(no_docs, workspace).count() == 0


def test_words_that_a_polynomial_hash_confuses(spark):
    from tests.llm.test_tokens import alike

    check(spark.createDataFrame([*enumerate(alike()), *((i + 2, t + " x y z") for i, t in enumerate(alike()))], "doc_id long, text string"), 4, 85)


@pytest.mark.parametrize("auto", ["10MB", "-1"])
def test_without_broadcasts(spark, monkeypatch, auto):
    """The far side of the size guard gives the same classes."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard, "PAIRS_PER_TASK", 3)  # and lists are dealt over tasks
    monkeypatch.setattr(jaccard, "HOT_COPIES", 1)
    r, rows = random.Random(7), []
    for group in range(6):
        words = [f"w{r.randint(0, 30)}" for _ in range(r.randint(6, 40))]
        for _ in range(10):
            rows.append((len(rows), " ".join(words)))
            words[r.randrange(len(words))] = f"n{r.randint(0, 3)}"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    try:
        check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sets_of_one_node_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 5), (1, 7, 5), (2, 7, 9), (3, 8, 1)], "doc_id long, node long, check long")
    clashes = jaccard.settle_clashes(rows)
    assert list(clashes) == [(7, 9)]
    doc, h = np.array([0, 0, 1]), np.array([3, 4, 5], np.uint64)
    n, node, tell = jaccard.sizes_and_nodes(doc, h, 3, {})
    assert n.tolist() == [2, 1, 0] and len(set(node.tolist())) == 3
    _, moved, _ = jaccard.sizes_and_nodes(doc, h, 3, {(int(node[1]), int(tell[1])): 77, (int(node[0]), 0): 78})
    assert moved.tolist() == [node[0], 77, node[2]]


PLACED = "key long, node long, n int, pos int, list long, rank int, degree long, root long, main long"


@pytest.mark.parametrize("tasks", [5, 4_000_000])
def test_long_lists_give_the_same_pairs(spark, monkeypatch, tasks):
    monkeypatch.setattr(jaccard, "PAIRS_PER_TASK", tasks)
    r = random.Random(11)
    rows = []
    for key in range(3):
        for node in range(60):
            n = r.randint(3, 60)
            length = jaccard.prefix_length(n, 80)
            pos, degree = (r.randrange(length) if key else -1), r.randint(1, 9)  # subsets have lists of their own
            rows.append((key, node, n, pos, 60, r.randint(1, degree), degree, r.choice([1, 1, 2, 3, node]), 1))
    mixed = spark.createDataFrame(rows, PLACED)
    pair = lambda df: {(x["key"], *sorted((x["node"], x["b"]))) for x in df.collect() if 100 * min(x["n"], x["m"]) >= 80 * max(x["n"], x["m"])
                       and (min(x["pos"], x["mpos"]) < 0 or min(x["n"] - x["pos"], x["m"] - x["mpos"]) >= jaccard.needed(x["n"], x["m"], 80))}
    every, few = jaccard.pairs_of_list(mixed, 80), jaccard.pairs_of_long_list(mixed, 80)
    assert pair(every) == pair(few) and len(pair(few)) > 50
    assert few.count() <= every.count()
    assert few.count() == len({(x["key"], *sorted((x["node"], x["b"]))) for x in few.collect()})  # each once


def test_a_list_of_50_000_unlinked_nodes_gives_no_candidates(spark):
    """Sets that share a passage in the last seventh of their prefixes and are else different: no pair is made."""
    rows = spark.range(50_000).selectExpr("1L AS key", "id AS node", "100 AS n", "13 + CAST(id % 8 AS INT) AS pos", "50000L AS list", "1 AS rank", "9L AS degree", "id AS root", "0L AS main")
    assert jaccard.pairs_of_long_list(rows, 80).count() == 0


def test_frequency_classes_come_compressed(spark, monkeypatch):
    """A slot in eight has one of two counts, as small corpora have them: an eighth of the table's bytes reaches the driver."""
    counts = spark.range(1 << (jaccard.SLOT_BITS - 3)).selectExpr("id * 8 as a", "2 + id % 2 as b")
    kind, collect, sizes = type(counts), type(counts).collect, []

    def weighed(self):
        rows = collect(self)
        sizes.append(sum(len(r["data"]) for r in rows))
        return rows

    monkeypatch.setattr(kind, "collect", weighed)
    table = jaccard.frequency_classes(counts)
    slots = np.arange(1 << (jaccard.SLOT_BITS - 3))
    assert (table[slots * 8] == np.minimum(4 * np.log2(2 + slots % 2), 255).astype(np.uint8)).all()
    assert np.count_nonzero(table) == len(slots)
    assert 0 < sizes[0] <= len(table) // 8
