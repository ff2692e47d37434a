import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from tracelake.llm import quality, textvec


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean prose is good, prose with shouting and symbols is not; nulls and odd labels must not matter."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = prose(i + 100, r.randint(60, 150))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split(" "))))
        labels.append((i, int(good) if i % 2 else None, 0))
    labels += [(None, 1, 0), (3, 1, 1), (5, 7, 0), (10_000, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_base_counts(docs, labelled):
    rows = quality.score(docs, quality.fit(*labelled)).collect()
    want = Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], *[r[c] for c in quality.COUNTS]) for r in rows) == want
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_base_counts_on_random_texts(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "é", "# ", "\n", "a b c ", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for chunk in textvec.chunks(pa.array(texts), 200):
        starts, ends = chunk.words()
        counts = quality.base_counts(chunk, starts, ends, chunk.doc_of(starts))
        for d in range(chunk.n_docs):
            assert tuple(counts[:, d]) == brute(texts[chunk.first_row + d])


def test_held_out_accuracy_and_calibration(labelled):
    docs, labels = labelled
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    unseen = [r for r in rows if r["doc_id"] % 2 == 0]
    right = [(r["quality_chance"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in unseen]
    assert np.mean(right) > 0.95
    assert abs(np.mean([r["quality_chance"] for r in unseen]) - 2 / 3) < 0.1


def test_no_labels_and_no_rows(spark, docs, no_docs, labelled):
    none = labelled[1].where("false")
    assert quality.quality(docs, none).count() == docs.count()
    assert quality.quality(no_docs, labelled[1]).count() == 0
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(20)], labelled[1].schema)
    assert quality.quality(docs, one_class).where("kept").count() > 0


def test_lines_that_a_polynomial_hash_confuses(spark):
    from tests.llm.test_tokens import alike

    one, other = alike()
    text = f"{one}\n{other}\n{one} {other} x {other} {one} x\n{one}"
    for chunk in textvec.chunks(pa.array([text, other])):
        starts, ends = chunk.words()
        counts = quality.base_counts(chunk, starts, ends, chunk.doc_of(starts))
        assert [tuple(counts[:, d]) for d in range(2)] == [brute(text), brute(other)]


def test_chance_equals_plain_scoring(labelled):
    """The same weights, applied by a loop over words and characters."""
    docs, labels = labelled
    weights = quality.fit(docs, labels)
    w, (bias, slope, offset) = weights[:-3].reshape(-1, quality.BUCKETS), weights[-3:]
    rows = {r["doc_id"]: r for r in quality.score(docs, weights).where("doc_id < 12").collect()}
    for doc, text in [tuple(r) for r in docs.where("doc_id < 12").collect()]:
        chunk = next(textvec.chunks(pa.array([text])))
        starts, ends = chunk.words()
        ids = [int(x) for x in chunk.span_hash(starts, ends, lower=False)]
        words = [(x >> 8) % quality.BUCKETS for x in ids]
        pairs = [int(textvec.shingles(np.array(ids[i : i + 2], np.uint64), np.zeros(2, int), 2)[0][0] >> np.uint64(8)) % quality.BUCKETS for i in range(len(ids) - 1)]
        families = [words, pairs]
        for n in quality.CHAR_N:
            grams = []
            for i in range(len(text) - n + 1):
                h = n
                for c in text[i : i + n]:
                    h = (h * 0x01000193 ^ int.from_bytes(c.encode(), "little")) & 0xFFFFFFFF
                grams.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
            families.append(grams)
        margin = bias + sum(np.mean(w[f][b]) for f, b in enumerate(families) if b)
        assert rows[doc]["quality_chance"] == pytest.approx(1 / (1 + np.exp(-(slope * margin + offset))), abs=1e-9)
