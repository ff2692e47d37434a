"""Quality rules: base counts, and a calibrated hashed n-gram logistic regression.

The classifier is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, the rows
of least id hash, so the same rows on any cluster), calibrated on held-out rows of that
sample, and scored over all rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import textvec

TRAIN_ROWS = 4000
#: Bytes of a text in the training sample; with TRAIN_ROWS it bounds what the fitting task holds.
TRAIN_BYTES = 1 << 17
BUCKETS = 1 << 16
CHAR_N = (3, 4)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal one in their document, and which have an equal one before them."""
    keyed = textvec.combine(docs, codes)
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    some, later = np.zeros(len(keyed), bool), np.zeros(len(keyed), bool)
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    later[order[1:][same]] = True
    return some, later


def base_counts(chunk: textvec.Chunk, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The columns of COUNTS for each document of a chunk; lines and words are compared byte by byte."""
    n = chunk.n_docs
    space = textvec.SPACE[chunk.data]
    n_words = np.bincount(docs, minlength=n)
    word_chars = chunk.per_doc(~space & ((chunk.data & 0xC0) != 0x80))
    n_symbols = chunk.per_doc(SYMBOL[chunk.data])
    words_before = np.zeros(len(space) + 1, np.int64)
    np.cumsum(~space, out=words_before[1:])
    at, to = chunk.spans(chunk.data != 10)
    filled = words_before[to] > words_before[at]
    at, to = at[filled], to[filled]
    line_docs = chunk.doc_of(at)
    _, later = _repeats(chunk.codes(at, to, lower=False)[0], line_docs)
    n_dup_lines = np.bincount(line_docs[later], minlength=n)
    words = chunk.codes(starts, ends, lower=False)[0]
    m = max(len(words) - 2, 0)
    first = np.flatnonzero(docs[:m] == docs[2:])
    windows = textvec.combine(textvec.combine(words[first], words[first + 1]), words[first + 2])
    some, _ = _repeats(windows, docs[first])
    covered = np.zeros(len(docs), bool)
    for i in range(3):
        covered[first[some] + i] = True
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, np.bincount(docs[covered], minlength=n)])


def features(chunk: textvec.Chunk, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of each word uni- and bigram and of each character n-gram, by family."""
    words = chunk.span_hash(starts, ends, lower=False)
    found = [((words >> np.uint64(8)).astype(np.int64) % BUCKETS, docs)]
    pairs, first = textvec.shingles(words, docs, 2)
    found.append(((pairs >> np.uint64(8)).astype(np.int64) % BUCKETS, docs[first]))
    chars, owner = chunk.characters()
    for n in CHAR_N:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) ^ chars[i : i + m]
        h *= np.uint32(0x9E3779B1)
        whole = owner[:m] == owner[n - 1 :]
        found.append(((h >> np.uint32(16)).astype(np.int64)[whole], owner[:m][whole]))
    return found


def scores(families: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int) -> np.ndarray:
    """Sum over families of the mean weight of a document's n-grams."""
    total = np.zeros(n_docs)
    for f, (buckets, docs) in enumerate(families):
        count = np.bincount(docs, minlength=n_docs)
        total += np.bincount(docs, weights=weights[f][buckets], minlength=n_docs) / np.maximum(count, 1)
    return total


def _fit(rows: pd.DataFrame) -> np.ndarray:
    """Weights (family, bucket), then bias, calibration slope and offset, as one flat array."""
    n_families = 2 + len(CHAR_N)
    rows = rows.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
    labels = rows["quality"].to_numpy(float)
    flat = np.zeros(n_families * BUCKETS + 3)
    rate = float(np.clip(labels.mean() if len(labels) else 1.0, 0.02, 0.98))
    flat[-3:] = 0.0, 1.0, np.log(rate / (1 - rate))
    if len(set(labels)) < 2 or len(labels) < 30:
        return flat
    index, row, value = [], [], []
    for chunk in textvec.chunks(pa.array(rows["text"].fillna(""), pa.string())):
        starts, ends = chunk.words()
        docs = chunk.doc_of(starts)
        for f, (buckets, owner) in enumerate(features(chunk, starts, ends, docs)):
            key, times = np.unique(owner * BUCKETS + buckets, return_counts=True)
            own = key // BUCKETS
            index.append((key % BUCKETS + f * BUCKETS).astype(np.int32))
            row.append((own + chunk.first_row).astype(np.int32))
            value.append((times / np.bincount(owner, minlength=chunk.n_docs)[own]).astype(np.float32))
    index, row, value = map(np.concatenate, (index, row, value))
    held = np.arange(len(labels)) % 4 == 3
    use = ~held[row]
    at, by, x = index[use], row[use], value[use].astype(float)
    share = np.where(labels == 1, labels[~held].mean(), 1 - labels[~held].mean())
    importance = np.where(held, 0.0, 0.5 / np.maximum(share, 1e-6))
    importance /= importance.sum()
    scale = np.sqrt(np.bincount(at, weights=x * x, minlength=len(flat) - 3) / (~held).sum()) + 1e-4  # per-bucket step
    w, bias, momentum, push = np.zeros(len(flat) - 3), 0.0, np.zeros(len(flat) - 3), 0.0
    for _ in range(80):
        margin = np.bincount(by, weights=x * w[at], minlength=len(labels)) + bias
        error = importance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        slope = np.bincount(at, weights=x * error[by], minlength=len(w)) + 1e-7 * w
        momentum = 0.9 * momentum + slope / scale
        push = 0.9 * push + error.sum()
        w -= 2.0 * momentum / np.sqrt(scale)
        bias -= 2.0 * push
    margin = np.bincount(row, weights=value * w[index], minlength=len(labels)) + bias
    flat[: len(w)], flat[-3] = w, bias
    flat[-2:] = _platt(margin[held], labels[held])
    return flat


def _platt(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that maps held-out margins to chances (smoothed targets)."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones_like(margin)])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        slope = x @ (p - target) + 1e-3 * (beta - [1.0, 0.0])
        curve = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(curve, slope)
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on at most ``rows`` labelled documents of up to TRAIN_BYTES; one executor task holds that sample.

    Of rows that repeat an id the least text counts, so the same model comes of every run.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    )
    sample = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "h").agg(F.min("text").alias("text"))
    fitted = sample.groupBy(F.lit(1).alias("one")).applyInPandas(
        lambda part: pd.DataFrame({"weights": [_fit(part)]}), "weights array<double>"
    ).collect()
    weights = fitted[0]["weights"] if fitted else _fit(pd.DataFrame({"h": [], "doc_id": [], "quality": [], "text": []}))
    return np.asarray(weights)


def score(docs: DataFrame, weights: np.ndarray, keep_from: float = KEEP_FROM) -> DataFrame:
    """Base counts, base_failed, calibrated chance of good quality, and kept, for every row.

    A null or empty text has no words, so it fails the base rule and is not kept.  Very
    long texts are worked on whole; repeated rows each give a row; other columns are not
    carried.  With no usable labels the chance is the labels' base rate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value
        w = flat[:-3].reshape(-1, BUCKETS)
        bias, slope, offset = flat[-3:]
        for batch in batches:
            counts, chance = [], []
            for chunk in textvec.chunks(batch.column(1)):
                starts, ends = chunk.words()
                owners = chunk.doc_of(starts)
                counts.append(base_counts(chunk, starts, ends, owners))
                margin = scores(features(chunk, starts, ends, owners), w, chunk.n_docs) + bias
                chance.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30))))
            if not counts:
                continue
            n_words, word_chars, n_symbols, n_dup_lines, n_repeat = base = np.concatenate(counts, axis=1)
            failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
            p = np.concatenate(chance)
            longs = [pa.array(x, pa.int64()) for x in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *longs, pa.array(failed), pa.array(~failed & (p >= keep_from)), pa.array(p)],
                names=["doc_id", *COUNTS, "base_failed", "kept", "quality_chance"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        scored, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, quality_chance double"
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows, then score every document."""
    return score(docs, fit(docs, labels))
