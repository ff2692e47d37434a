"""How five quality filters interact: what each removes, by the order in which they run.

A row's failures are five bits.  A table says for each of the 32 sets of failures and each
of the 120 orders at which step such a row is removed.  Tasks look rows up there and count
removals with ``np.bincount``; the arrays of counts are summed by part, order and step.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.common import Workspace, broadcast_if_small

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
STEPS = len(FILTERS)
NAMES = ["".join(FILTERS[f] for f in order) for order in ORDERS]
#: Limits of the filters: words, percent of distinct words, percent of capitals.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))

#: The step (from 0) at which a row with these failures goes in this order; STEPS if it stays.
FIRST = np.array([[next((s for s, f in enumerate(order) if failed >> f & 1), STEPS) for order in ORDERS] for failed in range(1 << STEPS)])
#: The filter of each step of each order.
FILTER_AT = np.array(ORDERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PARTS_AT_ONCE = 64


def text_failures(chunk: textvec.Chunk) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    starts, ends = chunk.words()
    owner = chunk.doc_of(starts)
    n_words = np.bincount(owner, minlength=chunk.n_docs)
    code, _ = chunk.codes(starts, ends, lower=False)
    distinct = np.unique(owner * (len(code) + 1) + code) // (len(code) + 1)
    n_distinct = np.bincount(distinct, minlength=chunk.n_docs)
    data = chunk.data
    characters, capitals = chunk.per_doc((data & 0xC0) != 0x80), chunk.per_doc((data >= 65) & (data <= 90))
    fails = [n_words < MIN_WORDS, 100 * n_distinct < MIN_DISTINCT * n_words, 100 * capitals > MAX_CAPITALS * characters, chunk.per_doc(SYMBOL[data]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, high, low) of each row: failures of A to D, and the 128-bit BLAKE2b digest of the text."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [np.zeros(0, np.int32)], []
            for chunk in textvec.chunks(batch.column(2)):
                failed.append(text_failures(chunk))
                raw = chunk.data.tobytes()
                digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in itertools.pairwise(chunk.offsets.tolist())]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.concatenate(failed)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["doc_id", "part", "failed", "high", "low"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(judged, f"doc_id {kind}, part string, failed int, high long, low long")


def removals(part: np.ndarray, n_parts: int, failed: np.ndarray, good: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays (part, order, step) of COUNTS over rows that stand for ``rows`` documents each."""
    n_orders = len(ORDERS)
    at = ((part[:, None] * n_orders + np.arange(n_orders)) * (STEPS + 1) + FIRST[failed]).ravel()

    def lost(weight: np.ndarray) -> np.ndarray:
        found = np.bincount(at, weights=np.repeat(weight, n_orders), minlength=n_parts * n_orders * (STEPS + 1))
        return found.astype(np.int64).reshape(n_parts, n_orders, STEPS + 1)

    def by_filter(has: np.ndarray) -> np.ndarray:
        """Documents by part and filter, laid out by order and step."""
        found = np.stack([np.bincount(part, weights=rows * has[:, f], minlength=n_parts) for f in range(STEPS)], axis=1)
        return found.astype(np.int64)[:, FILTER_AT]

    every = lost(rows)
    removed = every[:, :, :STEPS]
    fails = (failed[:, None] >> np.arange(STEPS) & 1).astype(bool)
    shapley = np.stack([(removed * (FILTER_AT == f)).sum(axis=(1, 2)) for f in range(STEPS)], axis=1)
    return {
        "kept": every.sum(axis=2, keepdims=True) - np.cumsum(removed, axis=2), "removed": removed, "redundant": by_filter(fails) - removed,
        "unique_fails": by_filter(fails & (fails.sum(axis=1) == 1)[:, None]), "good_lost": lost(rows * good)[:, :, :STEPS],
        "toxic_lost": lost(rows * toxic)[:, :, :STEPS], "shapley": shapley[:, FILTER_AT],
    }


def counted(classes: DataFrame) -> DataFrame:
    """Sums of ``removals`` by part, filter_order and step over rows (part, failed, good, toxic, rows)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, steps = np.repeat(np.array(NAMES, object), STEPS), np.tile(np.arange(1, STEPS + 1), len(ORDERS))
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            part, parts = coded.indices.to_numpy(), coded.dictionary
            failed, good, toxic, rows = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            for low in range(0, len(parts), PARTS_AT_ONCE):
                own, some = parts.slice(low, PARTS_AT_ONCE), np.flatnonzero((part >= low) & (part < low + PARTS_AT_ONCE))
                sums = removals(part[some] - low, len(own), failed[some], good[some], toxic[some], rows[some])
                n = len(ORDERS) * STEPS
                columns = [own.take(pa.array(np.repeat(np.arange(len(own)), n))), pa.array(np.tile(names, len(own)), pa.string()), pa.array(np.tile(steps, len(own)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(sums[c].ravel(), pa.int64()) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    made = classes.select("part", "failed", "good", "toxic", "rows").mapInArrow(partial, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return made.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, workspace: Workspace) -> DataFrame:
    """A row for each part (source), filter_order and step: COUNTS of documents, zeros included.

    ``kept`` are left after the step and ``removed`` go in it; ``redundant`` fail its
    filter but went earlier; ``unique_fails`` fail its filter alone; ``good_lost`` and
    ``toxic_lost`` are removed in it and labelled so; ``shapley`` sums what its filter
    removes over all orders.

    A null text is empty and a null source the part ''.  Texts are equal if their 128-bit
    BLAKE2b digests are.  Of equal texts all rows of the least id pass filter E, and so do
    rows without an id, which are no other row's copy or original either.  An id with
    several labels is good or toxic if one of them says so; null labels say nothing.
    Texts of any length are worked on whole; other columns are not read.  An empty table
    has no parts and gives no rows.
    """
    rows = workspace.keep("rows", failures(docs))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(yes("quality"), yes("toxic")).where("quality or toxic")
    told = workspace.keep("told", told)
    named = rows.where("doc_id is not null")
    # joined on id and digest, so copies of a frequent text are dealt over all tasks
    first = named.groupBy(F.col("high").alias("_high"), F.col("low").alias("_low")).agg(F.min("doc_id").alias("_first"))
    same = (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")) & (F.col("doc_id") == F.col("_first"))
    named = named.join(first, same, "left").withColumn("failed", F.col("failed") + F.when(F.col("_first").isNull(), 1 << FILTERS.index("E")).otherwise(0))
    named = named.join(broadcast_if_small(told), F.col("doc_id") == F.col("_id"), "left")
    flags = [F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    every = named.select("part", "failed", *flags).unionByName(rows.where("doc_id is null").select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    classes = every.groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("rows"))
    return counted(classes.repartition("part"))
