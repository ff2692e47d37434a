"""Benchmark decontamination by latent semantic retrieval and paraphrase checks.

Benchmark items are cut into passages.  Their TF-IDF matrix (inverse frequencies counted
over the 16-word blocks of all documents) gets a randomised SVD whose products with the
matrix are Spark jobs.  Every 32-word window of every document, 16 words apart, is
compared with the passages' latent vectors; pairs of enough cosine are checked by the
longest common subsequence of the passage and the text around the window, word by word,
for the whole item and for its answer.  The basis holds few directions and a window few
words, so pairs that share enough rare words are checked for a copy whatever their cosine.

Paraphrases that move words about, or replace half of them, are no subsequence.  What the
latent search finds may therefore lack more words, and counts as well if the rarer half of
the passage's words is there clause by clause, in whatever order the clauses stand.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.common import Workspace, small_batches

TERMS = 1 << 17
BLOCK_WORDS = 16
PASSAGE_WORDS = 64
RANK, OVERSAMPLE, POWERS = 96, 8, 2
MIN_COSINE = 0.3
MIN_COMMON = 0.6
MIN_ANSWER = 0.5
#: Paraphrases: words in any order for a check at all, of the rarer half of the words, of the item, and words of a clause.
MIN_KEPT, MIN_RARE, MIN_LOOSE, CLAUSE = 0.4, 0.4, 0.45, 6
QUERY_BLOCK = 20_000
#: Items with fewer words must be there word for word, and with fewer than LEAST_WORDS as a whole document.
SHORT_WORDS, LEAST_WORDS = 8, 3
MIN_ANSWER_WORDS = 3
ANSWER_MARK = rb"(?i)\b(?:answer|a)\s*:"

#: Bounds of what a task holds of one text: cosines in bytes, blocks' vectors, pairs, postings met, and blocks of a run of postings.
COSINE_BYTES, BLOCKS_AT_ONCE, PAIRS_AT_ONCE, SHARED_AT_ONCE, RUN_BLOCKS = 16 << 20, 1 << 12, 1 << 12, 1 << 22, 64
GROUP = 4
FOUND = ["doc_id", "row", "item_id", "passage", "n", "n_item", "common", "answer", "loose", "loose_answer", "n_answer", "cosine", "word_at"]

#: Letters, digits and non-ASCII bytes make words here; punctuation parts them.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucketing hashes, document and place in the document of each word."""
    starts, ends = chunk.spans(INSIDE[chunk.data])
    owner = chunk.doc_of(starts)
    first = np.searchsorted(owner, np.arange(chunk.n_docs))
    return chunk.span_hash(starts, ends, lower=True), owner, np.arange(len(owner)) - first[owner]


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) % TERMS


def _blocks(owner: np.ndarray, place: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each word, and the first block of each document (n_docs + 1 numbers)."""
    per_doc = -(-np.bincount(owner, minlength=n_docs) // BLOCK_WORDS)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    return first[owner] + place // BLOCK_WORDS, first


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + blocks) / (1 + blocks with the term)) of each hashed term, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for chunk in textvec.chunks(batch.column(0)):
                words, owner, place = _words(chunk)
                block, first = _blocks(owner, place, chunk.n_docs)
                keys = np.sort(block * TERMS + _terms(words))
                fresh = np.ones(len(keys), bool)
                fresh[1:] = keys[1:] != keys[:-1]
                total += np.bincount(keys[fresh] % TERMS, minlength=TERMS)
                blocks += int(first[-1])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], blocks))], names=["term", "n"])

    sums = docs.select("text").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(TERMS)
    terms, n = sums["term"].to_numpy(int), sums["n"].to_numpy(float)
    counts[terms[terms >= 0]] = n[terms >= 0]
    return np.log((1 + n[terms < 0].sum()) / (1 + counts)).astype(np.float32) + np.float32(1e-3)


def answer_start(text: bytes) -> int:
    """Where the answer of an item begins: behind its last answer mark, else its last question mark, else at its last sentence."""
    body = text.rstrip()
    for mark in (ANSWER_MARK, b"?"):
        at = [m.end() for m in re.finditer(mark if mark is ANSWER_MARK else rb"\?", body)]
        if at and at[-1] < len(body):
            return at[-1]
    ends = [m.end() for m in re.finditer(rb"[.!?](?=\s)|\n", body)]
    return ends[-1] if ends else 0


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, passage, words array<binary>, answer, n_item, n_answer) of each benchmark item.

    An item of over PASSAGE_WORDS words is cut into passages of even length, so none is
    short.  ``answer`` counts the words of the passage's end that belong to the item's
    answer, which is MIN_ANSWER_WORDS long at least and where the item states it
    (``answer_start``); a passage before the answer has none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for chunk in textvec.chunks(batch.column(1)):
                starts, ends = chunk.spans(INSIDE[chunk.data])
                raw = textvec.LOWER[chunk.data].tobytes()
                first = np.searchsorted(chunk.doc_of(starts), np.arange(chunk.n_docs + 1))
                for d in range(chunk.n_docs):
                    a, b = starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]
                    n, begin = len(a), int(chunk.offsets[d])
                    if not n:
                        continue
                    words = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    answer = min(int(np.searchsorted(a, begin + answer_start(raw[begin : chunk.offsets[d + 1]]))), max(n - MIN_ANSWER_WORDS, 0))
                    edges = np.linspace(0, n, -(-n // PASSAGE_WORDS) + 1).astype(int).tolist()
                    for i, (x, y) in enumerate(itertools.pairwise(edges)):
                        out.append((ids[chunk.first_row + d], i, words[x:y], max(y - max(x, answer), 0), n, n - answer))
            if out:
                columns = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.binary()), *[pa.int32()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item_id", "passage", "words", "answer", "n_item", "n_answer"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item_id long, passage int, words array<binary>, answer int, n_item int, n_answer int")


def terms_of(words: list[bytes]) -> np.ndarray:
    """Hashed term of each word (lower case), as in texts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    chunk = textvec.Chunk(np.frombuffer(b"".join(words), np.uint8), np.array([0, int(lengths.sum())]))
    return _terms(chunk.span_hash(ends - lengths, ends, lower=False))


def _rows_of(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of a batch of passages as (row, term, weight), and their words' counts."""
    lists = batch.column(batch.schema.get_field_index("words"))
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    key, times = np.unique(row * TERMS + terms_of(lists.flatten().to_pylist()), return_counts=True)
    row, term = key // TERMS, key % TERMS
    weight = times * idf[term]
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(lengths)))
    return row, term, weight / np.maximum(norm[row], 1e-9), lengths


def _gaussian(term: np.ndarray, width: int) -> np.ndarray:
    """Rows of a fixed random normal matrix, made from the term alone."""
    at = term.astype(np.uint64)[:, None] * np.uint64(2 * width) + np.arange(2 * width, dtype=np.uint64)
    u = (textvec.mix(at + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(float) / 2**53 + 1e-12
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Terms and right singular vectors (term, rank) of the passages' TF-IDF matrix A.

    Each round multiplies A'A with a narrow matrix inside tasks and sums its rows by term;
    the driver orthogonalises what is at most TERMS rows of rank + OVERSAMPLE numbers.
    """
    width = rank + OVERSAMPLE
    sc = rows.sparkSession.sparkContext
    shared_idf = sc.broadcast(idf)
    basis, terms = None, None
    for _ in range(POWERS + 1):
        shared = sc.broadcast((terms, basis))

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, narrow = shared.value
            for batch in batches:
                row, term, weight, lengths = _rows_of(batch, shared_idf.value)
                factor = _gaussian(term, width) if narrow is None else narrow[np.searchsorted(known, term)]
                sketch = np.zeros((len(lengths), width))
                np.add.at(sketch, row, factor * weight[:, None])
                own, at = np.unique(term, return_inverse=True)
                back = np.zeros((len(own), width))
                np.add.at(back, at, sketch[row] * weight[:, None])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(back.ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), lists], names=["term", "y"])

        sums = rows.mapInArrow(product, "term int, y array<double>").groupBy("term").agg(F.array(*[F.sum(F.col("y")[i]) for i in range(width)]).alias("y")).toArrow()
        if not sums.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        order = np.argsort(sums["term"].to_numpy())
        terms = sums["term"].to_numpy()[order].astype(np.int64)
        made = sums["y"].combine_chunks().flatten().to_numpy().reshape(-1, width)[order]
        del sums
        basis, square = np.linalg.qr(made)
        if basis.shape[1] < width:
            basis = np.pad(basis, ((0, 0), (0, width - basis.shape[1])))
    # the last product is A'A of the basis before it: its left singular vectors are those of A'A
    left, strength, _ = np.linalg.svd(square)
    keep = strength[:rank] > 1e-6 * max(strength[0], 1e-30)
    return terms, (basis[:, : left.shape[0]] @ left)[:, :rank][:, keep].astype(np.float32)


def masks(words: list) -> dict:
    """The places of each word of a passage as bits."""
    found: dict = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


def common_length(bits: dict, n: int, text: list) -> int:
    """Length of the longest common subsequence with a passage of n words given as bit masks."""
    full = (1 << n) - 1
    row = full
    for w in text:
        hit = bits.get(w)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


@dataclass(frozen=True)
class Query:
    """A passage to search for; ``answer`` counts the words at its end that are of its item's answer of ``n_answer`` words."""

    item: int
    passage: int
    words: list[bytes]
    answer: int
    n_item: int
    n_answer: int

    @property
    def least(self) -> int:
        """Words that a copy has in order: all of a short item, MIN_COMMON of another."""
        n = len(self.words)
        return n if self.n_item < SHORT_WORDS else math.ceil(MIN_COMMON * n - 1e-9)

    @property
    def least_kept(self) -> int:
        """Words that a paraphrase has in any order."""
        return self.least if self.n_item < SHORT_WORDS else math.ceil(MIN_KEPT * len(self.words) - 1e-9)


def rare_terms(queries: list[Query], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the rarest words of each passage, and how many of them a copy holds at least.

    A text with ``least`` of the n words of a passage leaves out n - least, so of any
    n - least + k of its words it has k.  Words rare in both documents and passages are
    posted.  Returns the first posting of each term (TERMS + 1 numbers), the passages
    posted, and k of each passage.
    """
    at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    needed = np.zeros(len(queries), np.int64)
    every = [terms_of(q.words) for q in queries]
    held = np.bincount(np.concatenate([np.zeros(0, np.int64), *map(np.unique, every)]), minlength=TERMS)
    weight = idf - np.log1p(held)
    for i, (q, terms) in enumerate(zip(queries, every, strict=True)):
        if q.n_item < LEAST_WORDS:
            continue
        n = len(terms)
        needed[i] = min(q.least, max(2, n // 6))
        rare = np.unique(terms[np.argsort(-weight[terms], kind="stable")[: n - q.least + needed[i]]])
        at.append(rare)
        of.append(np.full(len(rare), i, np.int32))
    term, query = np.concatenate(at), np.concatenate(of)
    order = np.argsort(term, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(term, minlength=TERMS))]), query[order], needed


def sharing(term: np.ndarray, block: np.ndarray, first: np.ndarray, block_doc: np.ndarray, postings: tuple, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, passage) where the text around a block has as many rare words of the passage as a copy.

    Runs of blocks are worked on by themselves, with what lies in reach on both sides, so
    that no more than SHARED_AT_ONCE postings (or those of one run's least part) are held.
    """
    posted, query, needed = postings
    times = (posted[1:] - posted[:-1])[term]
    own = np.flatnonzero(times)
    times, at, wide, far = times[own], block[own], len(block_doc) + 1, int(reach.max(initial=0)) + 2
    load = np.concatenate([[0], np.cumsum(times)])
    found_b, found_q, low, n_blocks = [], [], 0, len(block_doc)
    while low < n_blocks:
        begin = np.searchsorted(at, low - far)
        high = at[min(np.searchsorted(load, load[begin] + SHARED_AT_ONCE), len(at) - 1)] - far if len(at) else n_blocks
        high = min(max(int(high), low + RUN_BLOCKS), n_blocks) if load[-1] - load[begin] > SHARED_AT_ONCE else n_blocks
        part = slice(begin, np.searchsorted(at, high + far))
        t = times[part]
        inside = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        key, words = np.unique(query[np.repeat(posted[term[own[part]]], t) + inside].astype(np.int64) * wide + np.repeat(at[part], t), return_counts=True)
        q, b = key // wide, key % wide
        total = np.concatenate([[0], np.cumsum(words)])
        left, right = np.maximum(b - reach[q], first[block_doc[b]]), np.minimum(b + 2 + reach[q], first[block_doc[b] + 1])
        around = total[np.searchsorted(key, q * wide + right)] - total[np.searchsorted(key, q * wide + left)]
        enough = (around >= needed[q]) & (b >= low) & (b < high)
        found_b.append(b[enough])
        found_q.append(q[enough])
        low = high
    return np.concatenate([np.zeros(0, np.int64), *found_b]), np.concatenate([np.zeros(0, np.int64), *found_q])


def latent_blocks(term: np.ndarray, block: np.ndarray, place: np.ndarray, first: np.ndarray, idf: np.ndarray, rows: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vector of each window (a block and the next of its document), and the length of its whole TF-IDF vector.

    ``weighted`` has a last row of zeros, for words that no passage has and for the rest of a short block.
    """
    n_blocks = int(first[-1])
    energy = np.bincount(block, weights=idf[term] ** 2, minlength=n_blocks)
    none = len(weighted) - 1
    at = np.full((n_blocks, BLOCK_WORDS), none, np.int32)
    at[block, place % BLOCK_WORDS] = np.where(rows[term] >= 0, rows[term], none)
    vector = np.zeros((n_blocks, weighted.shape[1]), np.float32)
    for low in range(0, n_blocks, BLOCKS_AT_ONCE):
        some = slice(low, low + BLOCKS_AT_ONCE)
        for i in range(BLOCK_WORDS):
            vector[some] += weighted[at[some, i]]
    inner = np.ones(n_blocks, bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False  # the last block of a document stands alone
    has_next = np.flatnonzero(inner)
    for low in range(0, len(has_next), BLOCKS_AT_ONCE):  # in order, so a next block is not summed yet
        some = has_next[low : low + BLOCKS_AT_ONCE]
        vector[some] += vector[some + 1]
        energy[some] += energy[some + 1]
    return vector, np.sqrt(np.maximum(energy, 1e-9)).astype(np.float32)


def likely_enough(b: np.ndarray, q: np.ndarray, term: np.ndarray, block: np.ndarray, block_doc: np.ndarray, reach: np.ndarray, places: tuple[np.ndarray, np.ndarray], least: np.ndarray) -> np.ndarray:
    """As ``enough_words``, by a hashed table of terms in groups of GROUP blocks: cheap, and true wherever that one is."""
    start, terms = places
    bits = min(max(int(len(term) * 64).bit_length(), 16), 26)
    slot = lambda t, group: ((t * np.uint32(0x9E3779B1) + group * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[slot(term.astype(np.uint32), (block // GROUP).astype(np.uint32))] = True
    found, terms = np.zeros(len(b), bool), terms.astype(np.uint32)
    for low in range(0, len(b), PAIRS_AT_ONCE):
        x, y = b[low : low + PAIRS_AT_ONCE], q[low : low + PAIRS_AT_ONCE]
        n = start[y + 1] - start[y]
        own = terms[np.repeat(start[y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        left, right = np.maximum(x - reach[y], 0) // GROUP, np.minimum(x + 1 + reach[y], len(block_doc) - 1) // GROUP
        there = np.zeros(len(own), bool)
        for i in range(int((right - left).max(initial=-1)) + 1):
            there |= seen[slot(own, np.repeat(np.minimum(left + i, right).astype(np.uint32), n))]
        found[low : low + PAIRS_AT_ONCE] = np.bincount(np.repeat(np.arange(len(x)), n), weights=there, minlength=len(x)) >= least[y]
    return found


def enough_words(b: np.ndarray, q: np.ndarray, term: np.ndarray, block: np.ndarray, first: np.ndarray, block_doc: np.ndarray, reach: np.ndarray, places: tuple[np.ndarray, np.ndarray], least: np.ndarray) -> np.ndarray:
    """Whether the blocks around a window have the terms of ``least`` words of the passage, in any order; no copy lacks them."""
    start, terms = places
    wide = len(block_doc) + 1
    key = np.sort(term * wide + block)
    found = np.zeros(len(b), bool)
    for low in range(0, len(b), PAIRS_AT_ONCE):
        x, y = b[low : low + PAIRS_AT_ONCE], q[low : low + PAIRS_AT_ONCE]
        n = start[y + 1] - start[y]
        own = terms[np.repeat(start[y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] * wide
        left, right = np.maximum(x - reach[y], first[block_doc[x]]), np.minimum(x + 2 + reach[y], first[block_doc[x] + 1])
        at = np.searchsorted(key, own + np.repeat(left, n))
        there = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] < own + np.repeat(right, n))
        found[low : low + PAIRS_AT_ONCE] = np.bincount(np.repeat(np.arange(len(x)), n), weights=there, minlength=len(x)) >= least[y]
    return found


def near(vector: np.ndarray, length: np.ndarray, latent: np.ndarray, cosine: float = MIN_COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(window, passage) of that cosine or more, in blocks of COSINE_BYTES."""
    step, b, q = max(1, COSINE_BYTES // (4 * max(len(latent), 1))), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(vector), step):
        x, y = np.nonzero(vector[low : low + step] @ latent.T >= cosine * length[low : low + step, None])
        b.append(x + low)
        q.append(y)
    return np.concatenate(b), np.concatenate(q)


def _word_for_word(words: list[bytes], text: list[bytes]) -> bool:
    n = len(words)
    return any(text[i : i + n] == words for i in range(len(text) - n + 1))


def clauses(words: list[bytes]) -> list[tuple[dict, int]]:
    """Runs of CLAUSE words (the last one shorter) as bit masks and lengths."""
    runs = [words[i : i + CLAUSE] for i in range(0, len(words), CLAUSE)]
    return [(masks(run), len(run)) for run in runs]


def loose_length(parts: list[tuple[dict, int]], text: list) -> int:
    """Words of clauses that a text has in order inside each clause, whatever the clauses' order."""
    return sum(common_length(bits, n, text) for bits, n in parts)


class Judge:
    """Checks pairs of a passage and the text around a window."""

    def __init__(self, queries: list[Query], idf: np.ndarray):
        self.queries = queries
        self.parts = [(masks(q.words), len(q.words), masks(q.words[-q.answer :]) if q.answer else {}) for q in queries]
        self.idf, self.loose = idf, {}

    def _clauses(self, i: int) -> tuple[list, int, list, list]:
        """Clauses of the rarer half of a passage's words and their number, those of all words, and those of its answer part."""
        if i not in self.loose:
            words, n = self.queries[i].words, len(self.queries[i].words)
            weight = self.idf[terms_of(words)]
            half = np.sort(np.argsort(-weight, kind="stable")[: -(-n // 2)]).tolist()
            self.loose[i] = clauses([words[j] for j in half]), len(half), clauses(words), clauses(words[n - self.queries[i].answer :])
        return self.loose[i]

    def __call__(self, i: int, text: list[bytes], whole: bool, latent: bool) -> tuple[int, int, int, int] | None:
        """Words of passage i that the text has in order and those of its answer part, and both clause by clause; None if it is neither copy nor paraphrase.

        ``whole`` says whether the text is its document.  An item of under LEAST_WORDS
        words counts only as a whole document, one of under SHORT_WORDS word for word.
        Only a ``latent`` neighbour can be a paraphrase; one that is no copy has no words
        in order.
        """
        q, (bits, n, tail) = self.queries[i], self.parts[i]
        if q.n_item < SHORT_WORDS:
            there = whole and text == q.words if q.n_item < LEAST_WORDS else _word_for_word(q.words, text)
            return (n, q.answer, n, q.answer) if there else None
        common = common_length(bits, n, text)
        copy = common >= q.least
        told = common_length(tail, q.answer, text) if copy and q.answer else 0
        if not latent:
            return (common, told, common, told) if copy else None
        rarer, n_rarer, every, answer = self._clauses(i)
        known = [w for w in text if w in bits]
        if loose_length(rarer, known) < MIN_RARE * n_rarer - 1e-9:
            return (common, told, common, told) if copy else None
        loose, loose_told = loose_length(every, known), loose_length(answer, known)
        return (common, told, max(loose, common), max(loose_told, told)) if copy else (0, 0, loose, loose_told)


def search(docs: DataFrame, queries: list[Query], idf: np.ndarray, terms: np.ndarray, vectors: np.ndarray, cosine: float = MIN_COSINE) -> DataFrame:
    """Passages of a bounded block found in all documents: doc_id, row, item_id, passage, n, n_item, common, answer, loose, loose_answer, n_answer, cosine, word_at.

    ``row`` tells rows of one id apart.
    """
    rows = np.full(TERMS, -1, np.int32)
    rows[terms] = np.arange(len(terms))
    latent = np.zeros((len(queries), vectors.shape[1]), np.float32)
    for i, q in enumerate(queries):
        at = terms_of(q.words)
        latent[i] = (vectors[rows[at]] * idf[at][:, None]).sum(axis=0)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    weighted = np.concatenate([vectors * idf[terms][:, None], np.zeros((1, vectors.shape[1]), np.float32)])
    shared = docs.sparkSession.sparkContext.broadcast((queries, idf, rows, weighted, latent, rare_terms(queries, idf)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf, rows, weighted, latent, postings = shared.value
        reach = np.array([-(-len(q.words) // BLOCK_WORDS) for q in queries], np.int64)
        judge, n_queries = Judge(queries, idf), max(len(queries), 1)
        least, kept = (np.array([of(q) for q in queries], np.int64) for of in (lambda q: q.least, lambda q: q.least_kept))
        places = np.cumsum([0, *(len(q.words) for q in queries)]), terms_of([w for q in queries for w in q.words])
        tiny: dict[tuple, list[int]] = {}
        for i, q in enumerate(queries):
            if q.n_item < LEAST_WORDS:
                tiny.setdefault(tuple(q.words), []).append(i)
        for batch in batches:
            ids, keys, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for chunk in textvec.chunks(batch.column(1)):
                starts, ends = chunk.spans(INSIDE[chunk.data])
                owner = chunk.doc_of(starts)
                word_first = np.searchsorted(owner, np.arange(chunk.n_docs + 1))
                place = np.arange(len(owner)) - word_first[owner]
                block, first = _blocks(owner, place, chunk.n_docs)
                if not int(first[-1]):
                    continue
                term = _terms(chunk.span_hash(starts, ends, lower=True))
                vector, length = latent_blocks(term, block, place, first, idf, rows, weighted)
                block_doc = np.repeat(np.arange(chunk.n_docs), np.diff(first))
                close, rare = near(vector, length, latent, cosine), sharing(term, block, first, block_doc, postings, reach)
                enough = []
                for (b, q), words in ((close, kept), (rare, least)):  # a rare neighbour is asked for a copy's words, a latent one for a paraphrase's
                    likely = likely_enough(b, q, term, block, block_doc, reach, places, words)
                    b, q = b[likely], q[likely]
                    sure = enough_words(b, q, term, block, first, block_doc, reach, places, words)
                    enough.append(np.unique(b[sure] * n_queries + q[sure]))
                pairs = np.union1d(*enough)
                latent_pair = np.isin(pairs, enough[0]).tolist()
                raw = textvec.LOWER[chunk.data].tobytes()
                word = lambda lo, hi: [raw[x:y] for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                best: dict[tuple[int, int], tuple] = {}
                for b, i, is_latent in zip(*(x.tolist() for x in divmod(pairs, n_queries)), latent_pair, strict=True):
                    d, n = int(block_doc[b]), len(queries[i].words)
                    at = (b - int(first[d])) * BLOCK_WORDS
                    lo, hi = word_first[d] + max(0, at - n), min(word_first[d + 1], word_first[d] + at + 2 * BLOCK_WORDS + n)
                    seen = judge(i, word(lo, hi), lo == word_first[d] and hi == word_first[d + 1], is_latent)
                    if seen:
                        best[d, i] = max(best.get((d, i), (0,)), (*seen, float(vector[b] @ latent[i] / length[b]), at))
                if tiny:
                    few = np.flatnonzero((np.diff(word_first) > 0) & (np.diff(word_first) < LEAST_WORDS))
                    for d in few.tolist():
                        for i in tiny.get(tuple(word(word_first[d], word_first[d + 1])), []):
                            best[d, i] = (*[len(queries[i].words), queries[i].answer] * 2, float(vector[first[d]] @ latent[i] / length[first[d]]), 0)
                for (d, i), (*words, closest, at) in best.items():
                    q = queries[i]
                    out.append((ids[chunk.first_row + d], keys[chunk.first_row + d], q.item, q.passage, len(q.words), q.n_item, *words, q.n_answer, closest, at))
            if out:
                kinds = [batch.column(0).type, *[pa.int64()] * 10, pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=FOUND)

    kind = docs.schema["doc_id"].dataType.simpleString()
    types = dict.fromkeys(FOUND, "long") | {"doc_id": kind, "cosine": "double"}
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(found, ", ".join(f"{c} {types[c]}" for c in FOUND))


def leaks(docs: DataFrame, benchmark: DataFrame, workspace: Workspace, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, item_id, kind, cosine, common, answer, word_at) of every benchmark item found in a document.

    Items are worked on in blocks of QUERY_BLOCK passages, each against all documents.
    An item is found where passages of MIN_COMMON of its words are there in order, each
    passage with that share of its own, and MIN_ANSWER of its answer (``passages``) with
    them (kind copy).  A stretch about as long as a passage is found whatever its cosine;
    one spread wider by insertions may need the cosine.  Or passages whose windows have
    the cosine ``min_cosine`` and MIN_RARE of the rarer half of their words have MIN_LOOSE of
    the item's words and MIN_ANSWER of its answer, in order inside each clause of CLAUSE
    words (kind paraphrase).  ``common`` and ``answer`` are these shares.  Items of under SHORT_WORDS words must be
    there word for word, those of under LEAST_WORDS words as a whole document.

    Null or empty documents and items match nothing; a repeated row gives its own leaks;
    an item found twice in a document is reported where its first passage fits best.
    Equal items under several ids are each reported.  Items' ids are cast to whole numbers,
    documents' are not; other columns are not read.  Very long texts are worked on whole,
    in blocks of bounded size.  Empty tables give no rows.
    """
    rows = workspace.keep("passages", passages(benchmark))
    with small_batches(docs.sparkSession):
        idf = inverse_frequencies(docs)
        terms, vectors = randomised_svd(rows, idf)
    parts = max(1, -(-rows.count() // QUERY_BLOCK))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "passage"), F.lit(parts)))
    found = None
    for part in range(parts):
        block = [Query(r["item_id"], r["passage"], [bytes(w) for w in r["words"]], r["answer"], r["n_item"], r["n_answer"]) for r in placed.where(F.col("part") == part).collect()]
        hits = search(docs, block, idf, terms, vectors, min_cosine)
        found = hits if found is None else found.unionByName(hits)
    # a repeated row may stand anywhere in the input, so rows are told apart by where they were read
    kept = workspace.keep("found", found)
    items = kept.groupBy("doc_id", "row", "item_id").agg(
        *[F.sum(c).alias(c) for c in ("common", "answer", "loose", "loose_answer")], F.max("n_item").alias("n_item"), F.max("n_answer").alias("n_answer"),
        F.max("cosine").alias("cosine"), F.min_by("word_at", "passage").alias("word_at"),
    )
    share = lambda c, of: F.col(c) / F.col(of)
    copy = (share("common", "n_item") >= MIN_COMMON - 1e-9) & (share("answer", "n_answer") >= MIN_ANSWER)
    paraphrase = (share("loose", "n_item") >= MIN_LOOSE - 1e-9) & (share("loose_answer", "n_answer") >= MIN_ANSWER)
    which = lambda a, b, of: F.when(copy, share(a, of)).otherwise(share(b, of))
    return items.where(copy | paraphrase).select(
        "doc_id", "item_id", F.when(copy, "copy").otherwise("paraphrase").alias("kind"), "cosine", which("common", "loose", "n_item").alias("common"),
        which("answer", "loose_answer", "n_answer").alias("answer"), "word_at")
