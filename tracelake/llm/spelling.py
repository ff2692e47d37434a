"""Spelling variants: words one edit apart, through a positional q-gram inverted index.

Words padded by q - 1 marks share all but q of their q-grams when one character differs,
each at the same place or, behind an inserted character, at the next.  Of a word's grams,
rarest first, one of the first q + 1 must be shared, so a word is listed under these (with
place and length) and lists are dealt over tasks.  A task builds the inverted index of a
list, and each word's postings, limited by length and place, are merged by a heap that
skips what cannot reach the overlap bound; what reaches it is verified.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.common import Workspace, broadcast_if_small

Q = 3
#: One in DAMAGE occurrences loses a character.
DAMAGE = 97
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 5, 3, 2
#: Bounds of a task's table of counts in words and bytes, of a list's part in characters, and of words in an Arrow batch.
HELD_WORDS, HELD_BYTES, LIST_CHARACTERS, WORD_ROWS = 1 << 18, 1 << 24, 1 << 17, 2048

#: A-Z, a-z and the first byte of U+00C0 to U+00FF in UTF-8.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
#: Numbers of the letters that words are made of, in Latin-1; 0 pads.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[*range(97, 123), *range(0xC0, 0x100)]] = np.arange(1, 91)
SYMBOLS = 91
#: A gram at a place is one number: its code, and so much more for each place.
PLACE = SYMBOLS**Q


def runs(chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of letters."""
    inside = LETTER[chunk.data]
    inside[1:] |= chunk.data[:-1] == 0xC3
    return chunk.spans(inside)


def damaged(run: bytes, h: int) -> bytes:
    """A run without its code point h % length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of MIN_LENGTH code points and MIN_COUNT occurrences in all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size, crc32 = 0, zlib.crc32

        def told() -> pa.RecordBatch:
            long = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= MIN_LENGTH]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
            for chunk in textvec.chunks(batch.column(1)):
                starts, ends = runs(chunk)
                code, distinct = chunk.codes(starts, ends, lower=True)
                words, n_words = textvec.objects(distinct).tolist(), max(len(distinct), 1)
                pair, times = np.unique(chunk.doc_of(starts) * n_words + code, return_counts=True)
                begun = [crc32(f"{x}:".encode()) for x in ids[chunk.first_row : chunk.first_row + chunk.n_docs]]
                doc, word = pair // n_words, pair % n_words
                h = np.fromiter((crc32(words[w], begun[d]) for d, w in zip(doc.tolist(), word.tolist(), strict=True)), np.int64, len(pair))
                hit = h % DAMAGE == 0
                total = np.bincount(word[~hit], weights=times[~hit], minlength=len(words)).astype(np.int64)
                found = itertools.chain(
                    ((words[i], n) for i, n in enumerate(total.tolist()) if n),
                    ((damaged(words[w], x), n) for w, x, n in zip(word[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True)),
                )
                for w, n in found:
                    before = held.get(w, 0)
                    held[w] = before + n
                    size += 0 if before else len(w)
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield told()
                    held, size = {}, 0
        yield told()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def positional(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, place and code of every padded q-gram of words in Latin-1."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    wide = lengths + 2 * (Q - 1)
    first = np.cumsum(wide) - wide
    owner = np.repeat(np.arange(len(words)), lengths)
    symbols = np.zeros(int(wide.sum()), np.int64)
    symbols[np.arange(len(owner)) + (Q - 1) * (2 * owner + 1)] = SYMBOL[np.frombuffer(b"".join(words), np.uint8)]
    n = lengths + Q - 1
    word = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = first[word] + place
    code = np.zeros(len(word), np.int64)
    for i in range(Q):
        code = code * SYMBOLS + symbols[at + i]
    return word, place, code


def latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def gram_counts(words: DataFrame) -> np.ndarray:
    """In how many places of distinct words each q-gram stands: SYMBOLS ** Q numbers at any size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**Q, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, WORD_ROWS):
                np.add.at(total, positional(latin(batch.column(0).slice(low, WORD_ROWS)))[2], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    sums = words.select("word").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(SYMBOLS**Q, np.int64)
    total[sums["gram"].to_numpy(int)] = sums["n"].to_numpy(int)
    return total


def listed(words: DataFrame, frequency: np.ndarray) -> DataFrame:
    """(key, size, word, n, entry): lists of words of a size that a word is an entry of, and lists of the next size that it asks.

    Two words of sizes a <= b share b - 1 grams, so all but q (a < b) or q + 1 of the
    first of a word's grams in one order can be left out of its lists.
    """
    shared = words.sparkSession.sparkContext.broadcast(frequency)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, WORD_ROWS):
                part = batch.slice(low, WORD_ROWS)
                own = latin(part.column(0))
                word, place, code = positional(own)
                order = np.lexsort((place, code, frequency[code], word))
                length = np.fromiter(map(len, own), np.int64, len(own))
                rank = np.arange(len(word)) - (np.cumsum(length + Q - 1) - (length + Q - 1))[word]
                entry, asks = order[rank <= Q], order[rank < Q]
                w = np.concatenate([word[entry], word[asks], word[asks]])
                p = np.concatenate([place[entry], place[asks], place[asks] + 1])
                size = length[w] + (np.arange(len(w)) >= len(entry))
                keys = textvec.mix((np.concatenate([code[entry], code[asks], code[asks]]) + p * PLACE).astype(np.uint64) + textvec.mix(size.astype(np.uint64)))
                of = pa.array(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(size.astype(np.int32)), part.column(0).take(of), part.column(1).take(of), pa.array(np.arange(len(w)) < len(entry))],
                    names=["key", "size", "word", "n", "entry"],
                )

    return words.select("word", "n").mapInArrow(made, "key long, size int, word string, n long, entry boolean")


def merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(number, lists) of the numbers on ``least`` of some ascending lists or more.

    A heap holds the lists' heads.  Where the least number stands on too few lists, the
    least - 1 lists of the lowest heads go on to the next head: nothing before it can
    be on enough of them.
    """
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, moved = heap[0][0], []
        while heap and heap[0][0] == top:
            moved.append(heapq.heappop(heap))
        if len(moved) >= least:
            yield top, len(moved)
            target = top + 1
        else:
            while heap and len(moved) < least - 1:
                moved.append(heapq.heappop(heap))
            if not heap:
                return
            target = max(heap[0][0], top + 1)
        for _, i, at in moved:
            at = bisect.bisect_left(lists[i], target, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether a and b, which is as long or one longer, differ by exactly one inserted or replaced character."""
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Index:
    """Inverted index of positional q-grams over words of one size."""

    def __init__(self):
        self.words: list[tuple[bytes, int]] = []
        self.postings: dict[int, list[int]] = {}

    def add(self, word: bytes, n: int, grams: list[int]) -> None:
        at, postings = len(self.words), self.postings
        for g in grams:
            if (here := postings.get(g)) is None:
                postings[g] = [at]
            else:
                here.append(at)
        self.words.append((word, n))

    def near(self, word: bytes, grams: list[int], same: bool) -> Iterator[tuple[bytes, int]]:
        """Indexed words one edit from a word of their size (``same``), or from one that is shorter by one."""
        if not self.words:
            return
        get, least = self.postings.get, len(word) - same
        places = grams if same else [at for g in grams for at in (g, g + PLACE)]
        shared = [x for g in places if (x := get(g))]
        if len(shared) >= least:
            for i, _ in merged(shared, least):
                if one_edit(word, self.words[i][0]):
                    yield self.words[i]


def near_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, na, nb), the shorter or lesser word first, of words one edit apart in rows (key, size, piece, word, n, entry), by lists sorted with entries first."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list_of, index = None, Index()
        for batch in batches:
            for low in range(0, batch.num_rows, WORD_ROWS):
                part, out = batch.slice(low, WORD_ROWS), []
                words = latin(part.column(3))
                word, place, code = positional(words)
                grams, edges = (code + place * PLACE).tolist(), [0, *np.cumsum(np.bincount(word, minlength=len(words))).tolist()]
                lists = zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)
                for own, w, n, entry, begin, end in zip(lists, words, part.column(4).to_pylist(), part.column(5).to_pylist(), edges, edges[1:], strict=False):
                    if list_of != own:
                        list_of, index = own, Index()
                    g, same = grams[begin:end], len(w) == own[1]
                    for other, m in index.near(w, g, same):
                        if not same or w < other:
                            out.append((w, other, n, m))
                        elif entry:  # an entry asks those before it, once; others of its size ask the entries of other pieces, and so do these
                            out.append((other, w, m, n))
                    if entry:
                        index.add(w, n, g)
                if out:
                    a, b, na, nb = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*[pa.array([x.decode("latin-1") for x in c], pa.string()) for c in (a, b)], *[pa.array(c, pa.int64()) for c in (na, nb)]], names=["a", "b", "na", "nb"])

    placed = rows.repartition("key", "size", "piece").sortWithinPartitions("key", "size", "piece", F.desc("entry"))
    return placed.select("key", "size", "piece", "word", "n", "entry").mapInArrow(found, "a string, b string, na long, nb long")


def dealt(lists: DataFrame, workspace: Workspace) -> DataFrame:
    """Rows of lists that can hold a pair; a long list in pieces, each with some of its entries and asked by all its words."""
    lists = workspace.keep("lists", lists)
    characters = F.sum(F.when(F.col("entry"), F.length("word")).otherwise(0))
    sizes = lists.groupBy("key", "size").agg(F.count("*").alias("rows"), characters.alias("characters")).where("rows > 1 and characters > 0")
    sizes = workspace.keep("sizes", sizes.select("key", "size", F.ceil(F.col("characters") / LIST_CHARACTERS).cast("int").alias("pieces")))
    rows = lists.join(broadcast_if_small(sizes), ["key", "size"]).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    return rows.withColumn("entry", F.col("entry") & (F.pmod(F.xxhash64("word"), F.col("pieces")) == F.col("piece")))


def roots_of(forms: DataFrame, workspace: Workspace) -> DataFrame:
    """(word, root) of words with a form: the last word on the way of forms.  Pointers double; counts at least double along a way, so it is short."""
    roots = workspace.keep("roots-0", forms.select("word", F.col("form").alias("root")))
    for n in itertools.count(1):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = workspace.keep(f"roots-{n}", roots.select("word", "root").join(broadcast_if_small(on, 256), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not roots.where("moved").limit(1).count():
            return roots.drop("moved")


def variants(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of all documents.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, one in DAMAGE
    without a character (a hash of id and run decides), that have MIN_LENGTH code points
    and MIN_COUNT occurrences.  Near words differ by exactly one inserted, deleted or
    replaced code point; the form is the near word of most occurrences, the first in order
    among equal ones, if it has FORM_RATIO times as many, and the root the last form.

    Null and empty texts have no words; a null id counts as an empty string in the hash.
    Rows that repeat count each.  Texts and words of any length are worked on whole.
    Other columns are not read.  An empty table gives no rows.
    """
    words = workspace.keep("words", counts(docs))
    rows = dealt(listed(words, gram_counts(words)), workspace)
    pairs = workspace.keep("pairs", near_pairs(rows).distinct(), WORD_ROWS)
    both = pairs.unionByName(pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("na").alias("nb"), F.col("nb").alias("na")))
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("near")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.first("na").alias("own"), best.alias("best"))
    fits = -F.col("best.less") >= FORM_RATIO * F.col("own")
    near = workspace.keep("near", near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    found = words.join(near, "word", "left").join(roots_of(near.where("form is not null"), workspace), "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
