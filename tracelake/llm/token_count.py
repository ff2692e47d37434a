"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
CACHE_ENTRIES = 400_000
MARK = "▁"


class Automaton:
    """Trie over word-initial and word-internal pieces with failure links.

    Node 0 stands behind the word mark, node 1 is the root of the inner pieces.
    ``pops[v]`` is the number of tokens that following the link of v settles, worked
    out once, so a word is counted in one pass and no piece is ever built.  A character
    that is no piece counts as its UTF-8 bytes (byte fallback): where pieces hold it, it
    stands below node 1 with that many tokens, so only node 1 lacks a link.
    """

    def __init__(self, initial: Iterable[str], inner: Iterable[str], mark_is_piece: bool = True):
        self.next: list[dict[str, int]] = [{}, {}]
        ends: dict[int, int] = {}
        initial, inner = set(initial), set(inner)

        def add(root: int, piece: str, tokens: int) -> None:
            v = root
            for c in piece:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                v = self.next[v][c]
            ends[v] = tokens

        for c in {c for piece in initial | inner for c in piece} - inner:
            add(1, c, len(c.encode()))
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces - {""}:
                add(root, piece, 1)
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        self.fail[0], self.pops[0] = 1, 1 if mark_is_piece else len(MARK.encode())
        queue = [(root, c, v) for root in (0, 1) for c, v in self.next[root].items()]
        for u, c, v in queue:  # grows while it is read: breadth first
            if v in ends:
                self.fail[v], self.pops[v] = 1, ends[v]
            else:
                z, settled = self.fail[u], self.pops[u]
                while c not in self.next[z]:
                    settled += self.pops[z]
                    z = self.fail[z]
                self.fail[v], self.pops[v] = self.next[z][c], settled
            queue += [(v, d, w) for d, w in self.next[v].items()]

    def count(self, word: str) -> int:
        """Tokens of the greedy longest match of one word."""
        nexts, fail, pops = self.next, self.fail, self.pops
        v = total = 0
        for c in word:
            while c not in nexts[v]:
                if v == 1:
                    total += len(c.encode())
                    break
                total += pops[v]
                v = fail[v]
            else:
                v = nexts[v][c]
        while v != 1:
            total += pops[v]
            v = fail[v]
        return total


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str], bool]:
    """Word-initial pieces without their mark, inner pieces, and whether the mark is a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    initial = [p[1:] for p in pieces if p[0] == MARK and MARK not in p[1:]]
    return initial, [p for p in pieces if MARK not in p], MARK in pieces


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


_loaded: dict[str, _Counts] = {}


def _counts(path: str) -> _Counts:
    if path not in _loaded:
        _loaded[path] = _Counts(Automaton(*sentencepiece_vocabulary(path)))
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, code points and word-piece tokens of every whole text.

    Returns id, n_chars, n_words, n_tokens (long).  Null or empty text: zeros.  Repeated
    rows stay; other columns are not carried.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_word = _counts(vocabulary).__getitem__
        for batch in batches:
            chars, words, tokens = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = WORD.findall(text)
                chars.append(len(text))
                words.append(len(found))
                tokens.append(sum(map(per_word, found)))
            longs = [pa.array(x, pa.int64()) for x in (chars, words, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs], names=[id_col, "n_chars", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        counted, f"`{id_col}` {kind}, n_chars long, n_words long, n_tokens long"
    )
