"""Byte-level BPE encoding with a priority queue over a linked symbol list, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.bulk import BulkEncoder

# Fixed value: Unicode White_Space, and the published byte-level pre-tokenizer pattern over it.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable, else from U+0100 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(256)]


def pretokens(text: str) -> list[str]:
    return PRETOKEN.findall(text)


class ByteBPE:
    """Vocabulary and merge ranks of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.single = [vocab.get(c) for c in chars]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if s not in self.added}
        pieces |= {i: s.encode() for s, i in self.added.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.added_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.bulk = BulkEncoder(lambda texts: [array("I", self.encode(t)) for t in texts], list(self.added))

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: always the merge of lowest rank, then leftmost.

        Symbols form a doubly linked list; a heap holds (rank, left position, ids of the
        pair).  Entries whose pair has changed meanwhile are stale and skipped.
        """
        ids = [self.single[b] for b in data]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                found = merges.get((made, ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            h = left[i]
            if h >= 0:
                found = merges.get((ids[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of added tokens become their ids."""
        if not text:
            return []
        if self.added_pattern is not None and (found := self.added_pattern.search(text)):
            token = self.added[found[0]]
            return [*self.encode(text[: found.start()]), token, *self._after(text[found.end() :])]
        return self._plain(text)

    def _after(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in self.added_pattern.finditer(text):
            ids += self._plain(text[at : m.start()])
            ids.append(self.added[m[0]])
            at = m.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for token in pretokens(text) for i in self.merge(token.encode())]

    def decode(self, ids: list[int]) -> bytes:
        """The vocabulary strings' bytes end to end."""
        return b"".join(map(self.pieces.__getitem__, ids))


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encoded(column: pa.Array, tokenizer: str) -> Iterator[list[int]]:
    """Ids of each text of a column; distinct pieces of text go through the merge queue once."""
    bpe = load(tokenizer)
    for chunk in textvec.chunks(column):
        ids, counts = bpe.bulk.encode(chunk)
        ends = np.cumsum(counts).tolist()
        for begin, end in zip([0, *ends], ends, strict=False):
            yield ids[begin:end].tolist()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: id, ids array<int>.  A null text is empty and has no ids."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(encoded(batch.column(1), tokenizer), pa.list_(pa.int32()), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(coded, f"`{id_col}` {kind}, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each id sequence: id, text.  Null or empty ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(decoded, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and keep counts and digests only.

    Returns id, n_tokens, ids_sha256, decoded_sha256.  The digests are made where the
    ids are, so the ids (several times the text) cross no process.  A null text is
    empty: no tokens, the digests of the empty string.  Repeated rows stay; texts of any
    length are encoded whole; other columns are not carried.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        decimal = bpe.decimals.__getitem__
        sha = hashlib.sha256
        for batch in batches:
            counts, coded, plain = [], [], []
            for ids in encoded(batch.column(1), tokenizer):
                counts.append(len(ids))
                coded.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                plain.append(sha(bpe.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        digested, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
