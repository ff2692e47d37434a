"""Vectorised text primitives over Arrow string buffers (UTF-8 bytes, no Python loop per word).

A ``Chunk`` is a run of whole documents of an Arrow batch; documents are never cut.
Words are maximal runs of bytes outside space and 0x09-0x0D, so on UTF-8 they equal
``[^\\x20\\x09-\\x0D]+``.  Inside a chunk spans are told apart by their bytes (``codes``);
beyond it by keyed SipHash digests (``word_ids``).  ``span_hash`` is a bucketing hash only:
it is linear in the bytes, so unequal spans can be made to collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array

CHUNK_BYTES = 1 << 18
#: Sixteen bytes that key the digests of words.
KEY = "words of a corpus"[:16]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        base = np.full(size, _P if kind == "p" else _P_INV, np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if size <= 8 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arithmetic wraps."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Chunk:
    """Whole documents laid end to end: ``data`` bytes and ``offsets`` (n_docs + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int = 0):
        self.data, self.offsets, self.first_row = data, offsets, first_row
        self.n_docs = len(offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal runs where ``inside`` holds, cut at document ends."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | cut[:n]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.data])

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """Bucketing hash of each span's bytes (its length included); no identity."""
        n = len(self.data)
        if not len(starts):
            return np.zeros(0, np.uint64)
        codes = (LOWER[self.data] if lower else self.data).astype(np.uint64)
        codes += np.uint64(1)
        codes *= _power("p", n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(codes, out=total[1:])
        h = (total[ends] - total[starts]) * _power("i", n)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def codes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, pa.Array]:
        """Number of each span among the chunk's distinct spans, and those (binary), compared byte by byte.

        Spans are in order and do not overlap.
        """
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        held = self.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)] if len(starts) else self.data[:0]
        if lower:
            held = LOWER[held]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(held))])
        coded = packed.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def word_ids(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit digest of each span, the same in every chunk and worker."""
        code, distinct = self.codes(starts, ends, lower)
        return digests(objects(distinct))[code]

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each UTF-8 character as one number, and its document."""
        first = np.flatnonzero((self.data & 0xC0) != 0x80)
        length = np.diff(np.append(first, len(self.data)))
        made = self.data[first].astype(np.uint32)
        for i in range(1, 4):
            more = np.flatnonzero(length > i)
            made[more] |= self.data[first[more] + i].astype(np.uint32) << np.uint32(8 * i)
        return made, self.doc_of(first)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def objects(column: pa.Array) -> np.ndarray:
    """The values of a binary column as an array of bytes objects."""
    return column.to_numpy(zero_copy_only=False)


def digests(spans: np.ndarray) -> np.ndarray:
    """Keyed SipHash of each span (an array of bytes objects) as 64 bits."""
    return hash_array(spans, hash_key=KEY, categorize=False) if len(spans) else np.zeros(0, np.uint64)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, equal for equal pairs only."""
    if not len(a):
        return a.astype(np.int64)
    if (int(a.max()) + 1) * (int(b.max()) + 1) >= 1 << 62:
        a, b = (np.unique(x, return_inverse=True)[1] for x in (a, b))
    return a.astype(np.int64) * (int(b.max()) + 1) + b


def shingles(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside each document, and the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i : i + n])
    at = np.flatnonzero(docs[:n] == docs[k - 1 : k - 1 + n])
    return h[at], at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole documents; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield Chunk(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end
