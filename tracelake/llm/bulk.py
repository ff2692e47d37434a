"""Bulk byte-level encoding: each distinct piece of text is encoded once.

Byte-level pre-tokens begin at a single space or line feed, and end between a word's last
ASCII letter or digit and its closing punctuation.  So the ids of a text are those of such
pieces end to end.  Pieces are found, hashed, looked up and compared with the bytes in the
table for whole chunks of documents at a time; an encoder gets the new ones.  Documents with other white space, or
with what may be an added token or a space beyond ASCII, go to it whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

from tracelake.llm import textvec

MAX_PIECES = 1 << 19
#: Bytes of pieces in a table; with MAX_PIECES it bounds a worker's memory whatever the texts.
MAX_PIECE_BYTES = 1 << 23

WHITE = np.zeros(256, bool)
WHITE[[32, 10]] = True
ODD = np.zeros(256, bool)
ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[i for i in range(33, 127) if not ALNUM[i]]] = True
# First two bytes of characters among which Unicode White_Space lies.
LEADS = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80), (ord("<"), ord("|"))]


class Pieces:
    """Open-addressing table from piece hashes to runs of ids, with the pieces' bytes, as hashes alone are no identity."""

    def __init__(self):
        self.reset(16)

    def reset(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.text_start, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it is not there."""
        found = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            here = self.keys[slot]
            hit = here == keys[left]
            found[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (here != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found

    def unlike(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of spans whose bytes are not those of their entries."""
        length = (ends - starts).astype(np.int32)
        begin = self.text_start[entry]
        other = length != self.text_start[entry + 1] - begin
        length = np.where(other, 0, length)
        step = np.arange(int(length.sum()), dtype=np.int32)
        first = np.cumsum(length, dtype=np.int32) - length
        differ = data[step + np.repeat((starts - first).astype(np.int32), length)] != self.text[step + np.repeat((begin - first).astype(np.int32), length)]
        if differ.any():
            other[np.unique(np.repeat(np.arange(len(length)), length)[differ])] = True
        return np.flatnonzero(other)

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.entry[at] = keys[free[first]], entries[free[first]]
            on = self.keys[slot] != keys
            keys, entries, slot = keys[on], entries[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def add(self, keys: np.ndarray, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Add pieces with their ids end to end under distinct new keys; without keys they get entries that are not found again."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        entries = np.arange(self.count, self.count + len(pieces), dtype=np.int32)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])
        self.text_start = np.concatenate([self.text_start, self.text_start[-1] + np.cumsum(sizes)])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(pieces), np.uint8)])
        self.count += len(pieces)
        if self.count > 1 << (self.bits - 1):
            old_keys, old_entry = self.keys[self.keys != 0], self.entry[self.keys != 0]
            while self.count > 1 << (self.bits - 1):
                self.bits += 1
            self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old_keys, old_entry)
        self._place(keys, entries[: len(keys)])
        return entries


class BulkEncoder:
    """``ask`` gives the ids of each of some texts; ``added`` are the strings of added tokens."""

    def __init__(self, ask: Callable[[list[str]], list[array]], added: list[str], max_pieces: int = MAX_PIECES):
        if any(not s.startswith("<|") for s in added):
            raise ValueError("an added token that does not start with <| is not provided for")
        self.ask, self.pieces, self.max_pieces = ask, Pieces(), max_pieces

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has."""
        runs = self.ask([x.decode() for x in pieces])
        flat = np.frombuffer(b"".join([r.tobytes() for r in runs]), np.uint32)
        return flat, np.fromiter(map(len, runs), np.int64, len(runs))

    def _odd_docs(self, chunk: textvec.Chunk, white: np.ndarray) -> np.ndarray:
        """Documents that are encoded whole."""
        data, odd = chunk.data, np.zeros(chunk.n_docs, bool)
        bad = ODD[data]
        bad[:-1] |= white[:-1] & white[1:]
        second = data[1:]
        for a, b in LEADS:
            bad[:-1] |= (data[:-1] == a) & (second == b)
        full = np.flatnonzero(np.diff(chunk.offsets))
        first, last = chunk.offsets[full], chunk.offsets[full + 1] - 1
        bad[first] |= white[first]
        bad[last] |= white[last]
        odd[chunk.doc_of(np.flatnonzero(bad))] = True
        return odd

    def encode(self, chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's documents end to end (u32), and how many each document has."""
        data = chunk.data
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(chunk.n_docs, np.int64)
        white = WHITE[data]
        odd = self._odd_docs(chunk, white)
        starts, ends = chunk.spans(~white)
        owner = chunk.doc_of(starts)
        use = ~odd[owner]
        starts, ends, owner = starts[use], ends[use], owner[use]
        inside = np.where(PUNCT[data], -1, np.arange(len(data)))
        stem = np.maximum(np.maximum.accumulate(inside)[ends - 1] + 1, starts) if len(starts) else starts
        cut = (stem > starts) & (stem < ends)
        cut &= ALNUM[data[np.maximum(stem - 1, 0)]]
        stem = np.where(cut, stem, ends)
        headed = starts > chunk.offsets[owner]
        before = data[np.maximum(starts - 1, 0)]
        spaced, fed = headed & (before == 32), headed & (before == 10)
        closed = np.flatnonzero(cut)
        n = len(starts)
        begins, finishes = np.concatenate([starts - spaced, stem[closed]]), np.concatenate([stem, ends[closed]])
        entry = self._entries(chunk, begins, finishes)
        table = self.pieces
        length = table.start[entry + 1] - table.start[entry]
        feed, tail = np.where(fed, length[-1], 0), np.zeros(n, np.int64)
        tail[closed] = length[n:-1]
        size = feed + length[:n] + tail
        # documents' ids: words in order, then whole documents where they belong
        counts = np.bincount(owner, weights=size, minlength=chunk.n_docs).astype(np.int64)
        whole = np.flatnonzero(odd)
        raw = data.tobytes()
        asked = self.ask([raw[chunk.offsets[d] : chunk.offsets[d + 1]].decode() for d in whole])
        counts[whole] = [len(x) for x in asked]
        base = np.concatenate([[0], np.cumsum(counts)])
        run = np.cumsum(size) - size
        first_word = np.searchsorted(owner, np.arange(chunk.n_docs))
        at_word = run - (np.append(run, 0)[first_word] if n else np.zeros(chunk.n_docs, np.int64))[owner] + base[owner] if n else run
        out = np.empty(base[-1], np.uint32)
        for at, which, here in ((at_word[fed], np.full(int(fed.sum()), entry[-1]), length[-1:].repeat(int(fed.sum()))), (at_word + feed, entry[:n], length[:n]), ((at_word + feed + length[:n])[closed], entry[n:-1], length[n:-1])):
            if len(at):
                step = np.arange(int(here.sum())) - np.repeat(np.cumsum(here) - here, here)
                out[np.repeat(at, here) + step] = table.ids[np.repeat(table.start[which], here) + step]
        for d, ids in zip(whole, asked, strict=True):
            out[base[d] : base[d + 1]] = ids
        return out, counts

    def _entries(self, chunk: textvec.Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of all pieces, new ones learnt, and of the line feed at the end."""
        table = self.pieces
        if table.count > self.max_pieces or len(table.text) > MAX_PIECE_BYTES:
            table.reset(16)
        if not table.count:
            table.add(np.zeros(0, np.uint64), [b"\n"], *self.learn([b"\n"]))
        keys = chunk.span_hash(starts, ends, lower=False)
        keys[keys == 0] = 1
        entry = table.find(keys)
        missing = np.flatnonzero(entry < 0)
        raw = chunk.data.tobytes() if len(missing) else b""
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            pieces = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            table.add(new, pieces, *self.learn(pieces))
            entry[missing] = table.find(keys[missing])
        other = table.unlike(entry, chunk.data, starts, ends)
        if len(other):  # pieces that share a hash with another one
            raw = raw or chunk.data.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)]
            distinct = list(dict.fromkeys(pieces))
            own = dict(zip(distinct, table.add(np.zeros(0, np.uint64), distinct, *self.learn(distinct)).tolist(), strict=True))
            entry[other] = [own[x] for x in pieces]
        return np.append(entry, np.int32(0))
