"""Bulk encoding with the tokenizers library."""

from __future__ import annotations

from array import array

import numpy as np

from tracelake.llm.bulk import BulkEncoder

MAX_PIECES = 1 << 20


class LibraryEncoder(BulkEncoder):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        found = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", "\n", " b.", "a\n b.\na")]
        a, feed, b, joined = found
        #: The id of a line feed, if it parts pieces: then many are asked for in one text.
        self.feed = feed[0] if len(feed) == 1 and joined == [*a, *feed, *b, *feed, *a] else None
        super().__init__(self._ask, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()], MAX_PIECES)

    def _ask(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has; pieces hold no line feed, so one text has them all."""
        if self.feed is None or len(pieces) < 2:
            return super().learn(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(pieces).decode()], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == self.feed)
        if len(cut) != len(pieces) - 1:
            return super().learn(pieces)
        return ids[ids != self.feed], np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
