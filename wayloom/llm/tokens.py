"""Token ids of whole texts by a public word-level BPE, with each distinct word encoded once per task.

The pre-tokenizer never joins characters across white space, so the ids of a text are those of its
white-space-separated pieces in order. Pieces are found and hashed in numpy (``words``); a bounded cache maps
the hash of a piece to its ids, so the tokenizer runs on new pieces only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from . import words as W

#: Pieces kept by a task's cache; it starts anew beyond this.
CACHE_WORDS = 700_000

_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level BPE writes the bytes that have no printable Latin-1 character: from U+0100 in order.
BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str | None = None, end_id: int | None = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and where their ids are noted
        self.flat = np.zeros(1 << 16, self.width)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece. Plain lower-case Latin letters are one unit of the pre-tokenizer and in normal form
        already, so the model takes them without the pipeline around it; all others go through the pipeline."""
        out: list = [None] * len(texts)
        rest = []
        for k, x in enumerate(texts):
            if x.isalpha() and max(x) < "\u0250" and x == x.lower():
                out[k] = [t.id for t in self.tokenizer.model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_CHARS))]
            else:
                rest.append(k)
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for k, e in zip(rest, fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        first = at = len(self.keys)
        for k in range(0, len(texts), 4096):
            for ids in self._pieces(texts[k : k + 4096]):
                n = len(ids)
                if at == len(self.starts):
                    self.starts, self.lengths = np.resize(self.starts, 2 * at), np.resize(self.lengths, 2 * at)
                while self.used + n > len(self.flat):
                    self.flat = np.resize(self.flat, 2 * len(self.flat))
                self.flat[self.used : self.used + n] = ids
                self.starts[at], self.lengths[at] = self.used, n
                self.used += n
                at += 1
        where = np.searchsorted(self.keys, hashes)
        self.keys, self.places = np.insert(self.keys, where, hashes), np.insert(self.places, where, np.arange(first, at))

    def slice_ids(self, s: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, end id included, and their bounds by document."""
        raw = s.data.tobytes()
        lower = b"<|" not in raw  # special strings are matched before lower-casing
        data = W.LOWER[s.data] if lower else s.data
        starts, ends = W.word_bounds(s)
        # a last . or , after an ASCII letter is a piece of its own
        last = data[ends - 1] if len(ends) else data[:0]
        apart = (ends - starts > 1) & ((last == 0x2E) | (last == 0x2C))
        apart[apart] = W.ASCII_LETTER[data[ends[apart] - 2]]
        cut = np.flatnonzero(apart)
        starts = np.insert(starts, cut + 1, ends[cut] - 1)
        ends = np.insert(ends, cut, ends[cut] - 1)
        bounds = np.searchsorted(starts, s.offsets)
        hashes, first, inverse = np.unique(W.range_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, hashes)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            text = data.tobytes()
            self._learn(hashes[new], [text[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        index = self.places[np.searchsorted(self.keys, hashes)][inverse]
        lengths = self.lengths[index]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        total = int(sums[-1])
        body = self.flat[np.repeat(self.starts[index] - sums[:-1], lengths) + np.arange(total)]
        out_bounds = sums[bounds]
        if self.end_id is None:
            return body, out_bounds
        return np.insert(body, out_bounds[1:], self.end_id), out_bounds + np.arange(len(out_bounds))

    def encode(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) by slice of a string column."""
        for s in W.slices(column):
            yield (s.first, *self.slice_ids(s))
