"""Token ids of whole texts by a public tokenizer, encoding every distinct piece once.

The tokenizer splits at white space and, inside a word, between a letter and an ASCII sign other
than the apostrophe, so the ids of a text are the ids of those pieces in turn. A worker keeps the
ids of the pieces it has met; a block in which a special token's opening sign occurs is encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import text
from .memory import kept

KEEP = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
_ENCODERS = kept("encoders")


class Encoder:
    """Ids of string columns; one instance a worker and vocabulary file (see :func:`encoder`).

    ``keep`` is the number of pieces beyond which a worker drops those that it has met in one block only, and all of them if
    most were met again.
    """

    keep = KEEP

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)
        self.used = 0

    def purge(self) -> None:
        """Drop the pieces that were met in one block only; all, if more than half of ``keep`` would stay."""
        kept = np.flatnonzero(self.again[: len(self.known)])
        if 2 * len(kept) > self.keep:
            self.forget()
            return
        names = np.array(list(self.known), object)[kept].tolist()
        begin, size, pool = self.begin[kept], self.size[kept], self.pool
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        self.forget()
        self._add(names, ids, size)

    def whole(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the values, each encoded by itself."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(values, add_special_tokens=False)]
        return np.array([i for ids in lists for i in ids], np.uint32), np.array([len(x) for x in lists], np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Add the ids of new pieces. Words of letters alone are encoded many at a time: each ends with
        its only word-end token; if the count of those disagrees they are encoded one by one."""
        letters = [p for p in pieces if p.isalpha()]
        rest = [p for p in pieces if not p.isalpha()]
        for at in range(0, len(letters), 1000):
            group = letters[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
            if len(ends) == len(group) and ends[-1] == len(ids):
                self._add(group, ids, np.diff(ends, prepend=0))
            else:
                self._add(group, *self.whole(group))
        if rest:
            self._add(rest, *self.whole(rest))

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(pieces) > len(self.begin):
            self.begin, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.again))
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(pieces)] = sizes
        self.begin[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text d has ``ids[first[d]:first[d+1]]``; null counts as empty."""
        data, offsets = text.flat(texts)
        if b"<|" in data.tobytes():
            ids, sizes = self.whole([t or "" for t in texts.to_pylist()])
            return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = text._LOWER[data]
        letter, sign = _LETTER[data], _SIGN[data]
        starts, ends = text.runs(data, offsets, ~text.space(data), letter[:-1] & sign[1:] | sign[:-1] & letter[1:])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = text.strings(data, starts, ends).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > self.keep:
            self.purge()
        before = len(self.known)
        if new := [p for p in pieces if p not in self.known]:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.again[number[number < before]] = True
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.size[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(self.begin[at] - upto[:-1], each) + np.arange(upto[-1])
        return self.pool[take], upto[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made at first use."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
