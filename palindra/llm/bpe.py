"""Byte-level BPE by an index of pair occurrences, and its inverse.

Texts are cut into pieces (runs of letters, of digits, of other signs, of white space). The symbols of all new
pieces of a part of a partition lie in one list; an index maps every pair of neighbours to all its places. Ranks that
occur are applied in ascending order, each at all its places from left to right, and only the lists of the pairs
around a merge are changed. A worker keeps the ids of pieces it has met.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text, tokens
from .memory import lean

#: Fixed value: how byte-level vocabularies cut texts.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLOCK_BYTES = 1 << 20
#: Pieces looked up at once, symbols indexed at once, and ids kept by a worker.
_AT_ONCE, _SYMBOLS, _POOL = 1 << 17, 1 << 20, 1 << 24
_CODERS: dict = {}


def alphabet() -> list[str]:
    """The letter of every byte in the vocabulary file: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    letters = dict(zip(own, map(chr, own))) | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Coder(tokens.Encoder):
    """Ids and texts by one vocabulary file; one instance a worker (see :func:`coder`)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        names = file["model"]["vocab"]
        letters = alphabet()
        self.byte_ids = np.array([names[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.merges = [(names[a], names[b], names[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in self.merges], np.int64)
        self.ranks: dict[int, int] = {}
        for rank, key in enumerate(keys.tolist()):
            self.ranks.setdefault(key, rank)
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.rank_of_key = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = {c: b for b, c in enumerate(letters)}
        by_id = {i: bytes(back[c] for c in name) for name, i in names.items()} | {i: s.encode() for s, i in self.special.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.letters = np.frombuffer(b"".join(parts), np.uint8)
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.odd: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        super().forget()
        self._add(list(self.special), np.array(list(self.special.values()), np.uint32), np.ones(len(self.special), np.int64))

    def _known_class(self, value: str) -> bool:
        """Whether the pattern and the tokenizer class all characters alike: their Unicode tables differ in age."""
        if value.isascii():
            return True
        for c in set(value):
            if c not in self.odd and not c.isascii():
                probe = f"a{c}{c}b1{c}!{c}"
                self.odd[c] = [len(p) for p in PATTERN.findall(probe)] != [e - b for _, (b, e) in self.cutter.pre_tokenize_str(probe)]
        return not any(self.odd.get(c) for c in set(value))

    def pieces(self, value: str) -> Iterator[list[str]]:
        """The pieces of a text, special tokens by themselves, some at a time."""
        for part in self.split.split(value) if self.split else [value]:
            if part in self.special:
                yield [part]
            elif not self._known_class(part):
                yield [part[b:e] for _, (b, e) in self.cutter.pre_tokenize_str(part)]
            elif len(part) < BLOCK_BYTES:
                yield PATTERN.findall(part)
            else:
                found = (m.group() for m in PATTERN.finditer(part))
                while some := list(islice(found, _AT_ONCE)):
                    yield some

    def merged(self, symbols: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """``symbols`` after all merges, -1 where one was swallowed by its left neighbour; ``inner[i]`` tells that i and i+1 share a piece."""
        n = len(symbols)
        keys = symbols[:-1] << 32 | symbols[1:]
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(inner & (self.keys[spot] == keys))
        ranks = self.rank_of_key[spot[hit]]
        order = np.argsort(ranks, kind="stable")
        active, begin = np.unique(ranks[order], return_index=True)
        lists = np.split(hit[order], begin[1:])
        index: defaultdict[int, list[int]] = defaultdict(list, {int(r): x.tolist() for r, x in zip(active, lists)})
        heap = list(index)
        heapq.heapify(heap)
        sym = symbols.tolist()
        after = np.where(np.append(inner, False)[:n], np.arange(1, n + 1), -1).tolist()
        before = np.where(np.concatenate([[False], inner])[:n], np.arange(-1, n - 1), -1).tolist()
        rank_of = self.ranks.get
        while heap:
            rank = heapq.heappop(heap)
            left, right, new = self.merges[rank]
            for p in sorted(index.pop(rank)):
                q = after[p]
                if sym[p] != left or q < 0 or sym[q] != right:
                    continue  # one of the two was merged since
                sym[p], sym[q] = new, -1
                r = after[p] = after[q]
                o = before[p]
                if r >= 0:
                    before[r] = p
                    if (k := rank_of(new << 32 | sym[r])) is not None:
                        if k not in index:
                            heapq.heappush(heap, k)
                        index[k].append(p)
                if o >= 0 and (k := rank_of(sym[o] << 32 | new)) is not None:
                    if k not in index:
                        heapq.heappush(heap, k)
                    index[k].append(o)
        return np.array(sym, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Add the ids of new pieces, about ``_SYMBOLS`` symbols to an index; a longer piece has one of its own."""
        data = [p.encode() for p in pieces]
        ends = np.cumsum([len(d) for d in data])
        at = 0
        while at < len(pieces):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + _SYMBOLS, "right")))
            symbols = self.byte_ids[np.frombuffer(b"".join(data[at:to]), np.uint8)]
            inner = np.ones(len(symbols) - 1, bool)
            inner[ends[at : to - 1] - base - 1] = False
            out = self.merged(symbols, inner)
            kept = np.concatenate([[0], np.cumsum(out >= 0)])
            first = np.concatenate([[0], ends[at:to] - base])
            self._add(pieces[at:to], out[out >= 0].astype(np.uint32), np.diff(kept[first]))
            at = to

    def looked_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces in turn."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > tokens.KEEP or self.used > _POOL:
            self.forget()
        if new := [p for p in names if p not in self.known]:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.size[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(self.begin[at] - upto[:-1], each) + np.arange(upto[-1])
        return self.pool[take], each

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text d has ``ids[first[d]:first[d+1]]``; null counts as empty."""
        sizes, found, waiting, owners = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)], [], []

        def flush() -> None:
            if waiting:
                ids, each = self.looked_up(waiting)
                found.append(ids)
                upto = np.concatenate([[0], np.cumsum(each)])
                cut = np.cumsum([0, *(n for _, n in owners)])
                np.add.at(sizes, [d for d, _ in owners], np.diff(upto[cut]))
                waiting.clear()
                owners.clear()

        for d, value in enumerate(texts):
            for some in self.pieces(value.as_py() or ""):
                waiting.extend(some)
                owners.append((d, len(some)))
                if len(waiting) >= _AT_ONCE:
                    flush()
        flush()
        return np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def texts(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of ids, special tokens included; what is no UTF-8 becomes U+FFFD, ids outside the vocabulary are skipped."""
        known = (ids >= 0) & (ids < len(self.lengths))
        ids = np.where(known, ids, 0)
        each = np.where(known, self.lengths[ids], 0)
        upto = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(self.begins[ids] - upto[:-1], each) + np.arange(upto[-1])
        data, at = self.letters[take].tobytes(), upto[first]
        return [data[b:e].decode("utf-8", "replace") for b, e in zip(at[:-1], at[1:])]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coder(path: str) -> Coder:
    """The worker's coder for a vocabulary file, made at first use."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text, without special tokens of its own; one that stands in the text is one id.

    Null texts are empty and have no ids, repeated rows and null ids stay, other columns are not read; nothing is shuffled.
    """
    path = vocabulary or default_vocabulary()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches, "text", BLOCK_BYTES):
            ids, first = coder(path).ids(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``rows`` (doc_id, ids) with their text; null or empty lists give empty texts, null ids are skipped."""
    path = vocabulary or default_vocabulary()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                lists = some.column("ids")
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists, pa.array(coder(path).texts(ids, first), pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, text string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
