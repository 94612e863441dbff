"""Packing documents into fixed windows by lexical retrieval.

Documents are encoded once into a table of token ids. Term statistics cover the whole corpus: the
document frequency of every token id is summed over all tasks and is as long as the vocabulary.
Documents are dealt to shards by content: one weighted MinHash order of the terms names each by its
first three terms, and Spark sorts the documents by that name, so copies of a document lie side by
side and other neighbours the likelier, the more of their terms' weight they share. Each task then
indexes its documents shard by shard in a BM25 inverted index; the seed of a window retrieves the
best unused neighbours, which fill the window greedily, and the one that no longer fits is cut and
seeds the next window. So a window is padded only where a task's rows end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, text, tokens
from .memory import lean

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
#: Bytes of texts encoded at once, and pieces that a worker keeps: later stages share its memory.
ENCODED, KEPT = 2 << 20, 400_000
#: Rows a shard at most; rows of which the best are sought at once.
SHARD_ROWS, AT_ONCE = 1 << 16, 256
#: A term in more than this share of a shard's rows is kept as a dense row of weights instead of postings.
DENSE = 0.1
K1, B = 1.2, 0.75
ALONE = 2**31 - 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the ids of every whole text with ``end_id``, as little-endian unsigned 32-bit integers.

    Null texts are empty and hold ``end_id`` alone. The table is written once into the shared folder.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        enc.keep = KEPT
        for block in text.blocks(batches, "text", ENCODED):
            ids, first = enc.ids(block.column("text"))
            ids = np.insert(ids.astype("<u4"), first[1:], end_id)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), binary(ids, first + np.arange(len(first)))], names=["doc_id", "ids"])

    return storage.materialize(docs.select("doc_id", "text").mapInArrow(lean(run, "encoders"), "doc_id long, ids binary"), "token-ids")


def binary(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows ``ids[first[k]:first[k+1]]`` as a binary column."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def term_counts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of every row, by row and term."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    key, n = np.unique(row << 32 | ids.astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def statistics(encoded: DataFrame) -> tuple[np.ndarray, float, int]:
    """(document frequency by token id, mean tokens, rows) over all rows; one number a token id reaches the driver."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        df, rows, total = np.zeros(1, np.int64), 0, 0
        for block in text.blocks(batches, "ids"):
            data, offsets = text.flat(block.column("ids"))
            _, term, _ = term_counts(data.view("<u4"), offsets // 4)
            more = np.bincount(term)
            size = max(len(df), len(more))
            df = np.pad(df, (0, size - len(df))) + np.pad(more, (0, size - len(more)))
            rows, total = rows + len(offsets) - 1, total + int(offsets[-1]) // 4
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], used])), pa.array(np.concatenate([[rows, total], df[used]]))], names=["term", "n"])

    found = encoded.select("ids").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(found["term"], found["n"]))
    rows, total = int(by.pop(-2, 0)), int(by.pop(-1, 0))
    df = np.zeros(max(by, default=0) + 1, np.int64)
    df[list(by)] = list(by.values())
    return df, total / max(rows, 1), rows


def term_weights(df: np.ndarray, rows: int) -> np.ndarray:
    """Positive weights of all ids that occur, the smaller the more rows hold them."""
    return np.where(df > 0, np.log1p((rows - df + 0.5) / (df + 0.5)), 0.0).astype(np.float32)


def term_order(df: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The place of every id in a fixed order in which heavier ids tend to come first; ids of a single row are ``ALONE``.

    The first id of a row in this order is a MinHash of its ids: two rows agree on it with the
    probability that their shared ids have among all their ids, by weight.
    """
    chance = (text.mix(np.arange(1, len(df) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) + 0.5
    drawn = -np.log(chance / 2.0**53) / np.where(df > 1, weights, 1.0)
    place = np.full(len(df), ALONE)
    shared = np.flatnonzero(df > 1)
    place[shared[np.argsort(drawn[shared], kind="stable")]] = np.arange(len(shared))
    return place


def names(ids: np.ndarray, first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The three least places of every row's distinct ids, ascending; ``ALONE`` where there are fewer."""
    out = np.full((len(first) - 1, 3), ALONE)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        own, size = place[ids], np.diff(first)[full]
        for k in range(3):
            out[full, k] = np.minimum.reduceat(own, first[full])
            own[own == np.repeat(out[full, k], size)] = ALONE
    return out


def routed(encoded: DataFrame, place: np.ndarray) -> DataFrame:
    """(doc_id, ids) dealt and sorted by content; rows of one name are spread by id, so none is too large for a task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches, "ids"):
            data, offsets = text.flat(block.column("ids"))
            key = names(data.view("<u4"), offsets // 4, place)
            doc = pc.fill_null(block.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            spread = (text.mix(doc.view(np.uint64)) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("ids"), pa.array(key[:, 0] << 32 | key[:, 1]), pa.array(key[:, 2] << 32 | spread)], names=["doc_id", "ids", "name", "rest"])

    keyed = encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(lean(run), "doc_id long, ids binary, name long, rest long")
    return keyed.repartitionByRange("name", "rest").sortWithinPartitions("name", "rest").select("doc_id", "ids")


def shards(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of all batches together, ``SHARD_ROWS`` at most, whose ids hold at most ``limit`` bytes; a larger row is alone."""
    held, size = [], 0
    for block in (part.slice(at, SHARD_ROWS) for part in text.blocks(batches, "ids", limit) for at in range(0, part.num_rows, SHARD_ROWS)):
        if held and sum(b.num_rows for b in held) + block.num_rows > SHARD_ROWS:
            yield pa.concat_batches(held)
            held, size = [], 0
        more = pc.sum(pc.binary_length(block.column("ids"))).as_py() or 0
        at = 0
        if held and size + more > limit:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(block.column("ids")), 0).to_numpy(zero_copy_only=False))
            at = int(np.searchsorted(sizes, limit - size, "right"))
            yield pa.concat_batches([*held, block.slice(0, at)])
            held, size, more = [], 0, more - (int(sizes[at - 1]) if at else 0)
        held.append(block.slice(at))
        size += more
    if held:
        yield pa.concat_batches(held)


class Index:
    """BM25 weights of a shard by term: postings (rows and weights), or for frequent terms one weight a row."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, idf: np.ndarray, mean: float):
        row, term, n = term_counts(ids, first)
        use = idf[term] > 0
        row, term, n = row[use], term[use], n[use]
        size = np.diff(first)
        weights = idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * size[row] / mean))
        self.idf, self.n = idf, len(first) - 1
        frequent = np.flatnonzero(np.bincount(term, minlength=len(idf)) > DENSE * self.n)
        self.dense_row = np.full(len(idf), -1)
        self.dense_row[frequent] = np.arange(len(frequent))
        at = self.dense_row[term]
        self.dense = np.zeros((len(frequent), self.n), np.float32)
        self.dense[at[at >= 0], row[at >= 0]] = weights[at >= 0]
        row, term, weights = row[at < 0], term[at < 0], weights[at < 0]
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order], weights[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: np.ndarray) -> np.ndarray:
        """The score of every row for the distinct terms of the seed."""
        terms = np.unique(seed)
        terms = terms[self.idf[terms] > 0]
        begin, count = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        dense = self.dense_row[terms]
        # row by row, so that equal documents get equal sums
        return np.bincount(self.rows[at], self.weights[at], self.n) + self.dense[dense[dense >= 0]].sum(0)


class Packer:
    """Fills windows shard by shard; what is open at a shard's end goes on in the next."""

    def __init__(self, idf: np.ndarray, mean: float, window: int, sequence: int):
        self.idf, self.mean, self.window, self.next = idf, mean, window, sequence
        self.sequence, self.room, self.seed = sequence, 0, None
        self.out: list[tuple] = []

    def place(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        """Put a piece that fits into the open window; without one, open one with the piece as seed."""
        if not self.room:
            self.sequence, self.room, self.seed, self.next = self.next, self.window, ids, self.next + 1
        self.out.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, self.window - self.room))
        self.room -= len(ids)

    def shard(self, docs: list, ids: np.ndarray, first: np.ndarray) -> list[tuple]:
        """Pieces of all rows of the shard; every id lies in exactly one."""
        total, window = np.diff(first), self.window
        for d in np.flatnonzero(total >= window):
            for k in range(total[d] // window):
                at = first[d] + k * window
                self.out.append((docs[d], k * window, window, ids[at : at + window].tobytes(), int(total[d]), self.next, 0))
                self.next += 1
        begin = first[:-1] + total // window * window
        left = first[1:] - begin
        own = np.concatenate([[0], np.cumsum(left)])
        take = np.repeat(begin - own[:-1], left) + np.arange(own[-1])
        index = Index(ids[take], own, self.idf, self.mean)
        unused, turn = left > 0, 0

        def put(u: int, most: int) -> None:
            n = min(most, left[u])
            self.place(docs[u], int(begin[u] - first[u]), ids[begin[u] : begin[u] + n], int(total[u]))
            begin[u] += n
            left[u] -= n
            unused[u] = left[u] > 0

        cut = -1  # a row whose head closed the last window seeds the next with its rest
        while unused.any():
            if not self.room:
                while not unused[turn]:
                    turn += 1
                put(cut if cut >= 0 else turn, window)
                cut = -1
                continue
            scores = index.scores(self.seed)
            near = np.flatnonzero((scores > 0) & unused & (left <= self.room))
            while self.room and len(near := near[left[near] <= self.room]):
                # the best rows, ties with the last of them included, before all others
                high = scores[near]
                best = high >= np.partition(high, len(near) - AT_ONCE)[len(near) - AT_ONCE] if len(near) > AT_ONCE else np.ones(len(near), bool)
                head, near = near[best], near[~best]
                head = head[np.argsort(-scores[head], kind="stable")]
                while self.room and len(head := head[left[head] <= self.room]):
                    n = int(np.searchsorted(np.cumsum(left[head]), self.room, "right"))
                    for u in head[:n].tolist():
                        put(u, self.room)
                    head = head[n:]
            while self.room and unused.any():
                open_ = np.where(unused, scores, 0)
                u = int(open_.argmax())
                while not open_[u] and not unused[turn]:
                    turn += 1
                u = u if open_[u] else turn
                put(u, self.room)
                cut = u if unused[u] else -1
        done, self.out = self.out, []
        return done


def pack(encoded: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all rows (doc_id, ids) in sequences of at most ``window`` ids.

    A row is a document, equal ids or not. Rows longer than a window give full windows first; the
    rest of every row is retrieved by BM25 over all its token ids. Ties go to the earlier row. An empty table gives no pieces. Rows are
    shuffled once, by content; a task packs a range of that order and holds one shard at a time.
    """
    df, mean, rows = statistics(encoded)
    idf = term_weights(df, rows)

    def run(batches) -> Iterator[pa.RecordBatch]:
        packer = Packer(idf, max(mean, 1.0), window, TaskContext.get().partitionId() << 32)
        for block in shards(batches, 4 * shard_tokens):
            data, offsets = text.flat(block.column("ids"))
            pieces = packer.shard(block.column("doc_id").to_pylist(), data.view("<u4"), offsets // 4)
            if pieces:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    return routed(encoded, term_order(df, idf)).mapInArrow(lean(run), PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
