"""Removal of near-duplicate lines by an exact set-similarity join over the corpus's lines.

A line is the set of its words. Words are ordered by rarity, read from a table of hashed word counts
of fixed size; any consistent order gives exact results, a good one gives short lists. A line posts
itself under its rarest words only (prefix filter) with its size, its position and a parity sketch;
pairs that pass the length, positional and sketch filters, all of them bounds, are candidates. A line
goes if a line before it, in document and line order, is similar, so of its candidates the earliest
is verified on whole sets first, and later ones only if that one fails: pairs within a group of
similar lines are never listed. Where all links are wanted, they are counted where the whole sets of
a list lie, each in the list of the pair's first common word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bounded, joins, storage, text
from .columns import fresh
from .memory import lean

LEAST = (4, 5)
BLOCK = 1 << 20
#: Rows of a list that one task compares; longer lists are dealt out in pairs of blocks of half as many.
LIST = 1 << 13
#: Candidates that a row names in a list at first: its earliest.
EARLIEST = 8


def word_classes(counts: np.ndarray) -> np.ndarray:
    """Rarity classes of the slots of a table of word counts: eighths of a doubling, below 512."""
    return np.minimum(np.log2(counts + 1.0) * 8, 511).astype(np.uint16)


class Lines:
    """The lines of a block of texts that have a word: owner, number in the text, and their word sets.

    ``hashes[first[k]:first[k+1]]`` are the words of line k; with ``classes`` they are in the global
    order, rarest class first and by hash within one, else by hash. ``chosen`` tells by
    (owner, number) which lines to take.
    """

    def __init__(self, texts: pa.Array, classes: np.ndarray | None = None, chosen=None):
        data, offsets = text.flat(texts)
        breaks = np.flatnonzero(data == 10)
        before = np.searchsorted(breaks, offsets[:-1])
        if chosen is None:
            starts, ends = text.runs(data, offsets, ~text.space(data))
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
            number = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1)[:-1]) - before[owner]
        else:
            low, high = text.runs(data, offsets, data != 10)
            owner = np.searchsorted(offsets, low, "right") - 1
            number = np.searchsorted(breaks, low) - before[owner]
            take = chosen(owner, number) if len(low) else np.zeros(0, bool)
            data, offsets = text.flat(text.strings(data, low[take], high[take])) if take.any() else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            starts, ends = text.runs(data, offsets, ~text.space(data))
            words = np.diff(np.searchsorted(starts, offsets))
            owner, number = np.repeat(owner[take], words), np.repeat(number[take], words)
        h = text.hash_runs(data, starts, ends)
        new = np.ones(len(h), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
        line = np.cumsum(new) - 1
        self.words = h
        self.owner, self.number = owner[new], number[new].astype(np.int64)
        order = _sorted(line, classes[bounded.count_slots(h)] if classes is not None else None, h)
        line, h = line[order], h[order]
        distinct = np.ones(len(h), bool)
        distinct[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        self.hashes, self.line = h[distinct], line[distinct]
        self.size = np.bincount(self.line, minlength=len(self.owner)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def sums(self) -> np.ndarray:
        """Two 64-bit sums of the words of every line, whatever their order: the identity of its set."""
        if not len(self.size):
            return np.zeros((0, 2), np.uint64)
        return np.stack([np.add.reduceat(v, self.first[:-1]) for v in (self.hashes, self.hashes * (self.hashes >> np.uint64(32) | np.uint64(1)))], 1)

    def sketches(self) -> np.ndarray:
        """Parity of the words that fall on each of 128 bits: differing bits are at most differing words."""
        if not len(self.size):
            return np.zeros((0, 2), np.uint64)
        bit = np.uint64(1) << (self.hashes & np.uint64(63))
        half = self.hashes >> np.uint64(6) & np.uint64(1)
        return np.stack([np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), self.first[:-1]) for k in (0, 1)], 1)


def _sorted(line: np.ndarray, cls: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """The order by line, class and hash: by one key of their leading bits, unless two hashes differ only below those."""
    bits = max(1, int(line[-1]).bit_length()) if len(line) else 1
    key = line.astype(np.uint64) << np.uint64(64 - bits)
    if cls is not None:
        key |= cls.astype(np.uint64) << np.uint64(55 - bits)
        bits += 9
    key |= h >> np.uint64(bits)
    order = np.argsort(key)
    k, x = key[order], h[order]
    if ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
        return np.lexsort((h, line) if cls is None else (h, cls, line))
    return order


def _scan(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(lines, word counts): (doc, line, set) of every line with a word, and occurrences by hashed word.

    One pass writes both; each task's table of counts is written in chunks, with a null doc.
    """
    chunk = 1 << 12

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bounded.COUNT_BITS, np.uint32)
        for b in text.blocks(batches, "text", BLOCK):
            x = Lines(b.column("text"))
            table += np.bincount(bounded.count_slots(x.words), minlength=len(table)).astype(np.uint32)
            ids = np.ascontiguousarray(x.sums())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(x.owner)), pa.array(x.number), pa.array([r.tobytes() for r in ids], pa.binary())], names=["doc", "line", "digest"])
        parts = table.reshape(-1, chunk)
        used = np.flatnonzero(parts.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(used, pa.int64()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["doc", "line", "digest"])

    both = storage.materialize(docs.mapInArrow(lean(run), "doc long, line long, digest binary"), "lines")

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for k, part in zip(batch.column("line").to_pylist(), batch.column("digest")):
            table[k * chunk : (k + 1) * chunk] += np.frombuffer(part.as_buffer(), np.uint32)

    counts = both.where("doc IS NULL").coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism))
    return both.where("doc IS NOT NULL"), bounded.gather(counts, fill, 1 << bounded.COUNT_BITS, np.int64, np.add)


def _needed(size: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Words that a line of that size must share with any similar line."""
    return -(-least[0] * size // least[1])


#: A posting's place packs line << 36 | size << 8 | position, the position kept below 256.
_SIZE = (1 << 28) - 1
_POSTING = np.dtype([("token", "<i4"), ("doc", "<i8"), ("place", "<i8"), ("sketch_a", "<u8"), ("sketch_b", "<u8"), ("set", "<u8"), ("later", "u1")])
#: Postings of a bucket of rare words.
_BUCKET = 1 << 16


def _postings(docs: DataFrame, classes, least: tuple[int, int], buckets: int, longest: int, only=None) -> DataFrame:
    """(key, data): the prefix of every line that can match another set, packed, by buckets of words.

    Of lines with equal sets in one block only the first is posted. A token is 32 bits of a word's
    hash: words that share them only bring more candidates. A word that may have more than
    ``longest`` postings has a key of its own. ``only`` (tokens, lines) holds Bloom filters: only those
    tokens are posted, and those lines are marked as ``later``; without it all are.
    """
    rare = int(np.log2(longest + 1.0) * 8)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in text.blocks(batches, "text", BLOCK):
            x = Lines(b.column("text"), classes.value)
            if not len(x.size):
                continue
            doc = b.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)[x.owner]
            sums = x.sums()
            order = np.lexsort((x.number, doc, sums[:, 1], sums[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (sums[order][1:] != sums[order][:-1]).any(1)
            once = np.zeros(len(order), bool)
            once[order[new]] = True
            # smaller sets are similar only to equal ones
            once &= x.size * (least[1] - least[0]) >= least[0]
            position = np.arange(len(x.line)) - x.first[:-1][x.line]
            post = (position < (x.size - _needed(x.size, least) + 1)[x.line]) & once[x.line]
            token = x.hashes >> np.uint64(32)
            if only is not None:
                post[post] = bounded.passes(only[0].value, token[post])
            line, token = x.line[post], token[post]
            rows = np.zeros(len(line), _POSTING)
            rows["token"] = token.astype(np.uint32).view(np.int32)
            rows["doc"] = doc[line]
            rows["place"] = x.number[line] << 36 | np.minimum(x.size[line], _SIZE) << 8 | np.minimum(position[post], 255)
            sketch = x.sketches()
            rows["sketch_a"], rows["sketch_b"] = sketch[line, 0], sketch[line, 1]
            rows["set"] = (sums[:, 0] ^ text.mix(sums[:, 1]))[line]
            rows["later"] = bounded.passes(only[1].value, _key(doc, x.number))[line] if only is not None else 1
            key = (token * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            often = classes.value[bounded.count_slots(x.hashes[post])] >= rare
            key[often] = buckets + token[often].astype(np.int64)
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            at = np.append(begin, len(key)) * _POSTING.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(rows[order])])
            # in pieces, so that a batch stays small if one text is very long
            for low in range(0, len(begin), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(key[begin[low : low + 4096]]), data.slice(low, 4096).cast(pa.binary())], names=["key", "data"])

    return docs.mapInArrow(lean(run), "key long, data binary")


def _lists(batches, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(postings, begins, long) from packed rows sorted by key: whole lists, each beginning at one of ``begins``.

    The postings of a word that has a key of its own and more than ``longest`` of them come in pieces with long = True.
    """
    key, held, n, long = None, [], 0, False

    def whole() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["token"], kind="stable")]
        yield rows, np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])), long

    for batch in batches:
        for k, data in zip(batch.column("key").to_pylist(), batch.column("data")):
            if k != key:
                if held:
                    yield from whole()
                key, held, n, long = k, [], 0, False
            held.append(np.frombuffer(data.as_buffer(), _POSTING))
            n += len(held[-1])
            if n > longest and k >= buckets:
                long = True
                yield from whole()
                held, n = [], longest
    if held:
        yield from whole()


_FOUND = ["doc", "line", "f_doc", "f_line", "more"]
_HOT = ["token", "doc", "place", "sketch_a", "sketch_b", "set", "later"]


def _list_candidates(rows: np.ndarray, begins: np.ndarray, least: tuple[int, int], most: int | None, side: np.ndarray | None = None, places: bool = False) -> Iterator:
    """(doc, line, f_doc, f_line, more) of the candidates f before a row in whole lists, each beginning at one of ``begins``.

    Only a row's ``most`` earliest ones in a list are named, the last with the list's token in ``more``
    if there are others; if it is None, all those of rows marked ``later``. Of equal sets in a list only
    the earliest counts. With ``side``, pairs of rows of one side are left out. ``places`` gives, in place of
    names, where in ``rows`` the earlier and the later row of each pair stand, for ``most`` None.
    """
    lists_ = np.zeros(len(rows), np.int64)
    lists_[begins] = 1
    lists_ = np.cumsum(lists_)
    own = np.flatnonzero(_first_of_equal(rows, lists_))
    rows, lists_ = rows[own], lists_[own]
    side = None if side is None else side[own]
    token, doc, place, sa, sb, later = (np.ascontiguousarray(rows[c]) for c in _HOT if c != "set")
    line, n, position = place >> 36, place >> 8 & _SIZE, place & 255
    order = np.argsort(lists_ * (_SIZE + 1) + n)
    lists_, token, doc, line, n, position, sa, sb, later = (x[order] for x in (lists_, token, doc, line, n, position, sa, sb, later > 0))
    side = None if side is None else side[order]
    own = own[order]
    # rows by size: the larger sets that the length filter leaves follow a row at once
    width = _SIZE + 1
    upto = np.searchsorted(lists_ * width + n, lists_ * width + np.minimum(least[1] * n // least[0], _SIZE), "right")
    # the smaller set of a pair shares more: only a shorter prefix of it has to be looked at
    early = (position < n - -(-2 * least[0] * n // (least[0] + least[1])) + 1) | (position == 255)
    count = np.where(early, upto - np.arange(len(n)) - 1, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    held, at = np.zeros((2, 0), np.int64), 0

    def named(i: np.ndarray, j: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(i), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(doc[j[part]]), pa.array(line[j[part]]), pa.array(doc[i[part]]), pa.array(line[i[part]]), pa.array(token[j[part]], mask=~more[part])], names=_FOUND)

    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 16), "right")) - 1)
        k = count[at:to]
        i = np.repeat(np.arange(at, to), k)
        j = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], k) + i + 1
        at = to
        # words both must share; at most those from this token on; words in which they may differ
        share = -(-least[0] * (n[i] + n[j]) // (least[0] + least[1]))
        near = np.minimum(n[i] - position[i], n[j] - position[j]) >= share
        if side is not None:
            near &= side[i] != side[j]
        i, j, share = i[near], j[near], share[near]
        near = np.bitwise_count(sa[i] ^ sa[j]).astype(np.int64) + np.bitwise_count(sb[i] ^ sb[j]) <= n[i] + n[j] - 2 * share
        i, j = i[near], j[near]
        before = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (line[i] < line[j]))
        i, j = np.where(before, i, j), np.where(before, j, i)
        # two rows may have one place, if an id occurs twice: then neither is before the other
        distinct = (doc[i] != doc[j]) | (line[i] != line[j])
        if most is None:
            distinct &= later[j]
        i, j = i[distinct], j[distinct]
        if places:
            yield own[i], own[j]
            continue
        if most is None:
            yield from named(i, j, np.zeros(len(i), bool))
            continue
        held = np.concatenate([held, np.stack([i, j])], 1)
        if held.shape[1] > 1 << 18:
            held = _earliest(held, doc, line, most + 1)[0]
    held, nth = _earliest(held, doc, line, most + 1) if most is not None else (held, None)
    if held.shape[1]:
        more = np.zeros(held.shape[1], bool)
        more[:-1] = (nth[:-1] == most - 1) & (nth[1:] == most)
        yield from named(*held[:, nth < most], more[nth < most])


def _first_of_equal(rows: np.ndarray, lists_: np.ndarray) -> np.ndarray:
    """Whether a row is the earliest of those with its set in its list."""
    key = text.mix(rows["set"] + text.mix(lists_.view(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.ones(len(order), bool)
    if not new.all():
        # only rows whose keys are met again are put in order of their places
        new_at = np.flatnonzero(new)
        again = np.repeat(np.diff(np.append(new_at, len(order))) > 1, np.diff(np.append(new_at, len(order))))
        found = order[again]
        found = found[np.lexsort((rows["place"][found] >> 36, rows["doc"][found], key[found]))]
        first[found[1:]] = key[found[1:]] != key[found[:-1]]
    return first


def _earliest(held: np.ndarray, doc: np.ndarray, line: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (earlier, later), the ``most`` earliest of each later row, and which of these each is."""
    i, j = held
    order = np.lexsort((line[i], doc[i], j))
    j = j[order]
    begin = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]])) if len(j) else np.zeros(0, np.int64)
    nth = np.arange(len(j)) - np.repeat(begin, np.diff(np.append(begin, len(j))))
    return held[:, order[nth < most]], nth[nth < most]


def _unpacked(job: pa.Table) -> np.ndarray:
    """Postings from a table of their fields."""
    rows = np.zeros(job.num_rows, _POSTING)
    for c in _HOT:
        values = job.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        rows[c] = values.view(np.uint64) if c.startswith("s") else values
    return rows


def _candidates(postings: DataFrame, least: tuple[int, int], buckets: int, longest: int, most: int | None) -> DataFrame:
    """(doc, line, f_doc, f_line, more) of candidates as _list_candidates gives them.

    The postings of a word that has more than ``longest`` are written and dealt out in pairs of blocks.
    """
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.bool_()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, begins, long in _lists(batches, buckets, longest):
            if long:
                hot = [pa.array(np.ascontiguousarray(rows[c]).astype(k.to_pandas_dtype())) for c, k in zip(_HOT, kinds)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), k) for k in (*[pa.int64()] * 4, pa.int32())), *hot], names=[*_FOUND, *(f"p_{c}" for c in _HOT)])
                continue
            for found in _list_candidates(rows, begins, least, most):
                yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, k) for k in kinds)], names=[*_FOUND, *(f"p_{c}" for c in _HOT)])

    found_schema = "doc long, line long, f_doc long, f_line long, more int"
    schema = found_schema + ", p_token int, p_doc long, p_place long, p_sketch_a long, p_sketch_b long, p_set long, p_later boolean"
    ordered = postings.repartition("key").sortWithinPartitions("key")
    out = storage.materialize(ordered.mapInArrow(lean(run), schema), "line-candidates")
    found = out.where("p_token IS NULL").select(*_FOUND)
    hot = out.where("p_token IS NOT NULL").select(*(F.col(f"p_{c}").alias(c) for c in _HOT))
    if hot.isEmpty():
        return found

    def task(job: pa.Table, own_low: np.ndarray) -> pa.RecordBatch | None:
        rows = _unpacked(job)
        side = None if job.column("low")[0].as_py() == job.column("high")[0].as_py() else own_low
        got = list(_list_candidates(rows, np.zeros(1, np.int64), least, most, side))
        return pa.Table.from_batches(got).combine_chunks().to_batches()[0] if got else None

    jobs = joins.block_jobs(hot.withColumn("items", F.lit(1)), ["doc", "place"], "items", max(1, longest // 2))
    return found.union(storage.materialize(joins.run_jobs(jobs, task, found_schema), "hot-candidates"))


def _key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return text.mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _line_sets(docs: DataFrame, wanted: DataFrame, classes=None) -> DataFrame:
    """(doc, line, hashes) of the lines in ``wanted`` and perhaps others, by one scan behind a Bloom filter of fixed size.

    With ``classes`` the hashes are in the global order, else ascending.
    """
    keys = lambda b: _key(b.column("doc").to_numpy(zero_copy_only=False), b.column("line").to_numpy(zero_copy_only=False))
    table = docs.sparkSession.sparkContext.broadcast(bounded.bloom(wanted.select("doc", "line"), keys))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in text.blocks(batches, "text", BLOCK):
            doc = b.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            x = Lines(b.column("text"), classes.value if classes is not None else None, lambda owner, number, doc=doc: bounded.passes(table.value, _key(doc[owner], number)))
            data = pa.py_buffer(np.ascontiguousarray(x.hashes))
            # cut by rows, so that no batch outgrows the offsets
            sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x.size), [None, pa.py_buffer(x.first * 8), data]).cast(pa.binary()) if len(x.size) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc[x.owner]), pa.array(x.number), sets], names=["doc", "line", "hashes"])

    return docs.mapInArrow(lean(run), "doc long, line long, hashes binary")


def _verified(docs: DataFrame, pairs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The rows (doc, line, f_doc, f_line) of ``pairs`` whose lines are similar.

    Line sets are sent to the row that names them, then to the earlier line of each pair; a line
    that is named by a large part of all rows is dealt to many tasks.
    """
    f = ["f_doc", "f_line"]
    heavy = joins.heavy_keys(pairs.groupBy(*f).agg(F.count("*").alias("n")), f, pairs.count())
    salts = F.coalesce("_salts", F.lit(1))
    asks = pairs.join(heavy, f, "left").withColumn("salt", F.pmod(F.xxhash64("doc", "line"), salts).cast("int")).select("doc", "line", *f, "salt")
    heads = pairs.select(*f).distinct().join(heavy, f, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    asks = storage.materialize(asks.union(heads.select(*f, *f, "salt")), "asked-lines")
    sets = _line_sets(docs, asks).join(asks, ["doc", "line"])

    def check(batches) -> Iterator[pa.RecordBatch]:
        head, own, size = None, None, 0
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("doc", "line", "f_doc", "f_line")))
            good = np.zeros(b.num_rows, bool)
            for k, ((doc, line, f_doc, f_line), x) in enumerate(zip(keys, joins.sets_of(b.column("hashes")))):
                if (f_doc, f_line) != head:
                    # a row's own line comes first; two rows may hold it, if an id occurs twice
                    head, own = (f_doc, f_line), []
                if (doc, line) == head:
                    own.append(x.copy())
                    continue
                good[k] = any(least[1] * (c := len(np.intersect1d(x, y, assume_unique=True))) >= least[0] * (len(x) + len(y) - c) for y in own)
            yield b.select(["doc", "line", "f_doc", "f_line"]).filter(pa.array(good))

    ordered = sets.repartition("f_doc", "f_line", "salt").sortWithinPartitions("f_doc", "f_line", "salt", "doc", "line")
    return ordered.select("doc", "line", "f_doc", "f_line", "hashes").mapInArrow(lean(check), "doc long, line long, f_doc long, f_line long").distinct()


def _firsts(docs: DataFrame, classes, buckets: int, copies: DataFrame, least: tuple[int, int], longest: int, most: int) -> DataFrame:
    """(doc, line, first): the document of the earliest similar line before each line, ``copies`` and blank lines left out.

    First every row's earliest candidate is verified, then the others that were named, and if none
    of these is similar and there are more in a list, that list is taken up again for that row.
    """
    row, f = ["doc", "line"], ["f_doc", "f_line"]
    first = F.struct(*f)
    found = _candidates(_postings(docs, classes, least, buckets, longest), least, buckets, longest, most)
    # what holds for the first of equal lines holds for its copies
    found = found.join(copies.select(*row), row, "left_anti")
    rows = found.groupBy(*row).agg(F.min(first).alias("f"), F.min(F.when(F.col("more").isNotNull(), first)).alias("bound"), F.count_distinct(first).alias("n"))
    rows = storage.materialize(rows.select(*row, "f.f_doc", "f.f_line", "bound", "n"), "line-rows")
    good = storage.materialize(_verified(docs, rows.select(*row, *f), least), "verified-lines")
    failed = storage.materialize(rows.where("n > 1 OR bound IS NOT NULL").join(good, row, "left_anti"), "failed-lines")
    if failed.isEmpty():
        return good.select(*row, F.col("f_doc").alias("first"))
    rest = found.join(failed.select(*row, F.struct(*f).alias("tried")), row).where(first > F.col("tried")).select(*row, *f).distinct()
    second = _verified(docs, storage.materialize(rest, "later-candidates"), least)
    second = storage.materialize(second.groupBy(*row).agg(F.min(first).alias("f")), "verified-lines")
    # beyond the last one that a list named there may be earlier ones than the earliest verified
    open_ = failed.where("bound IS NOT NULL").join(second, row, "left").where("f IS NULL OR f > bound").select(*row)
    open_ = storage.materialize(open_, "open-lines")
    if not open_.isEmpty():
        tokens = found.where("more IS NOT NULL").join(open_, row).select("more").distinct()
        third = storage.materialize(_verified(docs, _reopened(docs, classes, buckets, open_, tokens, least, longest), least), "verified-lines")
        second = second.union(third.groupBy(*row).agg(F.min(first).alias("f")))
    late = good.select(*row, first.alias("f")).union(second)
    return late.groupBy(*row).agg(F.min("f").alias("f")).select(*row, F.col("f.f_doc").alias("first"))


def _by_lists(postings: DataFrame, buckets: int, longest: int, met, schema: str) -> DataFrame:
    """What ``met`` (postings, begins of lists, side) makes of all lists, those of more than ``longest`` rows dealt out in pairs of blocks."""
    kinds, names = [pa.int32(), *[pa.int64()] * 5, pa.bool_()], ["token", "doc", "line", "size"]
    own_kinds = [pa.int32(), *[pa.int64()] * 3]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, begins, long in _lists(batches, buckets, longest):
            if long:
                hot = [pa.array(np.ascontiguousarray(rows[c]).astype(k.to_pandas_dtype())) for c, k in zip(_HOT, kinds)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), k) for k in own_kinds), *hot], names=[*names, *(f"p_{c}" for c in _HOT)])
                continue
            found = met(rows, begins)
            yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, k) for k in kinds)], names=[*names, *(f"p_{c}" for c in _HOT)])

    full = schema + ", p_token int, p_doc long, p_place long, p_sketch_a long, p_sketch_b long, p_set long, p_later boolean"
    out = storage.materialize(postings.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), full), "line-lists")
    found = out.where("p_token IS NULL").select(*names)
    hot = out.where("p_token IS NOT NULL").select(*(F.col(f"p_{c}").alias(c) for c in _HOT))
    if hot.isEmpty():
        return found

    def task(job: pa.Table, own_low: np.ndarray) -> pa.RecordBatch | None:
        rows = _unpacked(job)
        return met(rows, np.zeros(1, np.int64), None if job.column("low")[0].as_py() == job.column("high")[0].as_py() else own_low)

    jobs = joins.block_jobs(hot.withColumn("items", F.lit(1)), ["doc", "place"], "items", max(1, longest // 2))
    return found.union(joins.run_jobs(jobs, task, schema))


def _touched(postings: DataFrame, least: tuple[int, int], buckets: int, longest: int) -> DataFrame:
    """(token, doc, line, size): every line that has a candidate, before or after it, in the list of a word; no pairs are named."""

    def met(rows: np.ndarray, begins: np.ndarray, side: np.ndarray | None = None) -> pa.RecordBatch:
        hit = np.zeros(len(rows), bool)
        for i, j in _list_candidates(rows, begins, least, None, side, True):
            hit[i] = hit[j] = True
        rows = rows[hit]
        arrays = [rows["token"], rows["doc"], rows["place"] >> 36, rows["place"] >> 8 & _SIZE]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], names=["token", "doc", "line", "size"])

    return _by_lists(postings, buckets, longest, met, "token int, doc long, line long, size long")


#: Rows of a list that one task looks at on whole sets, where the list is not a long one; words that are looked up at once.
_SETS, _WORDS = 512, 1 << 20


def _links(docs: DataFrame, classes, buckets: int, copies: DataFrame, least: tuple[int, int], longest: int) -> DataFrame:
    """(doc, line, n, f_doc, f_line): of lines that are the first of their sets, the number of similar sets and the earliest similar line before.

    Pairs are compared and counted where a list's whole sets lie, and never listed: a row counts once a list, by parts that are to be
    added up. Two sets meet in the lists of several words; the pair counts in that of their first common word only, which
    both have posted if they are similar.
    """
    row = ["doc", "line"]
    met = _touched(_postings(docs, classes, least, buckets, longest), least, buckets, longest)
    # lists hold copies only if they are dealt out in blocks
    met = storage.materialize(met.distinct().join(copies.select(*row), row, "left_anti"), "met-lines")
    block = F.when(F.col("rows") <= longest, min(_SETS, max(1, longest // 2))).otherwise(max(1, longest // 2))
    jobs = joins.block_jobs(met, row, "size", block).drop("size")
    rows = jobs.join(_line_sets(docs, met, classes), row).select("token", "low", "high", "own", *row, "hashes")
    schema = "doc long, line long, n long, f_doc long, f_line long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in joins._with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                if held.num_rows < 1 << 12:
                    continue
            if held is None or not held.num_rows:
                continue
            held = held.combine_chunks()
            new = _begins(held)
            cut = held.num_rows if batch is None else int(new[-1])
            if cut:
                yield _counted(held.slice(0, cut).combine_chunks(), least)
            held = held.slice(cut)

    dealt = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    parts = storage.materialize(dealt.mapInArrow(lean(run), schema), "line-links")
    return parts.groupBy(*row).agg(F.sum("n").alias("n"), F.min(F.when(F.col("f_doc").isNotNull(), F.struct("f_doc", "f_line"))).alias("f")).select(*row, "n", "f.f_doc", "f.f_line")


def _begins(jobs: pa.Table) -> np.ndarray:
    ids = np.stack([jobs.column(c).to_numpy().astype(np.int64) for c in ("token", "low", "high")])
    return np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)]))


def _counted(jobs: pa.Table, least: tuple[int, int]) -> pa.RecordBatch:
    """(doc, line, n, f_doc, f_line) of the rows of whole jobs, as :func:`_links` counts them."""
    token, doc, line, own, low, high = (jobs.column(c).to_numpy() for c in ("token", "doc", "line", "own", "low", "high"))
    sets = [x for chunk in jobs.column("hashes").chunks for x in joins.sets_of(chunk)]
    size = np.array([len(x) for x in sets], np.int64)
    first, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate(sets)
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - first[owner]
    # a list's word by its upper half: of two such words the first stands for both
    position = np.full(len(size), 255, np.int64)
    hit = np.flatnonzero((flat >> np.uint64(32)).astype(np.uint32).view(np.int32) == token[owner])[::-1]
    position[owner[hit]] = place[hit]
    rows = np.zeros(len(size), _POSTING)
    rows["token"], rows["doc"], rows["set"], rows["later"] = token, doc, np.arange(len(size)), 1
    rows["place"] = line.astype(np.int64) << 36 | np.minimum(size, _SIZE) << 8 | np.minimum(position, 255)
    bit, half = np.uint64(1) << (flat & np.uint64(63)), flat >> np.uint64(6) & np.uint64(1)
    for k, name in enumerate(("sketch_a", "sketch_b")):
        rows[name] = np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), first[:-1])
    # pairs within one side of two blocks are left to other jobs
    side = np.where(low == high, np.arange(len(size)) + 2, own == low)
    # every word has a number, every (row, word) a key
    number = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    width = int(number.max()) + 1
    keys = np.sort(owner * width + number)

    def shared(i: np.ndarray, j: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Of the first ``upto`` words of rows i how many rows j have."""
        pair = np.repeat(np.arange(len(i)), upto)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(upto) - upto, upto) + first[i][pair]
        key = j[pair] * width + number[at]
        found = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        return np.bincount(pair[found], minlength=len(i))

    order = np.lexsort((line, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n, earliest = np.zeros(len(size), np.int64), np.full(len(size), len(size))
    word = token.astype(np.int32)
    upper = (flat >> np.uint64(32)).astype(np.uint32).view(np.int32)
    for all_i, all_j in _list_candidates(rows, _begins(jobs), least, None, side, True):
        cost = np.cumsum(size[all_i]) // _WORDS
        for part in np.split(np.arange(len(all_i)), np.flatnonzero(cost[1:] != cost[:-1]) + 1):
            i, j = all_i[part], all_j[part]
            # the list's word is the first that both have, by the order of words
            new = shared(i, j, np.where(position[i] < 255, position[i], 0)) == 0
            i, j = i[new], j[new]
            c = shared(i, j, size[i])
            good = joins.alike(c, size[i], size[j], least)
            for k in np.flatnonzero(good & (position[i] >= 255)):  # words before such a place were not looked up
                common = np.flatnonzero(np.isin(sets[i[k]], sets[j[k]]))
                good[k] = upper[first[i[k]] + common[0]] == word[i[k]]
            i, j = i[good], j[good]
            n += np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
            np.minimum.at(earliest, j, rank[i])
    some = np.flatnonzero(n)
    f = order[np.minimum(earliest[some], len(size) - 1)]
    none = earliest[some] == len(size)
    return pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(line[some]), pa.array(n[some]), pa.array(doc[f], mask=none), pa.array(line[f], mask=none)], names=["doc", "line", "n", "f_doc", "f_line"])


def _reopened(docs: DataFrame, classes, buckets: int, rows: DataFrame, tokens: DataFrame, least: tuple[int, int], longest: int) -> DataFrame:
    """(doc, line, f_doc, f_line): all candidates before the lines ``rows`` in the lists of ``tokens``."""
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(bounded.bloom(tokens, lambda b: b.column("more").to_numpy().view(np.uint32).astype(np.uint64)))
    later = sc.broadcast(bounded.bloom(rows, lambda b: _key(b.column("doc").to_numpy(), b.column("line").to_numpy())))
    found = _candidates(_postings(docs, classes, least, buckets, longest, (wanted, later)), least, buckets, longest, None)
    found = found.join(rows, ["doc", "line"], "left_semi").select("doc", "line", "f_doc", "f_line").distinct()
    return storage.materialize(found, "reopened")


def removals(docs: DataFrame, least: tuple[int, int] = LEAST, longest: int = LIST, most: int = EARLIEST) -> DataFrame:
    """(doc, line, first) of every line of rows (doc, text) that repeats an earlier one; first is that one's document.

    Lines are numbered from 0 in each text, blank ones included; blank lines are never removed. Two
    rows with the same id have lines at the same places, none of which is later than the other.
    ``longest`` and ``most`` set how the work is dealt out, not its result.
    """
    return _joined(docs, least, longest, most, False)[0]


def _joined(docs: DataFrame, least: tuple[int, int], longest: int, most: int, every: bool) -> tuple[DataFrame, DataFrame | None]:
    """(``removals``, (doc, similar) of documents with links): with ``every`` all pairs of similar sets are found and counted, else None.

    A link joins two different sets; ``similar`` counts those of all distinct sets of a document.
    """
    spark = docs.sparkSession
    lines, counts = _scan(docs)
    classes = spark.sparkContext.broadcast(word_classes(counts))
    total = lines.count()
    # a line posts about a fifth of its words
    buckets = int(counts.sum() * (least[1] - least[0]) / least[1] + total) // _BUCKET + 1
    place = F.struct("doc", "line")
    equal = lines.groupBy("digest").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1")
    equal = storage.materialize(equal, "equal-sets")
    heavy = joins.heavy_keys(equal.select("digest", "n"), ["digest"], total)
    copies = joins.spread_join(lines, equal.select("digest", "head"), ["digest"], heavy).where(place > F.col("head"))
    copies = storage.materialize(copies.select("doc", "line", F.col("head.doc").alias("h_doc"), F.col("head.line").alias("h_line")), "equal-lines")
    links = _links(docs, classes, buckets, copies, least, longest) if every else None
    if every:
        links = storage.materialize(links, "linked-sets")
        late = links.where("f_doc IS NOT NULL").select("doc", "line", F.col("f_doc").alias("first"))
    else:
        late = _firsts(docs, classes, buckets, copies, least, longest, most)
    late = storage.materialize(late, "late-lines")
    # what is similar to the first of equal lines is similar to its copies
    heads = equal.select(F.col("head.doc").alias("h_doc"), F.col("head.line").alias("h_line")).distinct()
    heads = heads.join(late.select(F.col("doc").alias("h_doc"), F.col("line").alias("h_line"), "first"), ["h_doc", "h_line"], "left")
    heads = heads.select("h_doc", "h_line", F.coalesce("first", "h_doc").alias("first"))
    heavy = joins.heavy_keys(copies.groupBy("h_doc", "h_line").agg(F.count("*").alias("n")), ["h_doc", "h_line"], total)
    gone = joins.spread_join(copies, heads, ["h_doc", "h_line"], heavy).select("doc", "line", F.least("h_doc", "first").alias("first"))
    gone = late.union(gone).groupBy("doc", "line").agg(F.min("first").alias("first"))
    if not every:
        return gone, None
    # a document has a set once, as its first holder or by a copy
    degree = links.select(F.col("doc").alias("h_doc"), F.col("line").alias("h_line"), F.col("n").alias("similar"))
    held = joins.spread_join(copies.select("doc", "h_doc", "h_line").distinct(), degree, ["h_doc", "h_line"], heavy).where("doc <> h_doc")
    held = held.select("doc", "similar").union(degree.select("h_doc", "similar"))
    return gone, held.groupBy("doc").agg(F.sum("similar").alias("similar"))


def dedup(docs: DataFrame, least: tuple[int, int] = LEAST, longest: int = LIST, most: int = EARLIEST, every: bool = False) -> DataFrame:
    """``docs`` with their repeated lines removed from ``text``.

    Adds (n_lines, n_removed, n_links, class_id): lines with a word, those removed, the number of
    other documents that hold their earliest matches, and the smallest id among those documents, the
    row's own if there is none. A removed line goes with its line break. Rows with a null text or
    id are returned as they are, with n_lines 0 for a null text; columns of ``docs`` with one of
    these names are replaced. ``every`` adds n_similar: of all pairs of different word sets in the corpus
    that are similar, those with a set of the document, each of its sets counted once.
    """
    added = ("n_lines", "n_removed", "n_links", "class_id", *(("n_similar",) if every else ()))
    docs = docs.drop(*added)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    gone, linked_docs = _joined(rows, least, longest, most, every)
    columns = docs.columns
    key, found = fresh(columns, "doc", "found")
    first = F.col("first")
    own = F.struct(F.collect_list("line").alias("gone"), F.countDistinct(F.when(first != F.col("doc"), first)).alias("links"), F.min("first").alias("first"))
    per = gone.groupBy("doc").agg(own.alias("own"))
    if every:
        per = per.join(linked_docs, "doc", "full")
    similar = F.coalesce("similar", F.lit(0)) if every else F.lit(0)
    per = per.select(F.col("doc").alias(key), F.struct("own.gone", "own.links", "own.first", similar.cast("long").alias("similar")).alias(found))
    per = storage.materialize(per, "line-removals")
    touched, passed = bounded.split(docs, "doc_id", per.select(key))
    at = columns.index("text")

    def strip(batches, removed: bool = True) -> Iterator[pa.RecordBatch]:
        for b in text.blocks(batches, "text", BLOCK):
            texts, n_gone = b.column("text"), np.zeros(b.num_rows, np.int64)
            links, smallest, similar = pa.array(n_gone), b.column("doc_id").cast(pa.int64()), pa.array(n_gone)
            full = _full_lines(texts)
            if removed:
                texts = texts.to_pylist()
                gone_lines, linked, earliest, similar = (pc.struct_field(b.column(found), n) for n in ("gone", "links", "first", "similar"))
                for k, gone_ in enumerate(gone_lines.to_pylist()):
                    if gone_ and texts[k] is not None:
                        drop = set(gone_)
                        texts[k] = "\n".join(p for n, p in enumerate(texts[k].split("\n")) if n not in drop)
                        n_gone[k] = len(drop)
                texts = pa.array(texts, b.column("text").type)
                links, similar = pc.fill_null(linked, 0), pc.fill_null(similar, 0)
                smallest = pc.min_element_wise(earliest, smallest, skip_nulls=True)
            arrays = [b.column(c) for c in columns]
            arrays[at] = texts
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(full), pa.array(n_gone), links, smallest, *([similar] if every else [])], names=[*columns, *added])

    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in added)])
    both = touched.join(per, touched.doc_id == per[key], "left").select(*columns, found)
    return both.mapInArrow(lean(strip), schema).union(passed(lambda batches: strip(batches, False), schema))


def _full_lines(texts: pa.Array) -> np.ndarray:
    """The number of lines with a word of every text."""
    data, offsets = text.flat(texts)
    starts, _ = text.runs(data, offsets, ~text.space(data))
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])[starts]
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (breaks[1:] != breaks[:-1])
    return np.bincount(owner[new], minlength=len(texts)).astype(np.int64)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), every=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_links", "class_id", "n_similar", F.sha2("text", 256).alias("kept_sha256"))
