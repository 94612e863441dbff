"""Kernels of the set-similarity joins: pairs within posting lists, and exact checks on whole sets.

Postings arrive sorted by token. A list of at most ``most`` rows gives its pairs at once; a longer
one is passed on row by row, to be split into blocks, and pairs of blocks are checked on whole sets
inside one task, which emits a forest of links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import lean

LIST = 128
BLOCK = 256
BLOCK_ITEMS = 1 << 19


def matches_needed(k: int, similarity: float, miss: float = 1e-8) -> int:
    """The most matches of k MinHash coordinates that a pair of that similarity misses with probability ``miss`` at most."""
    below = 0.0
    for t in range(k + 1):
        below += comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return t
    return k


def lists(batches, most: int) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Whole posting lists from batches sorted by token: (rows, begins, long).

    Short lists come many at a time, ``begins`` marking where each starts; the rows of a list longer
    than ``most`` come in pieces with long = True, and no more than that is held back.
    """
    held: pa.Table | None = None
    long_token: int | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        held = None
        if not table.num_rows:
            continue
        token = table.column("token").to_numpy()
        if long_token is not None:
            same = int(np.searchsorted(token, long_token, "right"))
            if same:
                yield table.slice(0, same), np.zeros(1, np.int64), True
            if same == table.num_rows:
                continue
            table, token, long_token = table.slice(same), token[same:], None
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        last = int(begins[-1])
        yield from _whole(table.slice(0, last), begins[:-1], most)
        held = table.slice(last).combine_chunks()
        if held.num_rows > most:
            yield held, np.zeros(1, np.int64), True
            long_token, held = int(token[-1]), None
    if held is not None:
        yield from _whole(held, np.zeros(1, np.int64), most)


def _whole(table: pa.Table, begins: np.ndarray, most: int) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    if not table.num_rows:
        return
    sizes = np.diff(np.append(begins, table.num_rows))
    for k in np.flatnonzero(sizes > most):
        yield table.slice(int(begins[k]), int(sizes[k])), np.zeros(1, np.int64), True
    short = np.repeat(sizes <= most, sizes)
    if short.any():
        kept = table if short.all() else table.filter(pa.array(short))
        own = sizes[sizes <= most]
        yield kept, np.cumsum(own) - own, False


def pairs(begins: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, of rows in the same list, by growing distance."""
    sizes = np.diff(np.append(begins, rows))
    ends = np.repeat(begins + sizes, sizes)
    i, step = np.arange(rows), 1
    while True:
        i = i[i + step < ends[i]]
        if not len(i):
            return
        for at in range(0, len(i), 1 << 20):
            yield i[at : at + (1 << 20)], i[at : at + (1 << 20)] + step
        step += 1


def sets_of(column) -> list[np.ndarray]:
    """Arrays of 64-bit hashes from a binary column."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def alike(common: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether common / (a + b - common) >= least[0] / least[1], in integers."""
    return least[1] * common >= least[0] * (a + b - common)


def verified(pairs_: DataFrame, sets: DataFrame, key: list[str], least: tuple[int, int]) -> DataFrame:
    """The rows of ``pairs_`` (a_*, b_*) whose sets (key columns, hashes binary, ascending) are similar.

    A set that many pairs name as b, as all rows of a star do, is dealt to many tasks; a list names a row as a at most once a row.
    """
    side = lambda s: sets.select(*(F.col(k).alias(f"{s}_{k}") for k in key), F.col("hashes").alias(f"{s}_hashes"))
    b = [f"b_{k}" for k in key]
    heavy = heavy_keys(pairs_.groupBy(*b).agg(F.count("*").alias("n")), b, pairs_.count())
    names = pairs_.columns
    both = spread_join(pairs_.join(side("a"), [f"a_{k}" for k in key]), side("b"), b, heavy)

    def check(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = sets_of(b.column("a_hashes")), sets_of(b.column("b_hashes"))
            common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], np.int64)
            good = alike(common, np.array([len(p) for p in x], np.int64), np.array([len(q) for q in y], np.int64), least)
            yield b.select(names).filter(pa.array(good, pa.bool_()))

    return both.select(*names, "a_hashes", "b_hashes").mapInArrow(lean(check), pairs_.schema)


#: A key with more than this share of the rows is heavy; there are fewer such keys than its inverse.
HEAVY, SALTS = 1 / 1024, 64


def heavy_keys(sizes: DataFrame, key: list[str], total: int) -> DataFrame:
    """The keys of ``sizes`` (key, n) with more than a 1024th of ``total`` rows: fewer than 1024, so they can be broadcast."""
    return F.broadcast(sizes.where(F.col("n") > total * HEAVY).select(*key, F.lit(SALTS).alias("_salts")))


def spread_join(many: DataFrame, one: DataFrame, key: list[str], heavy: DataFrame) -> DataFrame:
    """``many`` joined with ``one``, which has one row a key; the rows of ``heavy`` keys are dealt to ``SALTS`` tasks each."""
    salts = F.coalesce("_salts", F.lit(1))
    narrow = [f.name for f in many.schema if not f.name.endswith("hashes")]
    left = many.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*narrow), salts).cast("int")).drop("_salts")
    right = one.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*key, "_salt"]).drop("_salt")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of their incidence matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(a) or not len(b):
        return out
    fa, fb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(fa, fb)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    places = []
    for flat, row in ((fa, rows[0]), (fb, rows[1])):
        at = np.searchsorted(shared, flat)
        inside = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == flat) if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[inside], kind="stable")
        places.append((at[inside][order], row[inside][order]))
    for low in range(0, len(shared), step):
        m = []
        for (at, row), n in zip(places, (len(a), len(b))):
            s, e = np.searchsorted(at, [low, low + step])
            x = np.zeros((n, min(step, len(shared) - low)), np.float32)
            x[row[s:e], at[s:e] - low] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def block_jobs(rows: DataFrame, key: list[str], items: str, block: int | Column | None = None) -> DataFrame:
    """Deal the rows of every long list (token) out to the jobs of its pairs of blocks.

    A list has about one block per ``block`` rows (``BLOCK`` if None, an expression of ``rows`` if a column) or ``BLOCK_ITEMS`` set members; a row goes to the
    jobs of its block with every block. Adds (low, high, own): the job's blocks and the row's.
    """
    block = BLOCK if block is None else block
    sizes = rows.groupBy("token").agg(F.count("*").alias("rows"), F.sum(items).alias("all_items"))
    n = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("all_items") / BLOCK_ITEMS), F.lit(1))
    dealt = rows.join(sizes, "token").withColumn("blocks", n.cast("int")).withColumn("own", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *[c for c in rows.columns if c != "token"])


def run_jobs(jobs: DataFrame, task: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``task`` (rows of one job, whether a row is of the job's low block) to every job."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is None:
                table, keep = held, 0
            else:
                table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                keep = 1
            if table is None or not table.num_rows:
                continue
            ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("token", "low", "high")])
            begins = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)]))
            for s, e in zip(begins, [*begins[1:], table.num_rows] if not keep else begins[1:]):
                job = table.slice(int(s), int(e - s)).combine_chunks()
                if (out := task(job, job.column("own").to_numpy() == ids[1][s])) is not None:
                    yield out
            held = table.slice(int(begins[-1])) if keep else None

    return jobs.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(lean(run), schema)


def _with_end(batches) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric boolean matrix, as (i, j)."""
    n, seen, out = len(links), np.zeros(len(links), bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], work = True, [root]
        while work:
            i = work.pop()
            new = np.flatnonzero(links[i] & ~seen)
            seen[new] = True
            out += [(i, j) for j in new]
            work += list(new)
    got = np.array(out, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]
