"""Near-duplicate documents by a signature-coordinate inverted join of MinHash signatures.

Documents with equal shingle sets form one class. Each class posts itself under (coordinate, value)
pairs of its signature, rarest first, and only under the prefix that any pair with enough matching
coordinates must share. Lists are merged into candidate pairs that agree in enough of all
coordinates and in length; links are confirmed on the full shingle sets. Lists too long for pairs are
compared block by block inside tasks, after what the first links already connect has been set aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bounded, joins, storage, text
from .memory import lean
from .components import components

INDEXED = 24
COORDINATES = 64
SIZE, LEAST = 5, (80, 100)


def distinct_shingles(texts: pa.Array, size: int, lower: bool) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of every text."""
    hashes, first = text.shingles(text.words(texts, lower), size)
    return [np.unique(hashes[first[d] : first[d + 1]]) for d in range(len(first) - 1)]


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int, lower: bool) -> DataFrame:
    """(doc_id, n, digest, tokens, marks): set size, set identity, index tokens and all coordinates' low bits."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        multiply, add = text.odd_constants(COORDINATES, 23), text.odd_constants(COORDINATES, 29)
        salt = text.odd_constants(INDEXED, 31)
        for b in text.blocks(batches, "text"):
            sets = distinct_shingles(b.column("text"), size, lower)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            full = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[full]
            low = np.zeros((len(sets), COORDINATES), np.uint64)
            for k in range(COORDINATES if len(full) else 0):
                low[full, k] = np.minimum.reduceat((flat ^ add[k]) * multiply[k], begin)
            tokens = text.mix(low[:, :INDEXED] ^ salt[None, :]).view(np.int64)
            marks = np.ascontiguousarray(text.mix(low).astype(np.uint16))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * INDEXED), pa.array(tokens.ravel())), pa.array([m.tobytes() for m in marks], pa.binary())], names=["doc_id", "n", "digest", "tokens", "marks"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, digest binary, tokens array<long>, marks binary")


def postings(classes: DataFrame, needed: int) -> DataFrame:
    """(token, digest, n, marks): every class under the rarest tokens it must share with a match.

    The prefix is counted over all ``INDEXED`` tokens, those of a single class included, which can be
    left out as they match nothing.
    """
    prefix = INDEXED - needed + 1
    tokens = classes.select("digest", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(df, "token").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    own = own.where(F.size("shared") > INDEXED - prefix)
    own = own.select("digest", F.slice("shared", F.lit(1), F.lit(prefix - INDEXED) + F.size("shared")).alias("shared"))
    return own.join(classes.select("digest", "n", "marks"), "digest").select(F.explode("shared.token").alias("token"), "digest", "n", "marks")


def _candidates(postings_: DataFrame, enough: int, least: tuple[int, int], most: int) -> DataFrame:
    """Rows (a, b) of candidate pairs, and rows (token, a, n) of what lies in lists longer than ``most``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table, begins, long in joins.lists(batches, most):
            table = table.combine_chunks()
            digest = pa.concat_arrays(table.column("digest").chunks)
            n = table.column("n").to_numpy()
            if long:
                yield pa.RecordBatch.from_arrays([digest, pa.nulls(len(n), pa.binary()), pa.array(table.column("token").to_numpy()), pa.array(n)], names=["a", "b", "token", "n"])
                continue
            marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint16).reshape(len(n), COORDINATES)
            for i, j in joins.pairs(begins, len(n)):
                near = least[1] * np.minimum(n[i], n[j]) >= least[0] * np.maximum(n[i], n[j])
                i, j = i[near], j[near]
                same = (marks[i] == marks[j]).sum(1) >= enough
                i, j = i[same], j[same]
                if len(i):
                    yield pa.RecordBatch.from_arrays([digest.take(pa.array(i)), digest.take(pa.array(j)), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())], names=["a", "b", "token", "n"])

    ordered = postings_.repartition("token").sortWithinPartitions("token", "digest")
    return ordered.mapInArrow(lean(run), "a binary, b binary, token long, n long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, lower: bool) -> DataFrame:
    """(digest, hashes) of the classes in ``wanted`` (doc_id, digest), from one scan of ``docs``.

    A Bloom filter of a fixed size over the wanted ids spares other texts the work; the join with
    ``wanted`` is exact.
    """
    ids = lambda b: b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    table = docs.sparkSession.sparkContext.broadcast(bounded.bloom(wanted.select("doc_id"), ids))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in text.blocks(batches, "text"):
            b = b.filter(pa.array(bounded.passes(table.value, ids(b))))
            sets = distinct_shingles(b.column("text"), size, lower) if b.num_rows else []
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "hashes"])

    found = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "digest binary, hashes binary")
    return found.join(wanted.select("digest"), "digest").groupBy("digest").agg(F.first("hashes").alias("hashes"))


def _centres(hot: DataFrame) -> DataFrame:
    """(token, b): the row of a long list that lies in most long lists; of copies, one with few edits."""
    score = hot.groupBy("a").agg(F.count("*").alias("score"))
    return hot.join(score, "a").groupBy("token").agg(F.max(F.struct("score", "n", "a")).alias("x")).select("token", F.col("x.a").alias("b"))


def _stars(hot: DataFrame) -> DataFrame:
    """Pairs (a, b) that tie every row of a long list to the list's centre."""
    return hot.join(_centres(hot), "token").where("a <> b").select("a", "b").distinct()


def _verified(pairs_: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    named = storage.materialize(pairs_.select(F.col("a").alias("a_digest"), F.col("b").alias("b_digest")), "near-pairs")
    return joins.verified(named, sets, ["digest"], least).select(F.col("a_digest").alias("a"), F.col("b_digest").alias("b"))


def _block_links(hot: DataFrame, sets: DataFrame, known: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) among the rows of long lists that ``known`` (node, root) does not connect yet.

    Lists with the same centre hold mostly the same rows and are compared as one. Of a list only rows
    outside its commonest component are compared, with each other and with all.
    """
    merged = hot.join(_centres(hot), "token").select(F.xxhash64("b").alias("token"), F.col("a").alias("digest"), "n").distinct()
    rows = merged.join(known.select(F.col("node").alias("digest"), "root"), "digest", "left")
    rows = rows.withColumn("root", F.coalesce("root", "digest"))
    common = rows.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    rows = rows.join(common.select("token", F.col("top.root").alias("top")), "token").withColumn("settled", F.col("root") == F.col("top")).drop("top")
    rows = storage.materialize(rows.join(sets, "digest"), "hot-rows")
    jobs = joins.block_jobs(rows, ["digest"], "n")

    def task(job: pa.Table, own_low: np.ndarray) -> pa.RecordBatch | None:
        settled = job.column("settled").to_numpy(zero_copy_only=False)
        if settled.all():
            return None
        root = np.unique(np.array(job.column("root").to_pylist(), object), return_inverse=True)[1]
        sets_ = joins.sets_of(job.column("hashes").combine_chunks())
        n = np.array([len(s) for s in sets_], np.int64)
        fresh = np.flatnonzero(~settled)
        common = joins.common_counts([sets_[k] for k in fresh], sets_).astype(np.int64)
        good = joins.alike(common, n[fresh][:, None], n[None, :], least) & (root[fresh][:, None] != root[None, :])
        links = np.zeros((len(n), len(n)), bool)
        links[fresh] = good
        i, j = joins.forest(links | links.T)
        if not len(i):
            return None
        digest = job.column("digest").combine_chunks()
        return pa.RecordBatch.from_arrays([digest.take(pa.array(i)), digest.take(pa.array(j))], names=["a", "b"])

    return joins.run_jobs(jobs, task, "a binary, b binary")


def groups(docs: DataFrame, size: int = SIZE, least: tuple[int, int] = LEAST, lower: bool = False, most: int = joins.LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Documents are linked where their sets of ``size``-word shingles have a Jaccard similarity of at
    least ``least[0] / least[1]``; a component's id is its smallest doc_id. A text shorter than a
    shingle has its whole word sequence as one; null and wordless texts have none and are linked with
    nothing, nor are rows with a null doc_id, whose component_id is null. Rows that share a doc_id
    keep a row each; if their texts differ, all their components get the smallest id of either
    text's. A pair at the threshold fails to share enough coordinates with a probability of 1e-8.
    """
    similarity = least[0] / least[1]
    needed, enough = (joins.matches_needed(k, similarity) for k in (INDEXED, COORDINATES))
    docs = docs.select("doc_id", "text")
    rows = storage.materialize(signatures(docs, size, lower), "signatures")
    keyed = rows.where("n > 0 AND doc_id IS NOT NULL")
    first = keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "tokens", "marks")).alias("x"))
    classes = storage.materialize(first.select("digest", "x.*"), "classes")
    found = storage.materialize(_candidates(postings(classes, needed), enough, least, most), "candidates")
    pairs_ = found.where("b IS NOT NULL").select("a", "b").distinct()
    hot = found.where("b IS NULL").select("token", "a", "n")
    wanted = found.select(F.col("a").alias("digest")).union(found.where("b IS NOT NULL").select("b")).distinct()
    wanted = storage.materialize(wanted.join(classes.select("digest", "doc_id"), "digest"), "wanted")
    sets = storage.materialize(shingle_sets(docs, wanted, size, lower), "shingle-sets")
    links = _verified(pairs_.union(_stars(hot)).distinct(), sets, least)
    links = storage.materialize(links, "near-links")
    known = components(links)
    if not hot.isEmpty():
        links = storage.materialize(links.union(_block_links(hot, sets, known, least)), "near-links")
        known = components(links)
    known = known.join(classes.select(F.col("digest").alias("node"), "doc_id"), "node")
    known = storage.materialize(known, "components")
    smallest = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = classes.select("digest", "doc_id").join(known.join(smallest, "root").select(F.col("node").alias("digest"), "component_id"), "digest", "left")
    labels = labels.select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    out = out.join(labels, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out


def kept(docs: DataFrame, size: int = SIZE, least: tuple[int, int] = LEAST, lower: bool = False) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group; rows with a null id stay."""
    ids = groups(docs, size, least, lower).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(ids, "doc_id", "left_semi").select(docs.columns)
    return known.union(docs.where("doc_id IS NULL"))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (85, 100), lower=True)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 3 THEN [array_to_string(v, ' ')]
        ELSE list_transform(range(1, len(v) - 1), lambda i: v[i] || ' ' || v[i + 1] || ' ' || v[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.node = w.doc_id
"""
