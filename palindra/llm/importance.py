"""Importance resampling towards a target corpus, over hashed words, in two Arrow passes.

The first pass counts the words of every bucket, a vector a partition, merged along a tree. The
second reads the gain of every word's bucket from a broadcast vector and sums them by document.
Which documents are drawn is settled by one range shuffle of four numbers a document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import storage, text, trees
from .memory import lean

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 10, 20, "2024"
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def hashed(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): the bucket of every word of every text, A-Z lower-cased; null counts as empty.

    A word is a run of digits, letters a-z and characters beyond ASCII; its bucket is the CRC-32 of its bytes.
    """
    data, offsets = text.flat(texts)
    data = text._LOWER[data]
    starts, ends = text.runs(data, offsets, _INSIDE[data])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    coded = text.strings(data, starts, ends).dictionary_encode()
    names = coded.dictionary.to_pylist()
    at = np.fromiter((zlib.crc32(w.encode()) % buckets for w in names), np.int64, len(names))
    return at[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(starts, offsets)


def counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Words of all texts by bucket: ``np.bincount`` in every partition, vectors of a fixed size added along a tree."""

    def part(batches) -> bytes:
        total = np.zeros(buckets, np.int64)
        for block in text.blocks(batches, "text"):
            total += np.bincount(hashed(block.column("text"), buckets)[0], minlength=buckets)
        return total.tobytes()

    found = trees.reduced(rows.select("text"), part, np.add, lambda b: np.frombuffer(b, np.int64))
    return np.zeros(buckets, np.int64) if found is None else found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target against source, rounded down."""
    n, total, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight): words of every document and the mean of their gains, rounded down; 0 without words."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches, "text"):
            at, first = hashed(block.column("text"), len(shared.value))
            n = np.diff(first)
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=shared.value[at], minlength=len(n)).astype(np.int64)
            mean = np.where(n > 0, np.floor_divide(total, np.maximum(n, 1)), 0)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(mean)], names=["doc_id", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(lean(weigh), "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of the id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_features, weight, score) with rank: 1, 2, ... for the drawn, else null.

    Of the rows with ``least`` features, ``percent`` in a hundred are drawn by falling score, ties by smaller id and
    null ids last; rows alike in both are numbered in any order. Rows are sorted in ranges, written once, and numbered by
    their place in the range and the sizes of the ranges before, one number a range.
    """
    rows = scored.where(F.col("n_features") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    tied = rows.withColumn("tie", F.monotonically_increasing_id() % 1024)  # parts a large group of equal rows
    sorted_ = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    ranges = storage.materialize(sorted_, "importance-order").withColumns({"range": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)})
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("before"), F.floor(F.sum("n").over(W.partitionBy()) * percent / 100).alias("most"))
    rank = F.col("before") + F.col("place") + 1
    ranked = ranges.join(F.broadcast(sizes), "range").withColumn("rank", F.when(rank <= F.col("most"), rank))
    rest = scored.where(F.col("n_features") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").union(rest.select(*scored.columns, "rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn towards the texts of ``target``.

    Null and empty texts have no features, weight 0 and are never drawn; repeated rows are drawn each by itself; without any
    target text the gains favour rare words; other columns are not read. An empty table gives no rows.
    """
    gain = gains(counts(docs, buckets), counts(target, buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(storage.materialize(scored, "importance"), percent, least)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _features(table: str, key: str) -> str:
    words = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
    return f"SELECT {key}, word, count(*) AS n FROM (SELECT {key}, {words} AS word FROM {table}) GROUP BY ALL"


OP11_SQL = f"""
WITH z AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), i)) AS crc),
d AS MATERIALIZED ({_features('documents', 'doc_id')}),
q AS MATERIALIZED ({_features('benchmark', 'item_id')}),
w AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM q)),
b AS MATERIALIZED (SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST((instr('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS INTEGER), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS INTEGER), 1)) - 1 AS BIGINT)),
           lambda a, x: xor(a >> 8, list_extract(crc, xor(a & 255, x) + 1)), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM w CROSS JOIN z),
s AS (SELECT bucket, sum(n) AS n FROM d JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM q JOIN b USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket),
m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM d JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, list_reduce(list_transform(range(8), lambda i: CAST(instr('0123456789abcdef', substr(sha256('{SEED}:' || doc_id), CAST(i + 1 AS INTEGER), 1)) - 1 AS BIGINT)), lambda a, x: a * 16 + x, 0) AS h FROM documents),
x AS (SELECT h.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h LEFT JOIN m ON m.doc_id = h.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM x WHERE n_features >= {LEAST_WORDS})
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= floor({PERCENT} * total / 100) THEN rank END AS rank FROM x LEFT JOIN r ON r.doc_id = x.doc_id
"""
