"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash of its id. A source takes its documents whole as often as its
target allows and, for the rest of the budget, those whose hash lies below a threshold. The
threshold is found on histograms: words are summed by source and leading hash bits, the bucket in
which the budget ends is refined by the next bits, and so on, until one hash value is left. Nothing
is sorted by document and no document leaves its partition; each level shuffles at most
``2**BITS`` sums a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import storage
from .columns import fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BITS = 12
LEVELS = 5


def unit_hash(doc_id: Column) -> Column:
    """60-bit hash of an id: the first 15 hexadecimal digits of the MD5 of its text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of every source, from rows (source, source_size).

    Sources in code point order, null last, get the weights in turn and share ``share`` times all
    words; no target exceeds ``most`` times its source, and what that leaves over goes to the others
    by weight. Filling the sources in order of cap over weight gives what repeated resharing gives.
    One row a source is handled in one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    fill = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return rows.select("source", "source_size", F.round(F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level), 6).alias("target"))


def thresholds(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, threshold): documents with ``hash <= threshold`` come nearest to the budget.

    ``docs`` has (source, size, hash), ``budget`` has (source, rest). A threshold of -1 takes none.
    """
    bits = BITS * LEVELS
    # open: the hash prefix in which the budget ends, and the words below it
    open_ = budget.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        left = bits - BITS * level
        d, o = docs.alias("d"), open_.alias("o")
        inside = d.join(o, F.col("d.source").eqNullSafe(F.col("o.source")) & (F.shiftright("d.hash", left + BITS) == F.col("o.prefix")))
        inside = inside.select("d.source", "o.rest", "o.below", F.shiftright("d.hash", left).alias("prefix"), "d.size")
        sums = inside.groupBy("source", "rest", "below", "prefix").agg(F.sum("size").alias("words"))
        upto = F.col("below") + F.sum("words").over(W.partitionBy("source").orderBy("prefix"))
        sums = sums.withColumn("upto", upto)
        last = F.max("prefix").over(W.partitionBy("source"))
        ends = sums.withColumn("last", last).where((F.col("upto") >= F.col("rest")) | (F.col("prefix") == F.col("last")))
        first = F.row_number().over(W.partitionBy("source").orderBy("prefix"))
        ends = ends.withColumn("nth", first).where("nth = 1")
        open_ = ends.select("source", "rest", "prefix", (F.col("upto") - F.col("words")).alias("below"), F.col("words").alias("at"))
    near = (F.col("below") + F.col("at") - F.col("rest")) <= (F.col("rest") - F.col("below"))
    return open_.select("source", F.when(near, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): (doc_id, source, size, hash) of every row, and what to take of every source.

    A source has (source, source_size, target, whole, threshold): all its documents ``whole`` times,
    and once more those whose hash is at most the threshold.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = storage.materialize(rows.withColumn("hash", unit_hash(F.col("doc_id"))), "mix-sizes")
    per = storage.materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = storage.materialize(thresholds(rows.where("size > 0"), per.where("rest > 0").select("source", "rest")), "mix-thresholds")
    per, cut = per.alias("p"), cut.alias("c")
    per = per.join(cut, F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.source", "p.source_size", "p.target", "p.whole", F.coalesce("threshold", F.lit(-1)).alias("threshold"))
    return rows, storage.materialize(per, "mix-sources")


def _times(hash_: Column) -> Column:
    return F.col("s.whole") + (hash_ <= F.col("s.threshold")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    Null texts have size 0, a null source is a source of its own, equal ids are taken alike (they
    share their hash), an empty table gives no rows, and other columns are ignored. The only
    difference between taken words and target is at most half the words of one hash value.
    """
    rows, per = plan(docs, weights, share, most)
    out = rows.alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", (_times(F.col("d.hash")) * F.col("d.size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: none, once or more, columns unchanged.

    The table of sources is small and written, so Spark broadcasts it by its size; texts stay in place.
    """
    _, per = plan(docs, weights, share, most)
    out = docs.alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    times = _times(unit_hash(F.col("d.doc_id"))).cast("int")
    (copy,) = fresh(docs.columns, "copy")
    return out.select("d.*", F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT source, source_size, round(CASE WHEN ratio <= level THEN cap ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END, 6) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, d.hash, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS upto,
             sum(size) OVER (PARTITION BY d.source, hash) AS words
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND size > 0 AND (upto < rest OR upto - words < rest AND upto - rest <= rest - (upto - words)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
