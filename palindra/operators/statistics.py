"""Target-decoy statistics, threshold sweeps, confusion matrices and recall by rank."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import lineage

UP, DOWN = W.unboundedPreceding, W.unboundedFollowing


#: Ranges at most, and sampled rows a range.
_MOST_RANGES, _SAMPLED = 256, 32
#: Bins of the first column, and how many times its share the largest range of bins may hold.
_BINS, _UNEVEN = 4096, 4


def _ranges(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(rows with the number ``_part`` of their range of a total order, partitions to deal the ranges to).

    The ranges begin at rows of a sample by hash, of a bounded size, that is taken once: every branch of a plan, and every retry,
    sees the same ranges. Where bins of equal width of the first column share the rows out evenly, a range is some bins and named by one
    look into a table: a tree of all comparisons is more code than the JVM compiles.
    """
    n = min(_MOST_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select(*order)
    one_in = max(1, keys.count() // (n * _SAMPLED))
    sample = keys.where(F.pmod(F.xxhash64(*order), F.lit(one_in)) == 0).distinct().orderBy(*order).limit(4 * n * _SAMPLED).collect()
    begins = [sample[len(sample) * k // n] for k in range(1, n)] if len(sample) >= n else sample[1:]
    values = [r[0] for r in sample]
    if begins and rows.schema[order[0]].dataType.simpleString() == "double" and all(v is not None and math.isfinite(v) for v in values):
        low, scale = values[0], (_BINS - 1) / (values[-1] - values[0] or 1.0)
        bins = [int(min(max((v - low) * scale, 0.0), _BINS - 1)) for v in values]
        # a bin is dealt whole: every n-th part of the sample goes on to the next range with the next bin
        share = Counter(bins)
        before, ranges = 0, []
        for k in range(_BINS):
            ranges.append(before * n // len(bins))
            before += share[k]
        if max(Counter(ranges[k] for k in bins).values()) * n <= _UNEVEN * len(bins):
            # of all values, null counts as the least and NaN as the greatest, as in the order
            at = F.least(F.greatest((F.col(order[0]) - low) * scale, F.lit(0.0)), F.lit(_BINS - 1.0)).cast("int")
            return rows.withColumn("_part", F.split(F.lit(",".join(map(str, ranges))), ",").cast("array<int>")[at]), n
    key = F.struct(*order)

    def tree(low: int, high: int) -> Column:
        """The range among those from ``low`` on and before ``high``, by halving."""
        if high - low <= 1:
            return F.lit(low)
        mid = (low + high) // 2
        begin = F.struct(*(F.lit(begins[mid - 1][c]).cast(rows.schema[c].dataType).alias(c) for c in order))
        return F.when(key >= begin, tree(mid, high)).otherwise(tree(low, mid))

    return rows.withColumn("_part", tree(0, len(begins) + 1)), n


def _with_totals(part: DataFrame, totals: DataFrame) -> DataFrame:
    return part.join(F.broadcast(totals), "_part")  # one row a range


def q_values(rows: DataFrame, target: str, decoy: str, tie: list[str]) -> DataFrame:
    """Adds (p, is_target, fdr, q): ties of target and decoy count as decoys.

    Rows are ordered by the smaller p, then by ``tie``; fdr is (1 + decoys) / max(targets, 1) so far
    and q its smallest value from the row on. The order is dealt into ranges: a range is sorted once, from its end, and counts and
    minima run inside it; one row a range carries what lies before and after it.
    """
    order = ["p", *tie]
    scored = rows.withColumn("p", F.least(target, decoy)).withColumn("is_target", F.col(target) < F.col(decoy))
    named, n = _ranges(scored, order)
    back = W.partitionBy("_part").orderBy(*(F.desc(c) for c in order)).rowsBetween(UP, 0)
    hit, miss = (F.when(F.col("is_target"), a).otherwise(1 - a).cast("long") for a in (1, 0))
    # what lies before a range's end: its rows are counted from there
    upto = W.orderBy("_part").rowsBetween(UP, 0)
    ends = named.groupBy("_part").agg(F.sum(hit).alias("t"), F.sum(miss).alias("d"))
    ends = ends.select("_part", *(F.sum(c).over(upto).alias(f"_{c}1") for c in "td"))
    part = named.repartition(n, "_part").withColumns({"_t": F.sum(hit).over(back), "_d": F.sum(miss).over(back)})
    targets, decoys = F.col("_t1") - F.col("_t") + hit, F.col("_d1") - F.col("_d") + miss
    part = _with_totals(part, ends).withColumn("fdr", (1 + decoys) / F.greatest(targets, F.lit(1)))
    part = lineage.once(part.withColumn("q", F.min("fdr").over(back)).select(*scored.columns, "fdr", "q", "_part"))
    after = W.orderBy("_part").rowsBetween(1, DOWN)
    later = part.groupBy("_part").agg(F.min("fdr").alias("m")).select("_part", F.min("m").over(after).alias("_m"))
    return _with_totals(part, later).select(*scored.columns, "fdr", F.least("q", "_m").alias("q"))


def accepted(rows: DataFrame, least: float = 0.02) -> DataFrame:
    """Targets with an fdr of at most ``least``."""
    return rows.where(F.col("is_target") & (F.col("q") <= least))


def threshold_sweep(rows: DataFrame, most: int = 2000, plus_one: bool = True) -> DataFrame:
    """(threshold, n_target, n_decoy, rate, best_rate) for masses 0..most.

    Rows are (sequence, mass, target, decoy); a sequence counts once, with its largest mass, at every
    threshold up to it. ``plus_one`` adds one to the decoys, as single-spectrum tools do; otherwise
    one is added to the targets.
    """
    per = rows.groupBy("sequence").agg(F.max("mass").alias("mass"), F.max("target").alias("t"), F.max("decoy").alias("d"))
    steps = per.select(F.least(F.floor("mass"), F.lit(most)).cast("long").alias("threshold"), (F.col("t") & ~F.col("d")).cast("long").alias("t"), (F.col("d") & ~F.col("t")).cast("long").alias("d")).where("threshold >= 0")
    steps = steps.groupBy("threshold").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    grid = rows.sparkSession.range(most + 1).select(F.col("id").alias("threshold"))
    down = W.orderBy(F.desc("threshold")).rowsBetween(UP, 0)  # as many rows as thresholds
    full = grid.join(steps, "threshold", "left").select("threshold", *(F.sum(F.coalesce(c, F.lit(0))).over(down).alias(n) for c, n in (("t", "n_target"), ("d", "n_decoy"))))
    t, d = F.col("n_target"), F.col("n_decoy")
    rate = (d + 1) / F.greatest(t, F.lit(1)) * 100 if plus_one else d / (t + 1) * 100
    up = W.orderBy("threshold").rowsBetween(UP, 0)
    return full.withColumn("rate", rate).withColumn("best_rate", F.min("rate").over(up))


def tail_fit(rows: DataFrame, group: str, score: str) -> DataFrame:
    """(group, n, slope, intercept) of the upper tail of positive scores, for rows (group, score).

    Ascending scores from place round(0.9 n) - 1 to n - 10 are fitted: the log of a tenth of the share
    still above against the log of the score. Groups with fewer than 20 such scores have no fit, equal scores
    give slope and intercept 0.
    """
    order = W.partitionBy(group).orderBy(score)
    ranked = rows.where(F.col(score) > 0).select(group, score, (F.row_number().over(order) - 1).alias("place"), F.count("*").over(W.partitionBy(group)).alias("n"))
    low = F.rint(F.col("n") * 0.9) - 1
    tail = ranked.withColumn("low", low).withColumn("size", F.col("n") - 10 - low).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("n") - 10) & (F.col("size") > 19))
    y = F.log(F.lit(0.1) * (F.col("size") - (F.col("place") - F.col("low") + 1) + 1) / F.col("size"))
    fit = tail.groupBy(group).agg(F.first("n").alias("n"), F.regr_slope(y, F.log(score)).alias("slope"), F.regr_intercept(y, F.log(score)).alias("intercept"))
    return fit.select(group, "n", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", F.lit(0.0)).alias("intercept"))


def p_value(score: Column, slope: Column, intercept: Column) -> Column:
    """p of a score under a tail fit; infinite for scores that are not positive or without a fit."""
    return F.when((score > 0) & slope.isNotNull(), F.exp(slope * F.log(score) + intercept + 2)).otherwise(float("inf"))


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, recall, precision, accuracy."""
    n = lambda c: F.sum(c.cast("long"))
    out = rows.agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"), n(~truth & ~said).alias("tn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    c = F.col
    return out.select("*", ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")).alias("accuracy"))


def topk_recall(rows: DataFrame, title: str, rank: str, hit: Column, most: int = 10) -> DataFrame:
    """(k, n_hit, n_title, recall): titles whose first correct candidate has a rank of at most k."""
    best = rows.groupBy(title).agg(F.min(F.when(hit, F.col(rank))).alias("best"))
    totals = best.groupBy(F.when(F.col("best") <= most, F.col("best")).alias("best")).agg(F.count("*").alias("n"))
    hits = totals.where("best IS NOT NULL").select(F.explode(F.sequence(F.greatest(F.ceil("best"), F.lit(1)).cast("long"), F.lit(most).cast("long"))).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n_hit"))
    n_title = totals.agg(F.sum("n").alias("n_title"))  # one row
    ks = rows.sparkSession.range(1, most + 1).select(F.col("id").alias("k"))
    out = ks.join(hits, "k", "left").crossJoin(F.broadcast(n_title)).select("k", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "n_title")
    return out.withColumn("recall", F.round(F.col("n_hit") / F.col("n_title"), 6))
