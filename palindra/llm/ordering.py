"""Global row order without a global sort task: ranges of an id, and the first row of the next range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts(rows: DataFrame, key: str, n: int) -> list:
    """At most ``n`` keys of ``rows`` that begin ranges of about equal size; a null first if there is one."""
    quantiles = F.percentile_approx(key, [i / n for i in range(n)], 100 * n).alias("cuts")
    got = rows.agg(quantiles, F.min(key).alias("low"), F.max(F.col(key).isNull()).alias("nulls")).first()
    found = sorted({*(got.cuts or []), *([got.low] if got.low is not None else [])})
    return [None, *found[1:]] if got.nulls else found


def range_of(key: Column, begins: list) -> Column:
    """The number of the range of ``key`` (a null lies in the first), by a balanced comparison tree."""

    def tree(low: int, high: int) -> Column:
        if high - low <= 1:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key >= begins[mid], tree(mid, high)).otherwise(tree(low, mid))

    return tree(0, len(begins))


def with_followers(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` sorted within ranges of ``key``, each range followed by a copy of the next range's first rows.

    Adds (range, tail): tail is true for the copies, and the last range is followed by the first
    one's. A pass over a partition thus meets every row and then the row after it. Only the begin
    keys, one a range, pass through the driver.
    """
    begins = cuts(rows, key, n)
    if not begins:
        return rows.withColumns({"range": F.lit(0), "tail": F.lit(False)})
    at = range_of(F.col(key), begins)
    known = [b for b in begins if b is not None]
    begin = F.col(key).isin(known) if known else F.lit(False)
    begin = F.coalesce(begin, F.lit(False)) | (F.col(key).isNull() if begins[0] is None else F.lit(False))
    own = F.struct(at.alias("range"), F.lit(False).alias("tail"))
    copy = F.struct(F.when(at == 0, F.lit(len(begins) - 1)).otherwise(at - 1).alias("range"), F.lit(True).alias("tail"))
    spread = rows.withColumn("place", F.explode(F.when(begin, F.array(own, copy)).otherwise(F.array(own))))
    spread = spread.select(*rows.columns, "place.range", "place.tail")
    rest = [F.asc_nulls_first(c) for c in rows.columns if c != key]
    return spread.repartitionByRange(len(begins), "range").sortWithinPartitions("range", "tail", F.asc_nulls_first(key), *rest)
