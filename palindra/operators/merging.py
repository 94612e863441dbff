"""Merging of sources: precedence, conflict classes, set regions and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by a total order."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def single_or_mirror(single: DataFrame, mirror: DataFrame) -> DataFrame:
    """(title, sequence, source) of rows (title, sequence): the mirror result if it is the only one or
    equals the single one, else the single one."""
    both = single.select("title", F.col("sequence").alias("s")).join(mirror.select("title", F.col("sequence").alias("m")), "title", "full")
    use = F.col("s").isNull() | (F.col("s") == F.col("m"))
    return both.select("title", F.when(use, F.col("m")).otherwise(F.col("s")).alias("sequence"), F.when(use, "mirror").otherwise("single").alias("source"))


def conflict_class(a: Column, b: Column, a_mirror: Column, b_mirror: Column) -> Column:
    """Class of a mirror row by the single results of its two spectra (null where there is none).

    Both: 1 both agree, 2 only b, 3 only a, 4 neither but they equal each other, 5 neither. One: 6 and
    7 for a that agrees or not, 8 and 9 for b. None: 10. Classes 2-5, 7 and 9 are conflicts.
    """
    same_a, same_b = a == a_mirror, b == b_mirror
    both = F.when(same_a & same_b, 1).when(same_b, 2).when(same_a, 3).when(a == b, 4).otherwise(5)
    return F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNotNull(), F.when(same_a, 6).otherwise(7)).when(b.isNotNull(), F.when(same_b, 8).otherwise(9)).otherwise(10)


def regions(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(region, n): number of distinct keys in each combination of sources, as joined names."""
    tagged = None
    for bit, (_, rows) in enumerate(sources.items()):
        part = rows.select(key).distinct().withColumn("bit", F.lit(1 << bit))
        tagged = part if tagged is None else tagged.union(part)
    masks = tagged.groupBy(key).agg(F.sum("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    name = F.concat_ws("&", *(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.lit(n)) for k, n in enumerate(sources)))
    return masks.select(name.alias("region"), "n")


def coverage_union(parts: list[DataFrame]) -> DataFrame:
    """(protein_id, covered): residues in the union of several location tables."""
    rows = parts[0].select("protein_id", "start", "end")
    for p in parts[1:]:
        rows = rows.union(p.select("protein_id", "start", "end"))
    before = F.max("end").over(W.partitionBy("protein_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    own = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("before", F.lit(0))), F.lit(0))
    return rows.distinct().withColumn("before", before).groupBy("protein_id").agg(F.sum(own).cast("long").alias("covered"))
