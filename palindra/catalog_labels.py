"""Queries of doublets and isotope labels over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from palindra.catalog import query, spectra
from palindra.operators import doublets


def _spectra(spark, sf_dir):
    return spectra(spark, sf_dir).select("spectrum", F.transform("peaks", lambda p: F.struct(p.mz.alias("mz"), p.inten.cast("double").alias("inten"))).alias("peaks"))


_ROWS = "q AS (SELECT l_suppkey AS spectrum, 100 + l_extendedprice / 60 AS mz, CAST(l_quantity AS DOUBLE) AS inten, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity) AS i FROM lineitem)"
_CHARGES = "(SELECT unnest([1, 2, 3]) AS c)"


@query(
    f"WITH {_ROWS}, g AS (SELECT x.spectrum, x.i AS light, y.i AS heavy, y.mz - x.mz AS gap, y.inten FROM q x JOIN q y ON y.spectrum = x.spectrum AND y.i > x.i AND y.mz > x.mz AND y.mz - x.mz < 0.1 "
    f"WHERE x.mz <= 1500 AND greatest(x.inten / y.inten, y.inten / x.inten) <= 2 AND EXISTS (SELECT 1 FROM {_CHARGES} WHERE abs(floor((y.mz - x.mz) * 100000 + 0.5) - floor(0.036::DOUBLE / c * 100000 + 0.5)) <= 1500 OR abs(floor((y.mz - x.mz) * 100000 + 0.5) - floor(0.072::DOUBLE / c * 100000 + 0.5)) <= 1500)), "
    "u AS (SELECT spectrum, light, max(inten) AS inten, arg_max(gap, heavy) AS gap FROM g GROUP BY spectrum, light), "
    f"e AS (SELECT spectrum, light, inten, gap, arg_min(c, (least(1.0::DOUBLE, abs(gap - 0.036::DOUBLE / c), abs(gap - 0.072::DOUBLE / c)), c)) AS c FROM u CROSS JOIN {_CHARGES} GROUP BY ALL) "
    "SELECT q.spectrum, round(mz, 6) AS mz, greatest(q.inten, coalesce(e.inten, 0)) AS inten, CAST(CASE WHEN e.light IS NULL THEN 0 WHEN gap > 0.036 THEN 1 ELSE c END AS INTEGER) AS label FROM q LEFT JOIN e ON e.spectrum = q.spectrum AND e.light = q.i "
    "WHERE e.light IS NOT NULL OR NOT EXISTS (SELECT 1 FROM g WHERE g.spectrum = q.spectrum AND g.heavy = q.i)"
)
def doublet_merge(spark, sf_dir):
    """Spectra without the heavy peaks of their doublets; SQL holds all peaks against all."""
    rows = doublets.merged(_spectra(spark, sf_dir)).select("spectrum", F.explode("peaks").alias("p"))
    return rows.select("spectrum", F.round("p.mz", 6).alias("mz"), F.col("p.inten").alias("inten"), F.col("p.label").alias("label"))


@query(
    f"WITH {_ROWS}, w AS (SELECT *, lead(mz) OVER v AS m1, lead(mz, 2) OVER v AS m2, lead(inten) OVER v AS h1, lead(inten, 2) OVER v AS h2 FROM q WINDOW v AS (PARTITION BY spectrum ORDER BY i)), "
    "f AS (SELECT *, m2 IS NOT NULL AND m1 - mz > 0.026 AND m1 - mz < 0.047 AS near, m2 IS NOT NULL AND m2 - mz > 0.026 AND m2 - mz < 0.047 AS far FROM w) "
    "SELECT spectrum, round(mz, 6) AS mz, inten, round(CASE WHEN near OR far THEN m1 - mz ELSE 0 END, 6) AS mass_diff, round(CASE WHEN near THEN inten / h1 WHEN far THEN inten / h2 ELSE 0 END, 3) AS inten_ratio FROM f"
)
def doublet_features(spark, sf_dir):
    """Gap and ratio of every peak to its partner at a doublet's distance."""
    rows = _spectra(spark, sf_dir).select("spectrum", F.explode(doublets.features(F.col("peaks"))).alias("p"))
    return rows.select("spectrum", F.round("p.mz", 6).alias("mz"), F.col("p.inten").alias("inten"), F.round("p.mass_diff", 6).alias("mass_diff"), F.col("p.inten_ratio").alias("inten_ratio"))


@query()
def cluster_labels(spark, sf_dir):
    """The isotope cluster and charge of every peak that was read, in its place; sequential, tested on its kernel."""
    rows = doublets.labelled(_spectra(spark, sf_dir)).select("spectrum", F.posexplode("labels").alias("place", "l"))
    return rows.select("spectrum", "place", "l.kept", "l.cluster", "l.charge")


@query()
def doublet_deisotope(spark, sf_dir):
    """Labelled peaks of charge one after merging doublets; sequential, tested on its kernel."""
    rows = doublets.deisotoped(doublets.merged(_spectra(spark, sf_dir))).select("spectrum", F.explode("peaks").alias("p"))
    return rows.select("spectrum", F.round("p.mz", 6).alias("mz"), F.round("p.inten", 6).alias("inten"), F.col("p.label").alias("label"))
