"""SQL names for the library's scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from palindra import chemistry


def register(spark: SparkSession) -> list[str]:
    """Register mh(mz, charge), peptide_mass(sequence) and leucine(sequence); returns their names."""

    table = ", ".join(f"'{a}', {m!r}D" for a, m in chemistry.RESIDUES.items())
    letters = "filter(split(translate(seq, 'I', 'L'), ''), c -> c <> '')"
    sums = f"aggregate({letters}, 0D, (acc, c) -> acc + try_element_at(map({table}), c))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION peptide_mass(seq STRING) RETURNS DOUBLE RETURN {sums} + {chemistry.WATER + chemistry.PROTON!r}D")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mh(mz DOUBLE, charge INT) RETURNS DOUBLE RETURN (mz - {chemistry.PROTON}D) * charge + {chemistry.PROTON}D")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION leucine(seq STRING) RETURNS STRING RETURN translate(seq, 'I', 'L')")
    return ["mh", "peptide_mass", "leucine"]
