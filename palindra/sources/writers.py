"""Writers: spectra as text blocks, accepted and discarded pairs, candidate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palindra.operators import doublets


def _blocks(spectra: DataFrame, more: Column) -> DataFrame:
    peaks = F.array_join(F.transform("peaks", lambda p: F.format_string("%.5f %.5f", p.mz, p.inten)), "\n")
    head = F.format_string("BEGIN IONS\nTITLE=%s\nCHARGE=%d+\nRTINSECONDS=%s\nPEPMASS=%.6f\n", "title", "charge", F.col("rt").cast("string"), "prec_mz")
    return spectra.select(F.concat(head, more, peaks, F.when(F.size("peaks") > 0, "\n").otherwise(""), F.lit("END IONS")))


def mgf(spectra: DataFrame, path: str, labels: str | None = None) -> None:
    """One text block a row: five decimals for peaks, six for the precursor, labels as a digit a peak."""
    label = F.concat(F.lit("NEUCODELABEL="), F.array_join(labels, ""), F.lit("\n")) if labels else F.lit("")
    _blocks(spectra, label).write.text(path)


def mgf_with_doublets(spectra: DataFrame, path: str) -> None:
    """Text blocks of spectra with peaks (mz, inten, label), the heavy partners of peaks of label 1 written back, and a digit a peak."""
    full = spectra.withColumn("peaks", doublets.with_generated(F.col("peaks")))
    _blocks(full, F.concat(F.lit("NEUCODELABEL="), F.array_join(F.transform("peaks", lambda p: p.label.cast("string")), ""), F.lit("\n"))).write.text(path)


def annotated_mgf(spectra: DataFrame, path: str) -> None:
    """Text blocks of spectra with ``labels`` (kept, cluster, charge) of their peaks, a line for each of the three."""
    line = lambda name, field: F.concat(F.lit(f"{name}="), F.array_join(F.transform("labels", lambda x: x[field].cast("string")), ","), F.lit("\n"))
    _blocks(spectra, F.concat(line("UNFILTERED", "kept"), line("ISOTOPE_CLUSTER", "cluster"), line("ISOTOPE_CHARGE", "charge"))).write.text(path)


def pairs(rows: DataFrame, accepted: str, path: str) -> None:
    """Accepted and discarded pairs, as one table partitioned by status."""
    rows.withColumn("status", F.when(F.col(accepted), "accepted").otherwise("discarded")).write.partitionBy("status").option("sep", "\t").option("header", "true").csv(path)


def report(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """The best candidates of every title, one a sequence, ranked from 1."""
    one = candidates.groupBy("title", "sequence").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("title").orderBy(F.desc("score"), "sequence"))
    return one.withColumn("rank", rank).where(F.col("rank") <= limit)


_CANDIDATE_LINE = ("rank", "calc_mh", "sequence", "modifications", "score", "aa_scores")


def _two_level(heads: DataFrame, key: list[str], rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``heads`` (key, line, ...) with ``text``: the line and below it the rows of the same key by rank, a tab before each."""
    cell = {"calc_mh": F.format_string("%.5f", "calc_mh"), "aa_scores": F.array_join(F.transform("aa_scores", lambda x: F.format_string("%.2f", x)), ",")}
    line = F.concat_ws("\t", F.lit(""), *(F.coalesce(cell.get(n, F.col(n).cast("string")), F.lit("")) for n in names))
    below = rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("below"))
    joined = heads.join(below, key, "left")
    return joined.withColumn("text", F.concat("line", F.coalesce(F.concat(F.lit("\n"), "below"), F.lit("")))).drop("line", "below")


def pair_candidates(pairs: DataFrame, candidates: DataFrame, path: str) -> None:
    """Two-level text of pairs and their candidates, a folder for each pair of files, every file beginning with two lines of column names.

    ``pairs`` is (a_data_idx, b_data_idx, a_title, b_title, a_mass, b_mass, a_charge, b_charge, mirror_anno), ``candidates`` (a_title,
    b_title, rank, calc_mh, sequence, modifications, score, aa_scores). A pair without candidates has its line alone. Spark commits
    a task's files when it ends and shows none of a failed one.
    """
    mass = lambda c: F.format_string("%.5f", c)
    line = F.concat_ws("\t", "a_title", "b_title", mass("a_mass"), mass("b_mass"), F.col("a_charge").cast("string"), F.col("b_charge").cast("string"), "mirror_anno")
    heads = pairs.select("a_data_idx", "b_data_idx", "a_title", "b_title", line.alias("line"))
    rows = _two_level(heads, ["a_title", "b_title"], candidates, _CANDIDATE_LINE)
    names = "a_title\tb_title\ta_mass\tb_mass\ta_charge\tb_charge\tmirror_anno\n\t" + "\t".join(_CANDIDATE_LINE)
    by_files(rows.select("a_data_idx", "b_data_idx", "text"), names, path)


def single_candidates(spectra: DataFrame, candidates: DataFrame, path: str) -> None:
    """Two-level text of spectra (title) and their candidates (title, rank, sequence, modifications, score, aa_scores)."""
    names = ("rank", "sequence", "modifications", "score", "aa_scores")
    rows = _two_level(spectra.select("title", F.col("title").alias("line")), ["title"], candidates, names)
    rows.select("text").write.option("lineSep", "\n").text(path)


def by_files(rows: DataFrame, header: str, path: str, keys: tuple[str, ...] = ("a_data_idx", "b_data_idx"), parts: int = 8) -> None:
    """``rows`` (keys, text) as text, a folder for each pair of files and in it one for each part, with a file that begins with ``header``.

    The rows of a pair of files are dealt to ``parts`` tasks by their text, so large files are no single task's.
    """
    dealt = rows.select(*keys, F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"), "text", F.lit(1).alias("place"))
    heads = dealt.select(*keys, "part", F.lit(header).alias("text"), F.lit(0).alias("place")).distinct()
    dealt.unionByName(heads).repartition(*keys, "part").sortWithinPartitions(*keys, "part", "place", "text").drop("place").write.partitionBy(*keys, "part").text(path)
