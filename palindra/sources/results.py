"""Results of sequencing tools as (title, rank, sequence, score): letters in the bracket form, I as L.

Lines of a file are read by many tasks. What a line needs from a line before it, a header, is carried inside the range of a
file that a task reads, and from range to range by one row a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palindra.functions import sequences as S
from palindra.operators.lineage import once


def under_headers(spark: SparkSession, paths: str | list[str], header: str, kept: str) -> DataFrame:
    """(file, header, line, place): lines that match ``kept`` with the last line before them that matches ``header``.

    Patterns are RE2 ones, matched at a line's beginning. A range of a file gives its lines with the headers it knows and its last
    header; lines at a range's beginning get the last header of the ranges before, which is found over one row a range. ``place`` orders
    the lines of a file. Lines before any header have a null one.
    """
    meta = F.col("_metadata")
    text = spark.read.text(paths).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), "value")

    def carry(batches) -> Iterator[pa.RecordBatch]:
        last: str | None = None
        range_: tuple | None = None
        for b in batches:
            value = pc.fill_null(b.column("value"), "")
            head, keep = (np.array(pc.match_substring_regex(value, f"^(?:{p})").to_numpy(zero_copy_only=False)) for p in (header, kept))
            keys = list(zip(b.column("file").to_pylist(), b.column("block").to_pylist()))
            begins = np.flatnonzero([k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))])
            for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)]):
                if keys[s] != range_:
                    range_, last = keys[s], None
                at = np.maximum.accumulate(np.where(head[s:e], np.arange(s, e), -1))
                names = pc.coalesce(pc.take(value, pa.array(at, mask=at < 0)), pa.scalar(last, pa.string()))
                wanted = np.flatnonzero((keep | head)[s:e])
                if at[-1] >= 0:
                    last = value[int(at[-1])].as_py()
                part, n = b.slice(s, e - s), pa.array(wanted)
                yield pa.RecordBatch.from_arrays([part.column("file").take(n), part.column("block").take(n), part.column("place").take(n), names.take(n), value.slice(s, e - s).take(n), pa.array(keep[s:e][wanted] & ~head[s:e][wanted])], names=["file", "block", "place", "header", "line", "own"])

    rows = once(text.mapInArrow(carry, "file string, block long, place long, header string, line string, own boolean"))
    heads = rows.groupBy("file", "block").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("place"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select("file", "block", before.alias("before"))
    lines = rows.where("own")
    orphans = lines.where("header IS NULL").join(heads, ["file", "block"]).select("file", F.col("before").alias("header"), "line", "place")
    return lines.where("header IS NOT NULL").select("file", "header", "line", "place").union(orphans)


def candidates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(title, mirror_title, mirror_anno, rank, sequence, modifications, score, aa_scores) of two-level text.

    A line for each spectrum or pair, then its candidates on lines that begin with a tab: rank, sequence, 'pos,name;' modifications,
    score and, if there are any, a comma-separated score a residue. Lines of column names have no rank and are left out.
    """
    rows = under_headers(spark, paths, r"[^\t\r\n]", r"\t")
    head, cell = F.split("header", "\t"), F.split(F.regexp_replace(F.substr("line", F.lit(2)), "\r$", ""), "\t")
    at = lambda cells, n: F.get(cells, F.lit(n))
    plain = lambda c: F.regexp_replace(c, "\r$", "")
    out = {"title": plain(at(head, 0)), "mirror_title": plain(at(head, 1)), "mirror_anno": plain(at(head, 2)), "rank": F.expr("try_cast(cell[0] AS INT)"), "sequence": at(F.col("cell"), 1), "modifications": at(F.col("cell"), 2), "score": F.expr("try_cast(cell[3] AS DOUBLE)"), "aa_scores": F.transform(F.split(at(F.col("cell"), 4), ","), lambda x: x.cast("double"))}
    return rows.withColumn("cell", cell).select(*(v.alias(k) for k, v in out.items())).where("rank IS NOT NULL")


def _known(seq: Column) -> Column:
    """The sequence, null if brackets, signs or dashes of an unknown modification are left in it."""
    bare = F.regexp_replace(seq, r"[A-Z]\((\+57\.02|\+15\.99)\)", "")
    return F.when((bare != "") | (F.length(seq) > 0), F.when(~bare.rlike(r"[^A-Z]"), seq))


def mztab(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, title, rank, sequence, score) of mzTab: PSM lines under their file's PSH line, by column names.

    The title is the spectrum's reference; +57.021 of C and +15.995 of M become brackets, and a sequence with any other modification is
    null. Matches of a spectrum are ranked by falling score.
    """
    rows = under_headers(spark, paths, "PSH\t", "PSM\t")
    names, cells = F.split("header", "\t"), F.split(F.regexp_replace("line", "\r$", ""), "\t")
    rows = rows.select("file", "place", F.map_from_arrays(F.transform(names, lambda n: F.trim(n)), F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.size(names))), F.lit(1), F.size(names))).alias("m"))
    of = lambda n: F.try_element_at("m", F.lit(n))
    seq = F.translate(F.replace(F.replace(of("sequence"), F.lit("C+57.021"), F.lit("C(+57.02)")), F.lit("M+15.995"), F.lit("M(+15.99)")), "I", "L")
    score = F.expr("try_cast(try_element_at(m, 'search_engine_score[1]') AS DOUBLE)")
    found = rows.select("file", of("spectra_ref").alias("title"), _known(seq).alias("sequence"), score.alias("score"), "place")
    rank = F.row_number().over(W.partitionBy("file", "title").orderBy(F.desc_nulls_last("score"), "place"))
    return found.select("file", "title", rank.alias("rank"), "sequence", "score")


#: Separator, title column (from the end if negative), sequence column and what becomes of the sequence, by layout of a table.
_LAYOUTS = {
    "title_last": (",", -1, 2, lambda s: s),
    "square_brackets": ("\t", 0, 1, lambda s: F.replace(F.replace(s, F.lit("C[+57.021]"), F.lit("C(+57.02)")), F.lit("M[+15.995]"), F.lit("M(+15.99)"))),
    "named_brackets": ("\t", 0, 2, lambda s: F.replace(F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit("M(Oxidation)"), F.lit("M(+15.99)")), F.lit("C(Carbamidomethylation)"), F.lit("C(+57.02)"))),
}


def tool_table(spark: SparkSession, paths: str | list[str], layout: str) -> DataFrame:
    """(title, sequence) of a tool's table with one line a spectrum.

    Layouts: 'title_last' is comma-separated with bracketed shifts, 'square_brackets' tab-separated with shifts in square brackets,
    'named_brackets' tab-separated with residues parted by commas and modifications by name. The line of column names is known by what stands for
    its sequence and is left out; a sequence with an unknown modification is null. A title that occurs twice keeps both rows.
    """
    separator, title, sequence, plain = _LAYOUTS[layout]
    cells = F.split(F.regexp_replace("value", "\r$", ""), separator)
    at = F.get(cells, F.lit(title)) if title >= 0 else F.element_at(cells, title)
    raw = F.get(cells, F.lit(sequence))
    rows = spark.read.text(paths).where(F.size(cells) > max(title, sequence)).where(~raw.rlike("(?i)^(sequence|peptide|prediction|denovo|predicted|output_seq|target_seq)"))
    return rows.select(F.trim(at).alias("title"), _known(F.translate(plain(raw), "I", "L")).alias("sequence"))


def blocks(spark: SparkSession, paths: str | list[str], tool: str = "small_a") -> DataFrame:
    """(title, rank, sequence, score) of text with a line 'S<n> title' a spectrum and lines 'P<n> sequence score' below, in the tool's letters."""
    rows = under_headers(spark, paths, r"S\d*\s", r"P\d*\s")
    head, cells = F.split("header", r"\s+"), F.split("line", r"\s+")
    rank = F.regexp_extract(F.get(cells, F.lit(0)), r"(\d+)", 1)
    found = rows.select(F.get(head, F.lit(1)).alias("title"), F.when(rank != "", rank.cast("int")).alias("rank"), S.tool_letters(F.get(cells, F.lit(1)), tool).alias("sequence"), F.get(cells, F.lit(2)).alias("_score"))
    return found.withColumn("score", F.expr("try_cast(_score AS DOUBLE)")).drop("_score")


def coverage_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(protein_id, covered, total, rate) of written coverage files, by column names; summary lines are left out."""
    rows = spark.read.csv(paths, sep="\t", header=True)
    return rows.select(F.col("Protein").alias("protein_id"), *(F.expr(f"try_cast(`{c}` AS {t})").alias(n) for c, t, n in (("Coverage_AA_num", "LONG", "covered"), ("Total_AA_num", "LONG", "total"), ("Coverage_rate", "DOUBLE", "rate")))).where("covered IS NOT NULL")
