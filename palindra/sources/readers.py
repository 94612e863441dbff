"""Readers for spectra, sequences, dictionaries and result tables; all parsing runs inside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palindra import chemistry

PAIR_SCHEMA = "a_data_idx int, b_data_idx int, a_title string, b_title string, a_charge int, b_charge int, a_pm double, b_pm double, delta_pm double, target_p double, decoy_p double, mirror_anno string, target_score double, decoy_score double, fdr double"


def mgf(spark: SparkSession, paths: str | list[str], side: str = "A", proton: float = chemistry.PROTON, labels: bool = False) -> DataFrame:
    """(side, file, scan, title, charge, prec_mz, mh, rt, peaks) of text spectra, one row a precursor.

    Blocks end with END IONS. The scan is the fourth dotted field of the title from the end. Further
    blocks of a scan in the same file add precursors and share the first block's peaks. Peak lines begin with a
    digit 1-9; the charge's last character and what follows the first precursor value are dropped. With ``labels`` the lines of
    labels a spectrum may have are read, too: doublets (digits), and kept, clusters and charges (each null where a block has no such line).
    """
    blocks = spark.read.option("lineSep", "END IONS").text(paths).where(F.col("value").contains("BEGIN IONS"))
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}=(.*?)\s*$", 1)
    title = field("TITLE")
    parts = F.split(title, r"\.")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike("^[1-9]"))
    peak = lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).cast("double").alias("mz"), F.split_part(x, F.lit(" "), F.lit(2)).cast("double").alias("inten"))
    numbers = lambda line, cut: F.when(line != "", F.transform(F.filter(F.split(line, cut), lambda x: x != ""), lambda x: x.cast("int")))
    named = {"doublets": ("NEUCODELABEL", ""), "kept": ("UNFILTERED", ","), "clusters": ("ISOTOPE_CLUSTER", ","), "charges": ("ISOTOPE_CHARGE", ",")} if labels else {}
    extra = [numbers(field(line), cut).alias(name) for name, (line, cut) in named.items()]
    rows = blocks.select(
        F.lit(side).alias("side"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_n"),
        F.try_element_at(parts, F.lit(-4)).cast("long").alias("scan"),
        title.alias("title"),
        F.regexp_extract("value", r"(?m)^CHARGE=(\d+)", 1).cast("int").alias("charge"),
        F.regexp_extract("value", r"(?m)^PEPMASS=(\S+)", 1).cast("double").alias("prec_mz"),
        F.regexp_extract("value", r"(?m)^RTINSECONDS=(\S+)", 1).cast("double").alias("rt"),
        F.transform(lines, peak).alias("peaks"),
        *extra,
    )
    first = W.partitionBy("file", "scan").orderBy("_n")
    rows = rows.withColumn("peaks", F.first("peaks").over(first))
    return rows.withColumn("mh", (F.col("prec_mz") - proton) * F.col("charge") + proton).select("side", "file", "scan", "title", "charge", "prec_mz", "mh", "rt", "peaks", *named)


def fasta(spark: SparkSession, paths: str | list[str], whole_header: bool = True) -> DataFrame:
    """(protein_id, header, seq) with I read as L; the id is the header or its first word."""
    rows = spark.read.option("lineSep", ">").text(paths).where(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.translate(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", ""), "I", "L")
    name = header if whole_header else F.split_part(header, F.lit(" "), F.lit(1))
    return rows.select(name.alias("protein_id"), header.alias("header"), seq.alias("seq"))


def pairs(spark: SparkSession, paths: str | list[str], with_fdr: bool = True) -> DataFrame:
    """The pair table: tab-separated with a header line."""
    schema = PAIR_SCHEMA if with_fdr else PAIR_SCHEMA.removesuffix(", fdr double")
    return spark.read.csv(paths, schema=schema, sep="\t", header=True, positiveInf="inf")


def elements(text: str) -> dict[str, tuple[list[float], list[float]]]:
    """Isotope masses and abundances by element, from lines name|m1,m2,|a1,a2,|."""
    out = {}
    for line in text.splitlines():
        cells = line.strip().removeprefix("E").partition("=")[2].split("|") if "=" in line else line.strip().split("|")
        if len(cells) >= 3 and cells[1]:
            out[cells[0]] = tuple([float(x) for x in c.split(",") if x] for c in cells[1:3])
    return out


def modifications(text: str) -> dict[str, tuple[str, str, float, str, bool]]:
    """(sites, position, mono mass, composition, common) by name, from pairs of lines
    name<k>=<Name> <flag> and <Name>=<sites> <position> <mono> <avg> 0 <composition>."""
    common, out = {}, {}
    for line in text.splitlines():
        key, _, value = line.strip().partition("=")
        cells = value.split()
        if key.startswith("name") and len(cells) == 2 and key[4:].isdigit():
            common[cells[0]] = cells[1] == "1"
        elif key in common and len(cells) >= 6:
            out[key] = (cells[0], cells[1], float(cells[2]), cells[-1], common[key])
    return out


def search_results(spark: SparkSession, paths: str | list[str], title: int = 0, sequence: int = 5, mods: int = 10) -> DataFrame:
    """(title, sequence, modifications) of a tab-separated search result by column places."""
    cells = F.split("value", "\t")
    rows = spark.read.text(paths).where(F.size(cells) > max(title, sequence, mods))
    return rows.select(F.get(cells, F.lit(title)).alias("title"), F.translate(F.get(cells, F.lit(sequence)), "I", "L").alias("sequence"), F.get(cells, F.lit(mods)).alias("modifications")).where(F.lower("title") != "file_name")
