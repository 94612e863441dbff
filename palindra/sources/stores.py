"""Spectra that were parsed once: a cache of what changed, and a store from which a few titles are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.sources import readers


def files(spark: SparkSession, listed: str, extension: str = ".mgf") -> DataFrame:
    """(file, size, modified) of a list of paths separated by '|': files, and folders with all that lies below them.

    Only names with the extension, in any case, count; a file that is listed twice counts once.
    """
    found = None
    for path in filter(None, (p.strip() for p in listed.split("|"))):
        meta = F.col("_metadata")
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"))
        found = own if found is None else found.union(own)
    if found is None:
        raise ValueError("no path is listed")
    return found.where(F.endswith(F.lower("file"), F.lit(extension.lower()))).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_spectra(spark: SparkSession, listed: str, cache: str, side: str = "A", extension: str = ".mgf") -> DataFrame:
    """The spectra of the listed files, of which only those are parsed that are new or changed since the last call.

    ``cache`` holds a folder of parsed files a call and a manifest (file, size, modified, batch), written after its folder, so a
    call that failed leaves nothing that is read. A changed file is read from its last folder. Files that are no longer listed are not returned.
    """
    now = files(spark, listed, extension)
    manifest = f"{cache}/manifest"
    schema = "file string, size long, modified timestamp, batch string"
    seen = spark.read.schema(schema).parquet(manifest) if _exists(spark, manifest) else spark.createDataFrame([], schema)
    fresh = now.join(seen, ["file", "size", "modified"], "left_anti")
    paths = [r.file for r in fresh.select("file").collect()]  # names of files, as a reader takes them
    if paths:
        batch = uuid.uuid4().hex
        readers.mgf(spark, paths, side).write.parquet(f"{cache}/{batch}")
        fresh.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(manifest)
        seen = spark.read.schema(schema).parquet(manifest)
    current = now.join(seen, ["file", "size", "modified"]).select("file", "batch").distinct()
    batches = [r.batch for r in current.select("batch").distinct().collect()]  # one a call
    out = None
    for batch in batches:
        rows = spark.read.parquet(f"{cache}/{batch}").withColumn("batch", F.lit(batch))
        out = rows if out is None else out.unionByName(rows)
    columns = "side string, file string, scan long, title string, charge int, prec_mz double, mh double, rt double, peaks array<struct<mz:double,inten:double>>"
    if out is None:
        return spark.createDataFrame([], columns)
    return out.join(current, ["file", "batch"], "left_semi").select("side", "file", "scan", "title", "charge", "prec_mz", "mh", "rt", "peaks")


def write_titles(spectra: DataFrame, path: str, rows_a_group: int = 2000) -> None:
    """Spectra as Parquet in ranges of titles, with statistics and Bloom filters of the titles a group of rows."""
    ordered = spectra.repartitionByRange("title").sortWithinPartitions("title")
    ordered.write.option("parquet.bloom.filter.enabled#title", "true").option("parquet.block.row.count.limit", str(rows_a_group)).parquet(path)


def by_titles(spark: SparkSession, path: str, titles: list[str]) -> DataFrame:
    """The spectra of a few titles: files and groups of rows without any of them are skipped before they are read."""
    return spark.read.parquet(path).where(F.col("title").isin(titles))
