"""A corpus pipeline: toxicity filter, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.llm import columns, line_dedup, mixing, near_dups, packing, storage, toxicity


def _aside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns of the names ``added`` renamed, and a function that selects the columns of ``docs`` again."""
    lower = {a.lower() for a in added}
    clash = [c for c in docs.columns if c.lower() in lower]
    other = dict(zip(clash, columns.fresh([*docs.columns, *added], *clash)))
    return docs.withColumnsRenamed(other), lambda out: out.select(*(F.col(other.get(c, c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold, columns unchanged, a column named score included.

    Null and empty texts score the base rate and stay, repeated rows are judged alike; an empty table stays empty.
    """
    terms, weights = toxicity.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, back = _aside(docs, ("score",))
    return back(toxicity.scored(rows, terms, weights).where(F.col("score") < toxicity.THRESHOLD))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that loses all its lines goes, n_chars follows the text.

    Rows with a null text or id stay as they are; other columns are unchanged, whatever their names.
    """
    rows, back = _aside(docs, ("n_lines", "n_removed", "n_links", "class_id"))
    out = line_dedup.dedup(rows).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return near_dups.kept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null texts have no words and go with their source's whole copies.

    A null source is a source, equal ids are taken alike; an empty table stays empty.
    """
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows; a document taken twice is packed twice."""
    return packing.pack(packing.encode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The toxicity model, the tokenizer and the retrieval have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
