"""Bounded samples of labelled rows for the small models, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import unit_hash

SAMPLE = 8000


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, where=None) -> DataFrame:
    """(doc_id, text, label) of about ``most`` labelled rows at most.

    A label is the largest of a document's labels; null labels and ids are left out. Every labelled
    row is kept while there are at most ``most``, beyond that those whose id hash lies below the
    matching fraction, so the broadcast id list stays at about ``most`` rows for any input.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(where) if where is not None else rows
    total = rows.count()
    if total > most:
        rows = rows.where(unit_hash(F.col("doc_id")) < int(most / total * 2**60))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = F.broadcast(rows)  # about ``most`` pairs of integers
    return docs.select("doc_id", "text").join(rows, "doc_id")
