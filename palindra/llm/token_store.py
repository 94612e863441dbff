"""Token ids in ORC: integer run-length encoded stripes, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import storage, text, tokens

END_ID = 2
_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start_in_file", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, stripe_bytes: int = 16 << 20, index_stride: int = 1000) -> None:
    """Encode every whole text, append ``end_id``, and write ORC files in ascending doc_id order.

    One range shuffle orders the texts; each task encodes its range and writes one file, so file
    order is id order. A document's row holds its ids and the number of ids before it in its file.
    Null texts are empty, a null id comes first, equal ids are ordered by text, empty tables
    give files without rows, and other columns are not read.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()

    def encode(batches) -> Iterator[pa.RecordBatch]:
        enc, at = tokens.encoder(vocabulary), 0
        for block in text.blocks(batches, "text"):
            ids, first = enc.ids(block.column("text"))
            n = np.diff(first) + 1
            ids = np.insert(ids.astype(np.int32), first[1:], end_id)
            upto = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(at + upto[:-1]), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))], schema=_IDS)
            at += int(upto[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    rows = ordered.mapInArrow(encode, "doc_id long, n_tokens long, start_in_file long, ids array<int>")
    rows.write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", str(index_stride)).option("orc.stripe.size", str(stripe_bytes)).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files, stripes in parallel.

    ``start`` counts the ids of all documents before: a file's offset comes from the token counts of
    the files before it (a scan of one integer column), one row a file.
    """
    rows = spark.read.schema("doc_id long, n_tokens long, start_in_file long, ids array<int>").orc(path).withColumn("file", F.col("_metadata.file_path"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    before = W.orderBy(F.desc("nulls"), F.asc_nulls_first("low"), "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # one row a file: the ids stay where they were read
    return rows.join(F.broadcast(files), "file").select("doc_id", (F.col("offset") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; stripes and row groups are pruned by statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with ``ids``."""

    def crc(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            upto = ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else []
            sums = [zlib.crc32(flat[upto[i] : upto[i + 1]]) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(upto), pa.int64()) if len(ids) else pa.array([], pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "token-orc")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(read(spark, path))
