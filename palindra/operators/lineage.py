"""Tables that several branches of a plan read are computed once."""

from __future__ import annotations

import contextlib
import gc
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATIENCE_MS = 10_000

_WRITTEN: dict[str, list[str]] = {}


def _shared(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return base.rstrip("/") if base else None


def once(rows: DataFrame) -> DataFrame:
    """``rows`` written as Parquet into the folder that ``spark.checkpoint.dir`` names, so that every later branch reads the files.

    All executors share that folder, so a lost executor costs only its own tasks. Where it is unset the plan stays as it is.
    """
    spark = rows.sparkSession
    base = _shared(spark)
    if base is None:
        return rows
    path = f"{base}/once-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of ended steps deleted now; else they stay until the driver happens to collect its garbage.

    Spark deletes only files that no plan can read any more.
    """
    sc = spark.sparkContext
    gc.collect()
    with contextlib.suppress(Py4JJavaError):  # a busy listener still holds the plan of the step; its files then stay a while
        sc._jsc.sc().listenerBus().waitUntilEmpty(_PATIENCE_MS)
    for pause in (0, 0.2):  # one collection alone leaves the last step's files
        time.sleep(pause)
        sc._jvm.System.gc()


def in_portions(rows: DataFrame, key: str, most: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(rows)`` for rows that are worked on apart by ``key``: one portion of about ``most`` rows after the other.

    A portion's result is written by :func:`once` and its shuffle files go before the next begins, so what the steps of ``make``
    shuffle lies on disk for one portion only. All rows are in a portion; where nothing can be written there is one.
    """
    spark = rows.sparkSession
    n = -(-rows.count() // most)
    if n < 2 or _shared(spark) is None:
        return make(rows)
    parts = []
    for k in range(n):
        parts.append(once(make(rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))))
        sweep(spark)
    return reduce(DataFrame.union, parts)


def release(spark: SparkSession) -> int:
    """Delete what this application wrote; returns the number of tables. For when no DataFrame reads one any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)
