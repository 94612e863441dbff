"""Tables cut from their lineage, written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from palindra.operators.lineage import sweep

_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a new temporary folder where it is unset.

    Raises ValueError on a cluster without that setting: a machine-local folder would not be visible
    to the other executors.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="palindra-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, remembered for :func:`release`."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return a scan of the files.

    The scan has no lineage to recompute, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no DataFrame reads any more, and what :func:`sweep` does."""
    for table in tables:
        spark = table.sparkSession
        written = _WRITTEN.get(spark.sparkContext.applicationId, [])
        for path in {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in table.inputFiles()}:
            for own in [x for x in written if x.rsplit("/", 1)[-1] == path]:
                _delete(spark, own)
                written.remove(own)
    for spark in {t.sparkSession for t in tables}:
        sweep(spark)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete what this application materialised; returns the number of paths removed.

    Call it only when no DataFrame that reads such a table is needed any more.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
