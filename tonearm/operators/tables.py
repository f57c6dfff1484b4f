"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: What lasting() has written in this process.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, and only in local mode, a temporary folder that goes when Python ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tonearm-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def lasting(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back: its rows stay as they are, wherever tasks run again."""
    path = f"{shared_folder(df.sparkSession)}/tonearm/lasting-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what lasting() has written. Results that read it must be written before."""
    while _written:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan for work that is costly a row: in fewer splits than there are cores (one row group is one split, whatever its size) its rows are dealt out again; a scan that has enough is left as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
