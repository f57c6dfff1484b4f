"""What the operators of this subpackage share: the shared folder, tables that cut lineage, and column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset is one chosen here, and only in local mode, where all threads share one disk; it goes when
    Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tonearm-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tonearm/{name}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


#: Folders that new_path() has named in this process, in order.
_named: list[str] = []


def mark() -> int:
    """For release(): what was written until now."""
    return len(_named)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the folders named since mark(), but the table behind keep. Results that still read the others must be written before."""
    kept = {f.rsplit("/", 1)[0].split(":")[-1].lstrip("/") for f in keep.inputFiles()} if keep is not None else set()
    for path in _named[since:]:
        if path.split(":")[-1].lstrip("/") not in kept:
            _delete(spark, path)
    _named[since:] = [p for p in _named[since:] if p.split(":")[-1].lstrip("/") in kept]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by saved(), once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        _delete(spark, file.rsplit("/", 1)[0])


#: A side of a join is broadcast only up to so many rows of a few numbers, counted first; beyond that the planner chooses.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows. Counting stops there; the rows must be narrow."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with underscores put before it until it clashes with no column of df (case is ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column) -> F.Column:
    """crc32 of the value as text, modulo 3."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % 3
