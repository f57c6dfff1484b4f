"""An addition, not part of what is matched: a folder of want-lists as a stream, acquired batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.flows import acquire
from ..sources.readers import WANTS


def acquire_stream(spark: SparkSession, folder: str, library: DataFrame, out: str, checkpoint: str):
    """Each new CSV of the folder becomes rows of the plan table at out. A batch that is run again overwrites its own part.

    J2 with a library that grows: a track that an earlier batch has planned is known to the later ones, so it is work once,
    whether the files come together or one by one. A batch reads the keys of the batches before it, never its own, so running
    it again, after a stop in the midst of it, gives the same rows. Rows are ordered by file, then line: such files
    aren't split, so within one the numbers rise with its lines.
    """

    def batch(rows: DataFrame, number: int) -> None:
        placed = rows.withColumn("row", F.struct("_file", F.monotonically_increasing_id().alias("line"))).drop("_file")
        known = library.select("key")
        if number:
            known = known.unionByName(spark.read.schema("key string, batch int").parquet(out).where(F.col("batch") < number).select("key"))
        acquire(placed, known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(WANTS).csv(folder, header=True, multiLine=True, escape='"').select("*", F.col("_metadata.file_path").alias("_file"))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
