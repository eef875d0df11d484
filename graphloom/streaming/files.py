"""Streams of symbol files: each changed version of a file once, applied to a table kept as Parquet versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.incremental import upsert


def read_files(spark: SparkSession, folder: str, pattern: str = "*.rb") -> DataFrame:
    """(path, content, modified): a stream of whole source files."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def new_versions(files: DataFrame, late: str = "1 day") -> DataFrame:
    """A file version once, as long as its time is within `late` of the newest."""
    return files.withColumn("digest", F.sha2("content", 256)).withWatermark("modified", late).dropDuplicatesWithinWatermark(["path", "digest"])


def apply_to_table(stream: DataFrame, folder: str, key: str, checkpoint: str):
    """Upserts every batch into the newest version in `folder`; a batch that is tried again writes the same version again."""

    def upsert_batch(batch: DataFrame, number: int) -> None:
        before = newest(batch.sparkSession, folder, number)
        out = batch if before is None else upsert(batch.sparkSession.read.parquet(f"{folder}/v={before}"), batch, key)
        out.write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(upsert_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, folder: str, under: int | None = None) -> int | None:
    """Number of the last whole version, of those below `under`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    whole = [int(p.getName()[2:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((n for n in whole if under is None or n < under), default=None)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={newest(spark, folder)}")
