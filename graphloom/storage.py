"""Tables written to cut lineage, in the folder that all machines share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_SWEPT: set[str] = set()
_RECORDING: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session of one machine gets one of its own where that is unset; elsewhere it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="graphloom-")
    return _OWN_DIR[app]


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def settle(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage ends there, whichever executor is lost.

    The session's tables are deleted when it ends, and earlier by discard().
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/graphloom/{spark.sparkContext.applicationId}"
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if home not in _SWEPT:
        _SWEPT.add(home)
        fs, p = _file_system(spark, home)
        fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    for tables in _RECORDING:
        tables.append(out)
    return out


@contextmanager
def recorded():
    """A list of the tables that are settled within."""
    tables: list[DataFrame] = []
    _RECORDING.append(tables)
    try:
        yield tables
    finally:
        _RECORDING.remove(tables)


def discard(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "__dict__", {}).get("_settled_at")
        if path:
            fs, p = _file_system(t.sparkSession, path)
            fs.delete(p, True)


def discard_unread(tables: list[DataFrame], by: DataFrame) -> None:
    """Delete those settled tables of which `by` reads no file."""
    files = by.inputFiles()
    discard(*[t for t in tables if not any(t._settled_at.removeprefix("file:").lstrip("/") in f for f in files)])


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to, which it does when garbage is collected, and on a roomy driver that may be never.

    Those of the job before go only with a second collection, some time after what the first one found has been finalized.
    """
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
