"""Small helpers shared by every operator."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have, by count, before it is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
#: The same for rows of two 64-bit numbers, which take about an eighth of the memory of rows with names.
BROADCAST_LONGS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: spark.checkpoint.dir of the session. Where none is set a local session gets one of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        folder = sc.getCheckpointDir()
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="haatgrid-"))
            folder = sc.getCheckpointDir()
    return folder


#: Folders written by ``cut`` in this process.
_WRITTEN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the rows to the shared folder; they survive the loss of executors, and stay until ``release``.

    The shuffle files of what was written are of no use then: the driver's garbage is collected at once, so that Spark deletes them. It takes a second
    collection, a moment later, to reach those of the plan just run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/haatgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    for pause in (0.2, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def release(spark: SparkSession) -> None:
    """Delete what ``cut`` has written; frames made from it can't be read any more."""
    while _WRITTEN:
        fs, p = _file_system(spark, _WRITTEN.pop())
        fs.delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if it has at most ``rows`` rows, and for a join that shuffles otherwise, whatever the planner takes its size for.

    The count is exact; give it a stored frame (a source or the result of ``cut``)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def day_number(date_key):
    """Days since 1970-01-01 of a yyyymmdd integer; null where it is no date."""
    s = date_key.cast("string")
    ok = F.length(s) == 8
    return F.unix_date(F.when(ok, F.try_to_timestamp(s, F.lit("yyyyMMdd"))).cast("date"))


def key_of_day(day):
    """yyyymmdd integer of a day number."""
    d = F.date_from_unix_date(day)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)
