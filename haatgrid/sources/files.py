"""Files in and out: multi-file scans, typed seeds, inventories, replaceable partitions, exports."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_parquet(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Parquet files of one shape whose types may differ from file to file (an integer price here, a double there): files of one schema are read together,
    cast to ``schema`` by name, and the few kinds joined; missing columns are null. ``source_file`` has each row's file name."""
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    out = None
    for same in kinds.values():
        df = spark.read.parquet(*same)
        cols = [(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
        df = df.select(*cols, F.col("_metadata.file_name").alias("source_file"))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], T.StructType([*schema, T.StructField("source_file", T.StringType())]))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV files with a header, typed by ``schema``, or all text without one."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path, enforceSchema=False) if schema else reader.option("inferSchema", False).csv(path)
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, format and size of the files below a folder, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(name.alias("file_name"), F.regexp_extract(name, r"\.(\w+)$", 1).alias("format"), F.col("length").alias("n_bytes"))


def describe(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, column_name string, column_type string")


def replace_source(spark: SparkSession, target: str, source: str, load: Callable[[], DataFrame], log: str) -> None:
    """Replace the rows of one source of a table partitioned by source, all or nothing, and log the run.

    The rows are written to a folder of their own first and moved into place last, so a load that fails leaves the old rows as they were;
    the failure is logged and raised. ``target`` and ``log`` are local or mounted folders."""
    run, part = str(uuid.uuid4()), Path(target) / f"source={source}"
    fresh = Path(target) / f"_new-{run}"

    def note(status: str, rows: int | None) -> None:
        spark.createDataFrame([(run, source, status, rows)], "run_id string, source string, status string, n_rows long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(log)

    try:
        load().drop("source").write.parquet(str(fresh))
        n = spark.read.parquet(str(fresh)).count()
    except Exception:
        shutil.rmtree(fresh, ignore_errors=True)
        note("failed", None)
        raise
    old = Path(target) / f"_old-{run}"
    if part.exists():
        part.rename(old)
    fresh.rename(part)
    shutil.rmtree(old, ignore_errors=True)
    note("success", n)


def replace_partition(df: DataFrame, target: str, column: str) -> None:
    """Write ``df``, replacing only those partitions of ``column`` that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(target)


def export(frames: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet", "csv")) -> DataFrame:
    """Write each frame in each format, and return the manifest: name, format, rows and bytes."""
    spark, rows = next(iter(frames.values())).sparkSession, []
    for name, df in frames.items():
        first = f"{folder}/{name}.{formats[0]}"
        df.write.mode("overwrite").format(formats[0]).save(first)
        n = spark.read.format(formats[0]).schema(df.schema).load(first)
        count = n.count()
        for f in formats:
            path = f"{folder}/{name}.{f}"
            if f != formats[0]:
                w = n.write.mode("overwrite").format(f)
                (w.option("header", True) if f == "csv" else w).save(path)
            rows.append((name, f, count, sum(p.stat().st_size for p in Path(path).rglob("part-*"))))
    return spark.createDataFrame(rows, "name string, format string, n_rows long, n_bytes long")


def latest_days(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days that occur."""
    last = df.agg(F.max(day).alias("_last"))
    return df.join(F.broadcast(last), F.col(day) > F.date_sub("_last", days)).drop("_last")  # one row
