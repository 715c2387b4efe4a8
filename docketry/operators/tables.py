"""Scratch tables in the folder that driver and executors share, and sums along an order over them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, local mode (tests) makes a temporary folder the checkpoint
    directory of the context. On a cluster that is an error: each machine would have its own.
    Scratch tables stay until whoever owns the folder clears it; Spark never does.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no folder."""
    if not path_exists(spark, path):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def fresh_name(columns: Iterable[str], wish: str) -> str:
    """A column name that none of `columns` has, in any case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def running_total(df: DataFrame, order: list[str], value: str | None = None, group: str | None = None, into: str = "before") -> DataFrame:
    """df with `into`: the sum of `value` (the number, without it) of the rows that come before in `order`, inside `group`.

    Rows are dealt out by ranges of group and order and added up inside a range; the ranges' own
    sums, one for each task and group, then tell where each begins. Rows that tie in everything
    are told apart by Spark's row number, so they spread over tasks too; which of them comes first
    is not fixed. Null is a group of its own.
    """
    spark, keys = df.sparkSession, [k for k in [group] if k]
    part, amount, serial, first = (fresh_name([*df.columns, into], x) for x in ("range_part", "range_amount", "range_serial", "range_first"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(df.withColumn(serial, F.monotonically_increasing_id()), "running-rows")
    rows = rows.repartitionByRange(tasks, *keys, *order, serial).withColumn(part, F.spark_partition_id())
    rows = rows.withColumn(amount, F.col(value).cast("long") if value else F.lit(1).cast("long"))
    rows = materialise(rows, "running-ranges")
    inside = Window.partitionBy(part, *keys).orderBy(*order, serial).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part, *keys).agg(F.sum(amount).alias(amount))
    parts = parts.select(F.col(part).alias(f"{part}_"), *(F.col(k).alias(f"{first}_group") for k in keys), F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias(first))
    placed = rows.withColumn(into, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.col(part) == F.col(f"{part}_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{first}_group"))
    return placed.join(parts, same).select(*(f"`{c}`" for c in df.columns), (F.col(into) + F.col(first)).alias(into))
