"""Counts by status that keep up with inserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.functions import text as T
from docketry.operators.tables import remove_path
from docketry.streaming.uploads import epochs

CHANGES = "id long, seq long, op string, status string"
COUNTS = "status string, n long"
#: A row's last change. Of changes with one number a delete comes last, then the largest status, so that no order of arrival counts.
CHANGE = "struct<seq: bigint, gone: boolean, status: string>"
LASTS = f"id long, before {CHANGE}, last {CHANGE}"
#: After so many micro-batches the last changes of all rows are written anew, and not only those of the batch.
WHOLE_EVERY = 16


def taken(changes: DataFrame) -> DataFrame:
    """(id, last) of changes(id, seq, op, status).

    op is `delete`, or anything else for a row that is there from now on. Rows without id or seq say
    nothing. Statuses are normalized; a null one counts as Anomalie.
    """
    gone = F.lower(F.coalesce("op", F.lit(""))) == "delete"
    status = F.when(gone, "").otherwise(T.normalize_status(F.coalesce("status", F.lit(""))))
    return changes.filter("id is not null and seq is not null").select("id", F.struct("seq", gone.alias("gone"), status.alias("status")).cast(CHANGE).alias("last"))


def renewed(changes: DataFrame, known: DataFrame | None) -> DataFrame:
    """(id, before, last): each row's last change of known(id, last) and of known and `taken` changes together. Aggregates of Spark's, which never leave the JVM."""
    rows = changes.select("id", F.lit(None).cast(CHANGE).alias("before"), "last")
    if known is not None:
        rows = rows.unionByName(known.select("id", F.col("last").alias("before"), "last"))
    return rows.groupBy("id").agg(F.max("before").alias("before"), F.max("last").alias("last"))


def deltas(lasts: DataFrame) -> DataFrame:
    """(status, delta): what changed rows take back and add to the counts."""
    here = lambda c, n: F.when(F.col(c).isNotNull() & ~F.col(f"{c}.gone"), F.struct(F.col(f"{c}.status").alias("status"), F.lit(n).alias("delta")))
    return lasts.select(F.inline(F.array_compact(F.array(here("before", -1), here("last", 1))))).groupBy("status").agg(F.sum("delta").alias("delta"))


def kept_counts(changes: DataFrame, target: str, checkpoint: str, keep: int = 3) -> StreamingQuery:
    """Keep (status, n) under `target`, a small table for each micro-batch: the counts of the batch before and what its changes add and take back.

    Of an id's changes the one with the largest seq holds, whenever it arrives, and a change that
    arrives again does nothing. Rows' last changes are a log under `target`/last, to which a batch
    adds the rows that it changes, after having read those of the log: one shuffle of both by id. A
    batch that is run again starts from the counts and the log of the batch before and replaces its
    own folders.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = [e for e in epochs(spark, target) if e < epoch]
        first = max(epoch - 1, 0) // WHOLE_EVERY * WHOLE_EVERY
        log = [f"{target}/last/epoch={e}" for e in epochs(spark, f"{target}/last") if first <= e < epoch]
        lasts = renewed(taken(batch), spark.read.schema(LASTS).parquet(*log) if log else None)
        changed = F.col("before").isNull() | (F.col("last") > F.col("before"))
        (lasts if epoch % WHOLE_EVERY == 0 else lasts.filter(changed)).write.option("compression", "zstd").mode("overwrite").parquet(f"{target}/last/epoch={epoch}")
        rows = deltas(spark.read.schema(LASTS).parquet(f"{target}/last/epoch={epoch}").filter(changed)).withColumnRenamed("delta", "n")
        if done:
            rows = rows.unionByName(spark.read.schema(COUNTS).parquet(f"{target}/epoch={done[-1]}"))
        rows.groupBy("status").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
        for old in epochs(spark, target)[:-keep]:
            remove_path(spark, f"{target}/epoch={old}")
        for old in [e for e in epochs(spark, f"{target}/last") if e < first]:
            remove_path(spark, f"{target}/last/epoch={old}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """(status, n) after the last micro-batch; statuses that no row has any more are left out."""
    done = epochs(spark, target)
    if not done:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(f"{target}/epoch={done[-1]}").filter("n <> 0")
