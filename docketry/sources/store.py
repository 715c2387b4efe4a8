"""The registry as a stored table, dealt into buckets by id, of which a change rewrites only those that it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.registry import update_by_id
from docketry.operators.tables import materialise, path_exists, remove_path

BUCKET = "bucket"


@dataclass(frozen=True)
class Store:
    """Parquet under `path`/bucket=N by a hash of `id`. The number of buckets is fixed for good: choose it so that one holds some 100 MB.

    One writer at a time. A change is worked out whole in the shared folder first; then folders of
    touched buckets are replaced, one after the other. A writer that breaks off there leaves some
    buckets old and some new: the same call again ends in the same table, as all changes are by value.
    """

    path: str
    buckets: int = 256

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Write rows(id, ...) as a new store; there must be none. Rows may share an id."""
        self._dealt(rows).write.mode("error").partitionBy(BUCKET).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def lookup(self, spark: SparkSession, row_id: int) -> DataFrame:
        """Rows of one id: one bucket is read, and in it the row groups that may hold the id."""
        rows = spark.read.parquet(self.path)
        return rows.filter((F.col(BUCKET) == self._bucket(F.lit(row_id))) & (F.col("id") == row_id)).drop(BUCKET)

    def insert(self, rows: DataFrame) -> None:
        """Append new rows; files that are there stay as they are."""
        self._dealt(rows.select(*self.read(rows.sparkSession).columns)).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def update(self, changes: DataFrame, columns: list[str], order: str | None = None) -> list[int]:
        """Put changes(id, columns) into the rows with their id, as `registry.update_by_id` does; the buckets that were rewritten."""
        spark = changes.sparkSession
        changes = materialise(changes.select("id", *columns, *([order] if order and order not in columns else [])), "store-changes")
        touched = self._touched(changes)
        self._replace(spark, touched, lambda rows: update_by_id(rows, changes, columns, order))
        return touched

    def delete(self, ids: DataFrame) -> DataFrame:
        """Take out the rows of ids(id); (id, http) says for each distinct id 200, or 404 where there was no row."""
        spark = ids.sparkSession
        ids = materialise(ids.select("id").distinct(), "store-ids")
        touched = self._touched(ids)
        there = spark.read.parquet(self.path).filter(F.col(BUCKET).isin(touched)).select("id").distinct().withColumn("there", F.lit(True))
        told = materialise(ids.join(there, "id", "left").select("id", F.when(F.col("there"), 200).otherwise(404).alias("http")), "store-deleted")
        self._replace(spark, self._touched(told.filter("http = 200")), lambda rows: rows.join(ids, "id", "left_anti"))
        return told

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys(id): as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.filter("id is not null").select(self._bucket(F.col("id"))).distinct().collect())

    def _dealt(self, rows: DataFrame) -> DataFrame:
        bucket = self._bucket(F.col("id"))
        return rows.withColumn(BUCKET, bucket).repartition(BUCKET).sortWithinPartitions(BUCKET, "id")

    def _replace(self, spark: SparkSession, touched: list[int], change) -> None:
        if not touched:
            return
        old = spark.read.parquet(self.path)
        columns = [c for c in old.columns if c != BUCKET]
        new = materialise(self._dealt(change(old.filter(F.col(BUCKET).isin(touched)).select(*columns)).select(*columns)), "store-rewritten")
        left = {r[0] for r in new.select(BUCKET).distinct().collect()}
        new.repartition(BUCKET).sortWithinPartitions(BUCKET, "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for bucket in set(touched) - left:  # a bucket without rows is not written, so its old files would stay
            remove_path(spark, f"{self.path}/{BUCKET}={bucket}")


def open_store(spark: SparkSession, path: str, buckets: int = 256) -> Store:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return Store(path, buckets)
