"""The registry's listing in pages: newest first, each page read from its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators.registry import backfill
from docketry.operators.tables import running_total

PART, PLACE = "part", "place"


def write_listing(registry: DataFrame, path: str, rows_per_part: int = 100_000, record: str | None = "extraction_result") -> None:
    """Write the listing of registry(id, date, status, ...) as it stands, in parts of so many rows each, with every row's place.

    Rows are backfilled from `record`, if named, their status is normalized and their files left
    out. They come newest first and then by id, both descending, null last. A small table of the
    parts' last rows tells where to go on behind a row.
    """
    rows = (backfill(registry.drop("file_data"), record) if record else registry.drop("file_data")).withColumn("status", T.normalize_status(F.col("status")))
    # Descending by negation, so that ranges of the order are ranges of these columns.
    rows = rows.withColumns({"order_date": -F.unix_micros(F.col("date").cast("timestamp")), "order_id": -F.col("id")})
    rows = rows.withColumns({"undated": F.col("order_date").isNull(), "unnamed": F.col("order_id").isNull()})
    rows = running_total(rows, ["undated", "order_date", "unnamed", "order_id"], into=PLACE).drop("order_date", "order_id", "undated", "unnamed")
    rows = rows.withColumn(PART, F.floor(F.col(PLACE) / rows_per_part))
    rows.repartition(PART).sortWithinPartitions(PART, PLACE).write.partitionBy(PART).parquet(f"{path}/rows")
    spark = registry.sparkSession
    ends = spark.read.parquet(f"{path}/rows").groupBy(PART).agg(F.max(F.struct(PLACE, "date", "id")).alias("x"))
    ends.select(PART, F.col(f"x.{PLACE}").alias("last_place"), F.col("x.date").alias("last_date"), F.col("x.id").alias("last_id")).coalesce(1).write.parquet(f"{path}/ends")


def page(spark: SparkSession, path: str, number: int, size: int, rows_per_part: int = 100_000) -> DataFrame:
    """Page `number`, from 0, of so many rows, in order; only the parts that hold it are read."""
    first, last = number * size, (number + 1) * size - 1
    rows = spark.read.parquet(f"{path}/rows").filter(F.col(PART).between(first // rows_per_part, last // rows_per_part) & F.col(PLACE).between(first, last))
    return rows.drop(PART).orderBy(PLACE)


def pages(spark: SparkSession, path: str, size: int) -> DataFrame:
    """All rows with the number of the page, of so many rows, that holds them: one pass, however many pages there are."""
    return spark.read.parquet(f"{path}/rows").drop(PART).withColumn("page", F.floor(F.col(PLACE) / size).cast("int"))


def page_after(spark: SparkSession, path: str, date, row_id: int | None, size: int, rows_per_part: int = 100_000) -> DataFrame:
    """The next rows behind one of this date and id, in order; the row itself need not be there any more.

    Read are the parts from there on that hold so many rows.
    """
    behind = lambda d, i: (F.col(d) < F.lit(date)) | (F.col(d).isNull()) | ((F.col(d) == F.lit(date)) & ((F.col(i) < F.lit(row_id)) | F.col(i).isNull()))
    if date is None:
        behind = lambda d, i: F.col(d).isNull() & ((F.col(i) < F.lit(row_id)) | F.col(i).isNull())
    ends = spark.read.parquet(f"{path}/ends").filter(behind("last_date", "last_id")).orderBy(PART).limit(1).collect()
    rows = spark.read.parquet(f"{path}/rows")
    if not ends:
        return rows.limit(0).drop(PART)
    here = ends[0][PART]
    return rows.filter(F.col(PART).between(here, here + -(-size // rows_per_part)) & behind("date", "id")).drop(PART).orderBy(PLACE).limit(size)
