"""What the training-data operators share: reading tables, scratch tables, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.tables import fresh_name, materialise, running_total, scratch_path, shared_dir

__all__ = ["fresh_name", "materialise", "running_total", "scratch_path", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader opens the path, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", hot_share: int = 1000) -> DataFrame:
    """left joined with right, which is unique by `key` and tells in `weight` how many rows of left have it.

    Keys that hold more than one in `hot_share` of the weight, fewer than `hot_share` by
    arithmetic, are joined by a broadcast: their rows stay where they are. The rest is an
    ordinary join. Both are read twice, so they should be tables. A left join keeps rows of left
    that have no match, those of a null key too.
    """
    least = (right.agg(F.sum(weight)).first()[0] or 0) / hot_share
    hot = right.filter(F.col(weight) > least).drop(weight)
    hot = left.sparkSession.createDataFrame(hot.collect(), hot.schema)
    cold = right.filter(F.col(weight) <= least).drop(weight)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a null-free Arrow string or binary column and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold at most `limit` bytes; a longer text stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(rows, max(at + 1, to))
        yield at, to
        at = to
