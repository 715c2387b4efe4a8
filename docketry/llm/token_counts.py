"""Exact length histogram of a corpus in tokens, and what suffix sums over it answer.

Documents are aggregated by encoded length. Sums from above then give, for every context limit
that is a length of the corpus, the documents and tokens that fit, those that do not, and the
tokens left when longer documents are truncated; between lengths these figures are linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import tokens
from docketry.llm.common import materialise


def _lengths(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encoder = tokens.load(vocabulary)
    for batch in batches:
        found = [len(encoder.encode(x)) // 4 for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["length"])


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(length, n_docs): how many rows of docs(text) have so many tokens. Null is the empty text, of length 0."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    work = partial(_lengths, vocabulary=vocabulary or tokens.default_vocabulary())
    return texts.mapInArrow(work, "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, group: int = 1024) -> DataFrame:
    """The histogram with, for each length taken as the context limit:

    docs_longer (documents beyond it), tokens_longer (theirs), total_docs, total_tokens,
    truncated_total (tokens kept when each document is cut to the limit) and quantile (the
    share of documents that fit). Sums run over groups of `group` lengths first and then inside
    a group, so that no task sees more than a group's lengths or the list of groups.
    An empty table gives no rows.
    """
    rows = histogram.withColumn("part", F.floor(F.col("length") / group)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    rows = materialise(rows, "length-histogram")
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("sum_tokens"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    parts = parts.select(
        "part",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("sum_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(every).alias("total_docs"),
        F.sum("sum_tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(parts, "part").select(
        "length",
        "n_docs",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_above") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_longer"),
        "total_docs",
        "total_tokens",
    )
    return out.withColumns({
        "truncated_total": F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer"),
        "quantile": (F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs"),
    })


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept at any context limit, from the largest length at or below it."""
    fits = sums.filter(F.col("length") <= limit)
    beyond = sums.filter(F.col("length") > limit).agg(F.sum("n_docs").alias("docs"))
    return fits.agg(F.sum(F.col("length") * F.col("n_docs")).alias("whole")).crossJoin(beyond).select(
        (F.coalesce("whole", F.lit(0)) + F.lit(limit) * F.coalesce("docs", F.lit(0))).alias("truncated_total")
    )


def token_quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least `share` of the documents do not exceed."""
    return sums.filter(F.col("quantile") >= share).agg(F.min("length").alias("length"))
