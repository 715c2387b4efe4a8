"""From raw documents to packed training sequences: five stages, each one of the operators.

Every stage but the last takes and returns the columns of documents. Its result is written as
Parquet into the shared folder and read again as the next stage's input. Every row is decided on
by itself: a stage that drops rows tells them apart by their place in its input's files, as a doc_id
may be null or repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import fresh_name, materialise, read_table
from docketry.llm.decontam import contamination
from docketry.llm.exact_dedup import exact_duplicates
from docketry.llm.lang_id import UNKNOWN, identify_languages
from docketry.llm.packing import pack_documents
from docketry.llm.simhash_dedup import near_duplicates

#: Up to so many dropped rows (8 bytes each) are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


#: A table of more files is written anew with a key; of fewer, the files' names are sent to every task.
MOST_FILES = 20_000


def _is_plain_scan(docs: DataFrame) -> bool:
    """Whether docs is a table's files, read and at most filtered or projected: then a row has one place in one file."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key that is unique by row and stays the same, and the key's name.

    The rows of a Parquet table have one already, their file and place in it. Anything else is
    written with a key of its own.
    """
    key, path, place, number = (fresh_name(docs.columns, x) for x in ("row_key", "key_file", "key_place", "key_number"))
    if _is_plain_scan(docs):
        try:
            rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
            files = [r[0] for r in docs.select("_metadata.file_path").distinct().limit(MOST_FILES + 1).collect()]
        except AnalysisException:  # another format, or a column called _metadata
            files = []
        if 0 < len(files) <= MOST_FILES:
            numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(sorted(files))], f"{path} string, {number} long")
            rows = rows.join(F.broadcast(numbers), path).withColumn(key, F.shiftleft(number, 40) + F.col(place))
            return rows.drop(path, place, number), key
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(keyed: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """keyed without the rows in dropped, and without the key."""
    gone = materialise(dropped.select(key), "dropped-rows")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, key, "left_anti").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a recognisable language: null, or without any letter."""
    found, sure = fresh_name(docs.columns, "found"), fresh_name(docs.columns, "sure")
    told = identify_languages(docs, docs.columns, (found, sure))
    return told.filter(~F.col(found).eqNullSafe(F.lit(UNKNOWN))).drop(found, sure)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; of rows that share it too, one."""
    keyed, key = _keyed(docs)
    return _without(keyed, key, exact_duplicates(keyed, key=key).filter("not kept"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the row with the smallest doc_id stays; of rows that share it too, one."""
    keyed, key = _keyed(docs)
    return _without(keyed, key, near_duplicates(keyed, key=key).filter("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    keyed, key = _keyed(docs)
    return _without(keyed, key, contamination(keyed, read_table(spark, sf_dir, "benchmark"), key=key).filter("n_hit > 0"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no language model, no XXH64 and no tokenizer; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
