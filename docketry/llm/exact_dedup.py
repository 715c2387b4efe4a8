"""Exact deduplication by skew-safe combining.

Copies are combined three times, always on the whole normalised text: inside each task, then
among the salted parts of a digest, then among the winners of those parts. A group that holds a
third of all rows therefore reaches the last step as a handful of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import join_skewed, materialise
from docketry.llm.phrases import bit_map, is_set

LOCAL = "uid long, rep_id long, digest binary, text string, n long, best int, members array<long>, rows array<long>"
ARROW = pa.schema([
    ("uid", pa.int64()), ("rep_id", pa.int64()), ("digest", pa.binary()), ("text", pa.string()),
    ("n", pa.int64()), ("best", pa.int32()), ("members", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
])


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _combine_locally(
    batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes], block_chars: int, members: int, keyed: bool
) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a block of rows, with the ids of its copies.

    A block ends once its distinct texts hold `block_chars` characters; a group that reaches
    `members` copies is written and started anew. Either only makes a later step merge more.
    """
    task, serial = TaskContext.get().partitionId(), 0
    groups: dict[bytes, list[tuple[str, list]]] = {}
    held = 0

    def rows(found: list[tuple[bytes, str, list]]) -> pa.RecordBatch:
        nonlocal serial
        out = {k: [] for k in ARROW.names}
        for d, text, own in found:
            ids = [i for i, _ in own]
            keys = [k for _, k in own] if keyed else None
            best = max(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
            for k, v in zip(ARROW.names, ((task << 33) + serial, ids[best], d, text, len(ids), best, ids, keys), strict=True):
                out[k].append(v)
            serial += 1
        return pa.RecordBatch.from_pydict(out, schema=ARROW)

    def drain() -> Iterator[pa.RecordBatch]:
        found = [(d, text, ids) for d, same in groups.items() for text, ids in same if ids]
        for i in range(0, len(found), 2000):
            yield rows(found[i : i + 2000])

    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for doc_id, key, text in zip(ids, keys, pc.ascii_lower(batch.column("text")).to_pylist(), strict=True):
            same = groups.setdefault(d := digest(text.encode()), [])
            own = next((x for t, x in same if t == text), None)
            if own is None:
                same.append((text, own := []))
                held += len(text) + 200
            own.append((doc_id, key))
            if len(own) >= members:
                yield rows([(d, text, own[:])])
                own.clear()
            if held >= block_chars:
                yield from drain()
                groups, held = {}, 0
    yield from drain()


def exact_duplicates(
    docs: DataFrame,
    digest: Callable[[bytes], bytes] = sha256,
    salts: int = 16,
    block_chars: int = 24_000_000,
    members: int = 8192,
    key: str | None = None,
) -> DataFrame:
    """One row for each row of docs(doc_id, text): which copy of its text stays.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The
    row with the largest doc_id stays, a null id being the smallest; of rows that also share
    the id exactly one stays. Other columns are ignored. Returns doc_id, keep_id, group_size,
    kept, digest, and `key` if given: a column of longs, unique by row, that tells which row is meant.

    Two texts count as copies only if the texts themselves are equal, so a weak digest (see
    the tests) costs time and changes nothing else.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(key).alias("row") if key else F.lit(None).cast("long").alias("row"))
    local = materialise(
        texts.mapInArrow(
            partial(_combine_locally, digest=digest, block_chars=block_chars, members=members, keyed=key is not None), LOCAL
        ),
        "exact-local",
    )
    # Texts of a digest that many tasks have stay where they are until they are salted; those of
    # one that no other task has, and a bit map of bounded size tells nearly all, don't move at all.
    shared = materialise(local.groupBy("digest").agg(F.count("*").alias("parts")).filter("parts > 1"), "exact-shared")
    known = docs.sparkSession.sparkContext.broadcast(bit_map(shared.select(F.xxhash64("digest").alias("fp"))))

    @F.pandas_udf("boolean")
    def may_be_shared(fp: pd.Series) -> pd.Series:
        return pd.Series(is_set(known.value, fp.to_numpy(np.int64).view(np.uint64)))

    some = local.filter(may_be_shared(F.xxhash64("digest"))).select("uid", "rep_id", "digest", "text", "n")
    by_salt = (
        join_skewed(some, shared, "digest", "parts")
        .withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(
            F.max(F.struct("rep_id", "uid")).alias("best"),
            F.sum("n").alias("n"),
            F.collect_list("uid").alias("uids"),
        )
    )
    by_salt = materialise(by_salt, "exact-salted")
    winners = by_salt.groupBy("digest", "text").agg(
        F.max("best").alias("best"), F.sum("n").alias("n"), F.collect_list("best.uid").alias("part_uids")
    )
    parts = by_salt.select(F.explode("uids").alias("uid"), F.col("best.uid").alias("part_uid"))
    kept = winners.select(F.explode("part_uids").alias("part_uid"), "best", F.col("n").alias("total"))
    merged = parts.join(kept, "part_uid").select("uid", F.col("best.uid").alias("keep_uid"), F.col("best.rep_id").alias("keep_id"), "total")
    own = F.col("keep_uid").isNull()
    return (
        local.select("uid", "rep_id", "digest", "n", "best", "members", "rows")
        .join(merged, "uid", "left")
        .select(
            F.posexplode("members").alias("at", "doc_id"),
            F.when(own, F.col("rep_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("total", "n").alias("group_size"),
            (own | (F.col("keep_uid") == F.col("uid"))).alias("winner"),
            "best",
            "digest",
            "rows",
        )
        .select("doc_id", "keep_id", "group_size", (F.col("winner") & (F.col("at") == F.col("best"))).alias("kept"), "digest", *([F.col("rows")[F.col("at")].alias(key)] if key else []))
    )
