"""Best-fit packing of token sequences after Martello and Toth's dominance reduction.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths, at
most `capacity` rows, reaches the driver. There, sets of pieces that provably dominate every
alternative are fixed; best fit decreasing packs what is left, a whole class of equal bins at a
time. The plan comes back as (length, rank) ranges, and each piece finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import tokens
from docketry.llm.common import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
Pattern = tuple[tuple[int, int], ...]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder, end = tokens.load(vocabulary), end_id.to_bytes(4, "little")
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = encoder.encode(text) + end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for k in range(len(cuts) - 1):
                a, b = cuts[k], cuts[k + 1]
                for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix bins that some optimal packing has; returns them with their numbers, and what is left.

    For the longest piece j with room r = capacity - j, a fixed set {j} or {j, i} dominates when
    every feasible set with j could give up its other pieces in exchange for i without loss:
    nothing fits with j; i fills r exactly; no two pieces fit beside j; or no three do and the
    best two together are no longer than i, the longest that fits.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[Pattern, int]] = []

    def take(pattern: Pattern, times: int) -> None:
        fixed.append((pattern, times))
        for length, k in pattern:
            left[length] -= k * times
            if not left[length]:
                del left[length]

    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            others = left | {j: left[j] - 1}
            sizes = sorted(k for k, v in others.items() if v and k <= room)
            if not sizes:
                take(((j, 1),), left[j])
                continue
            partner = sizes[-1]
            smallest: list[int] = []
            for k in sizes:
                smallest += [k] * min(3 - len(smallest), others[k])
                if len(smallest) == 3:
                    break
            dominates = partner == room or len(smallest) < 2 or sum(smallest[:2]) > room
            if not dominates and (len(smallest) < 3 or sum(smallest) > room):
                best_two = 0
                for k in sizes:
                    at = bisect.bisect_right(sizes, room - k) - 1
                    if at >= 0 and sizes[at] == k and others[k] < 2:
                        at -= 1
                    if at >= 0:
                        best_two = max(best_two, k + sizes[at])
                dominates = best_two <= partner
            if not dominates:
                break
            if partner == j:
                take(((j, 2),), left[j] // 2)
            else:
                take(((j, 1), (partner, 1)), min(left[j], left[partner]))
    return fixed, left


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit on length classes: equal bins are filled together, so the work follows their kinds."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    order = [capacity]

    def put(pattern: Pattern, room: int, times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(order, length)
            while at < len(order) and order[at] < capacity and not rooms[order[at]]:
                at += 1
            room = order[at] if at < len(order) else capacity
            pattern, bins = rooms[room].pop() if room < capacity else ((), n)
            each = room // length
            full = min(bins, n // each)
            if full:
                put((*pattern, (length, each)), room - each * length, full)
                n -= full * each
                bins -= full
            elif bins:  # fewer pieces than one such bin takes
                put((*pattern, (length, n)), room - n * length, 1)
                n, bins = 0, bins - 1
            if bins and pattern:
                put(pattern, room, bins)
    return [x for found in rooms.values() for x in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """All bins, as patterns of (length, how many) with the number of equal bins."""
    fixed, left = dominance_reduction(counts, capacity)
    return fixed + best_fit_decreasing(left, capacity)


def _segments(bins: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length, the columns first rank, first sequence, offset: ordered by rank."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in bins:
        offset = 0
        for length, k in pattern:
            for _ in range(k):
                out.setdefault(length, []).append((used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(batches: Iterator[pa.RecordBatch], segments: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            rows = np.flatnonzero(length == k)
            table = segments[int(k)]
            at = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
            sequence[rows] = table[at, 1] + rank[rows] - table[at, 0]
            offset[rows] = table[at, 2]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = 1024, bucket_rows: int = 256
) -> DataFrame:
    """One row for each piece of docs(doc_id, text): where it lies in which sequence.

    Null is the empty text; every document ends with `end_id`. A document of more than
    `capacity` tokens is cut, and its first piece takes the remainder. Rows that repeat a doc_id
    are packed like others, each by itself. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    work = partial(_pieces, vocabulary=vocabulary or tokens.default_vocabulary(), end_id=end_id, capacity=capacity)
    pieces = materialise(texts.mapInArrow(work, PIECES), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments = _segments(plan(counts, capacity))
    # A rank without one task for a whole length: buckets of a length are counted, then ranked inside.
    # A length of n pieces has about n / bucket_rows buckets, and from bucket_rows squared on the root of n.
    split = {k: 1 + n // max(bucket_rows, math.isqrt(n)) for k, n in counts.items() if n >= bucket_rows}
    buckets = F.create_map(*(F.lit(v) for kv in split.items() for v in kv))[F.col("length")] if split else F.lit(1)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(buckets, F.lit(1))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        partial(_place, segments=segments), PLACED
    )
