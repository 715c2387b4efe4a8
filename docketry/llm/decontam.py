"""Benchmark decontamination by winnowing.

Every window of six consecutive 5-word hashes keeps its smallest one, on both sides. Ten shared
words hold six shared 5-word hashes, so two texts that share ten words share a kept hash. Kept
hashes of a document that the benchmark also keeps are hits; each is extended to the windows of
ten words around it, and these are joined with the benchmark's, by fingerprint and by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import materialise, slices_by_bytes, text_bytes
from docketry.llm.phrases import bit_map, is_set

#: Words of a window, words of a hash, hashes of a winnowing window: WINDOW = GRAM + KEEP - 1.
WINDOW, GRAM, KEEP = 10, 5, 6
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _powers(root: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, root, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts in a row: hashes, places in the bytes, and each text's share."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        inside = _IN_WORD[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        terms = (self.data.astype(np.uint64) + np.uint64(1)) * _powers(_ROOT, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        shift = _powers(_INVERSE, len(data))
        self.hash = _mix((sums[self.stop] - sums[self.start]) * shift[self.start]) if len(self.start) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)  # of each text's words; its end is the next one's first
        self.text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words from each word on, and whether they lie in one text."""
        m = max(0, len(self.hash) - n + 1)
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * _ROOT + self.hash[j : j + m]
        return _mix(out), self.text_of[:m] == self.text_of[n - 1 : n - 1 + m]

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes that some winnowing window keeps; of equal ones the last."""
        gram, _ = self.grams(GRAM)
        m = max(0, len(self.hash) - WINDOW + 1)
        rest = self.text_of[:m] == self.text_of[WINDOW - 1 : WINDOW - 1 + m]
        least = reduce(np.minimum, (gram[j : j + m] for j in range(KEEP)))
        kept = np.zeros(len(gram), bool)
        for j in reversed(range(KEEP)):
            here = rest & (gram[j : j + m] == least)
            kept[j : j + m] |= here
            rest = rest & ~here
        at = np.flatnonzero(kept)
        return at, gram[at]

    def text(self, i: int, n: int) -> bytes:
        """The n words from one on, with one blank between."""
        return b" ".join(self.data[x:y].tobytes() for x, y in zip(self.start[i : i + n].tolist(), self.stop[i : i + n].tolist(), strict=True))


WINDOWS = "item string, n int, fp long, words string"
_WINDOWS = pa.schema([("item", pa.string()), ("n", pa.int32()), ("fp", pa.int64()), ("words", pa.string())])


def _benchmark_windows(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Each distinct window of an item; rows of n = 0 hold the 5-word hashes that winnowing keeps."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("item").to_pylist()
        for lo, hi in slices_by_bytes(offsets, chunk_bytes):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            kept = np.unique(words.winnowed()[1])
            rows: dict[tuple[str, int, bytes], int] = {}
            sizes = np.minimum(np.diff(words.first), WINDOW)
            for n in np.unique(sizes[sizes > 0]).tolist():
                gram, whole = words.grams(n)
                for i in np.flatnonzero(whole & (sizes[words.text_of[: len(gram)]] == n)).tolist():
                    rows[ids[lo + int(words.text_of[i])], n, words.text(i, n)] = int(gram.view(np.int64)[i])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(kept), pa.string()), pa.array(np.zeros(len(kept), np.int32)), pa.array(kept.view(np.int64)), pa.nulls(len(kept), pa.string())], schema=_WINDOWS)
            items, n, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(n, pa.int32()), pa.array(rows.values(), pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], schema=_WINDOWS)


FOUND = "doc_id long, uid long, n_words long, n int, fp long, words string, uids array<long>, starts array<int>"
_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("uid", pa.int64()), ("n_words", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("words", pa.string()),
    ("uids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())),
])


def _candidates(batches: Iterator[pa.RecordBatch], seeds: Broadcast, windows: Broadcast, short: list[int], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with its words' number; and for each distinct window of a block that may be the benchmark's, where it stands.

    A kept hash that the benchmark may keep too is extended to the six windows that can hold it.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids, uids = batch.column("doc_id"), batch.column("uid")
        for lo, hi in slices_by_bytes(offsets, chunk_bytes):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            k = hi - lo
            none = lambda size, kind: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, k), uids.slice(lo, k), pa.array(np.diff(words.first), pa.int64()), *(none(k, f.type) for f in list(_FOUND)[3:])], schema=_FOUND)
            at, kept = words.winnowed()
            at = at[is_set(seeds.value, kept)]
            spots = {WINDOW: np.unique(np.concatenate([at - j for j in range(KEEP)])) if len(at) else at}
            places: dict[tuple[int, int, bytes], tuple[list[int], list[int]]] = {}
            own = uids.slice(lo, k).to_pylist()
            for n in (WINDOW, *short):
                gram, whole = words.grams(n)
                found = spots.get(n, np.arange(len(gram)))
                found = found[(found >= 0) & (found < len(gram))]
                found = found[whole[found]]
                found = found[is_set(windows.value, gram[found])]
                for i in found.tolist():
                    text = int(words.text_of[i])
                    row, start = places.setdefault((n, int(gram.view(np.int64)[i]), words.text(i, n)), ([], []))
                    row.append(own[text])
                    start.append(i - int(words.first[text]))
            if places:
                n, fp, text = zip(*places, strict=True)
                m = len(places)
                where = [pa.array(x, t.type) for x, t in zip(zip(*places.values(), strict=True), list(_FOUND)[-2:], strict=True)]
                yield pa.RecordBatch.from_arrays([none(m, pa.int64())] * 3 + [pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), *where], schema=_FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 2_000_000, chunk_bytes: int = 2_000_000, key: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of docs(doc_id, text).

    Words are runs of 0-9, a-z and characters beyond ASCII after lower-casing A-Z. A word is hit
    inside any occurrence of ten consecutive words of one benchmark(item_id, text) item, or of a
    whole item of fewer words. Null texts have no words; a null item_id is written as the empty
    text; repeated rows and ids stand by themselves. spans are the hit runs of words.
    `key` names a column of longs, unique by row, which is then returned too.

    Both sides are winnowed. A bit map of the benchmark's kept hashes and one of its windows, 128 MB
    each at most, tell which of a document's windows can matter; these are joined with the
    benchmark's by fingerprint and words. A block of `chunk_bytes` of documents sends a window once,
    with all its places, so a passage that many documents share, or a word that a text repeats,
    is a row a block. Benchmarks of any size take one pass over docs.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    windows = materialise(items.mapInArrow(partial(_benchmark_windows, chunk_bytes=block_bytes), WINDOWS), "benchmark-windows")
    seeds = spark.sparkContext.broadcast(bit_map(windows.filter("n = 0").select("fp").distinct()))
    known = spark.sparkContext.broadcast(bit_map(windows.filter("n > 0").select("fp").distinct()))
    short = sorted(r["n"] for r in windows.filter(F.col("n").between(1, WINDOW - 1)).select("n").distinct().collect())
    uid = F.col(key) if key else F.monotonically_increasing_id()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), uid.alias("uid"))
    found = materialise(texts.mapInArrow(partial(_candidates, seeds=seeds, windows=known, short=short, chunk_bytes=chunk_bytes), FOUND), "document-windows")
    for sent in (seeds, known):
        sent.unpersist()
    of_items = windows.filter("n > 0").select("n", "fp", "words", "item").distinct()
    met = found.filter("n is not null").select("n", "fp", "words", "uids", "starts").join(of_items.select("n", "fp", "words").distinct(), ["n", "fp", "words"])
    met = materialise(met.select("n", "fp", "words", F.explode(F.arrays_zip("uids", "starts")).alias("at")).select("n", "fp", "words", F.col("at.uids").alias("uid"), F.col("at.starts").alias("start")), "document-hits")
    # A window that a document repeats, and one that many items hold, meet once each.
    named = met.select("uid", "n", "fp", "words").distinct().join(of_items, ["n", "fp", "words"]).groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    order = Window.partitionBy("uid").orderBy("start", "n")
    reached = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = met.select("uid", "start", "n").withColumn("fresh", F.when(F.col("start") <= reached, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("uid", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).cast("int").alias("stop"))
    spans = runs.groupBy("uid").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    rows = found.filter("n is null").select("doc_id", "uid", "n_words").join(spans, "uid", "left").join(named, "uid", "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"), *([F.col("uid").alias(key)] if key else []),
    )


def items_digest(items: list[str]) -> str:
    """What the digest column holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
