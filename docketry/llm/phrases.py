"""Phrases whose words stand together more often than chance has it.

Rabin-Karp fingerprints: prefix polynomials in numpy give the fingerprint of every n-gram of a
block of texts at once. Blocks send each fingerprint once, with its count, to be added up. Before an
n-gram is sent, both (n-1)-grams inside it must have been frequent, which every frequent one's are:
what is frequent is told by a bit map of bounded size, so bits set by other fingerprints cost a row
and change nothing. For the frequent ones blocks then keep a pointer to an occurrence, hold all other
occurrences against its words, and follow it where the text is, before the shuffle, which adds the
counts up by the words themselves: fingerprints that collide are told apart, and nothing but
frequent phrases is ever written out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import materialise, slices_by_bytes, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "und"

#: Bases of the polynomials over the bytes of a word and over the words of an n-gram, modulo 2^64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A word of more bytes is hashed by itself.
LONG_WORD = 1 << 16
#: A bit map has 32 to 64 bits for each fingerprint, so that one in 250 others passes; never more than 2^30 bits
#: (128 MB), beyond which more of them pass and results stay the same.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 30
CHUNK = 1 << 16

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64, kept for the worker's next block."""
    if len(_POWERS.get(base, ())) <= n:
        steps = np.full(n + n // 4 + 1, base % (1 << 64), np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(values: np.ndarray, base: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The polynomial of values[start:stop] for each pair, from prefix sums: equal windows have equal ones wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[: len(values)], out=sums[1:])
    return (sums[stops] - sums[starts]) * _powers(pow(base, -1, 1 << 64), len(values))[starts]


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash for each distinct word."""
    data, offsets = text_bytes(words)
    sizes = np.diff(offsets)
    out = np.zeros(len(words), np.uint64)
    for a, b in slices_by_bytes(offsets, 1 << 20):
        if b - a > 1 or sizes[a] <= LONG_WORD:
            own = data[offsets[a] : offsets[b]].astype(np.uint64) + np.uint64(1)
            at = offsets[a : b + 1] - offsets[a]
            out[a:b] = _windows(own, BYTE_BASE, at[:-1], at[1:])
    for a in np.flatnonzero(sizes > LONG_WORD):
        out[a] = int.from_bytes(hashlib.blake2b(data[offsets[a] : offsets[a + 1]].tobytes(), digest_size=8).digest(), "little")
    return _mixed(out + sizes.astype(np.uint64))


class Block:
    """The words of some texts: where they stand, exact numbers for them, and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, own_bytes: int | None = None):
        """own_bytes: words that begin at or after it belong to the next block, and only end n-grams of this one."""
        lowered = LOWERED[data]
        kind = KIND[lowered]
        word = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | first[1:-1]
        end[:-1] &= ~word[1:] | first[1:-1]
        self.starts, self.stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.offsets = offsets
        # Two words are in one piece if no break and no text's beginning lies between them.
        self.pieces = np.searchsorted(np.flatnonzero(kind == 2), self.starts) + self.rows
        self.own = len(self.starts) if own_bytes is None else int(np.searchsorted(self.starts, own_bytes))
        ends = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(self.stops - self.starts, out=ends[1:])
        words = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(lowered[word])])
        coded = words.dictionary_encode()
        self.lowered = lowered
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.hashes = _word_hashes(coded.dictionary)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)

    def fingerprints(self, n: int, salt: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the fingerprint of the n words from it on, salted by its text's, and whether they are in one piece."""
        m = max(len(self.starts) - n + 1, 0)
        at = np.arange(m)
        found = _mixed(_windows(self.hashes, WORD_BASE, at, at + n) + np.uint64(n) + salt[self.rows[:m]]) & np.uint64(mask)
        return found, self.pieces[n - 1 :][:m] == self.pieces[:m]


    def words(self, at: np.ndarray, n: int) -> list[bytes]:
        """The n words from each of the given ones on, with one blank between."""
        data = self.lowered.tobytes()
        found = [data[a:b] for a, b in zip(self.starts[at].tolist(), self.stops[at + n - 1].tolist(), strict=True)]
        return [b" ".join(x.split()) for x in found] if n > 1 else found


def blocks(batch: pa.RecordBatch, block_bytes: int, longest: int) -> Iterator[tuple[Block, int, int, int]]:
    """(block, first row, rows, bytes of the row that lie before it); a text over `block_bytes` is cut between words.

    A cut text's block goes on for the `longest` - 1 words that n-grams beginning in it may need.
    """
    data, offsets = text_bytes(batch.column("text"))
    for a, b in slices_by_bytes(offsets, block_bytes):
        own = data[offsets[a] : offsets[b]]
        if b - a > 1 or len(own) <= block_bytes:
            yield Block(own, offsets[a : b + 1] - offsets[a]), a, b - a, 0
            continue
        at = 0
        while at < len(own):
            cut = end = _between_words(own, at + block_bytes)
            for _ in range(longest - 1):
                end = _between_words(own, _word_after(own, end))
            yield Block(own[at:end], np.array([0, end - at]), cut - at), a, 1, at
            at = cut


def _first(data: np.ndarray, at: int, word: bool) -> int:
    """The first place from `at` on that is, or is not, part of a word."""
    step = 1 << 12
    while at < len(data):
        found = np.flatnonzero((KIND[data[at : at + step]] == 0) == word)
        if len(found):
            return at + int(found[0])
        at += step
    return len(data)


def _between_words(data: np.ndarray, at: int) -> int:
    return _first(data, min(at, len(data)), False)


def _word_after(data: np.ndarray, at: int) -> int:
    return _first(data, at, True)


def is_set(known: tuple[int, np.ndarray], found: np.ndarray) -> np.ndarray:
    """Whether both bits of each fingerprint are set: those of its first and of its last `width` bits."""
    width, bits = known
    out = np.ones(len(found), bool)
    for at in (found >> np.uint64(64 - width), found & np.uint64((1 << width) - 1)):
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _salts(batch: pa.RecordBatch, a: int, n: int) -> np.ndarray:
    return batch.column("lang_hash").slice(a, n).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


COUNTS = pa.schema([("word", pa.bool_()), ("fp", pa.int64()), ("count", pa.int64())])


def _counted(word: bool, fingerprints: np.ndarray) -> pa.RecordBatch:
    values, counts = np.unique(fingerprints, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), word)), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], schema=COUNTS)


def _count(batches: Iterator[pa.RecordBatch], n: int, known: Broadcast | None, mask: int, block_bytes: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Each block's fingerprints of n words with their counts, of those alone whose first and last n - 1 words may be frequent.

    At n = 3 also those of the words that stand in a frequent pair, marked as words.
    """
    for batch in batches:
        for block, a, rows, _ in blocks(batch, block_bytes, longest):
            salt = _salts(batch, a, rows)
            found, ok = block.fingerprints(n, salt, mask)
            if known:
                shorter, together = block.fingerprints(n - 1, salt, mask)
                shorter = is_set(known.value, shorter) & together
                ok &= shorter[: len(found)] & shorter[1 : len(found) + 1]
                if n == 3:
                    at = np.flatnonzero(shorter)
                    yield _counted(True, block.fingerprints(1, salt, mask)[0][np.union1d(at, at + 1)])
            ok[block.own :] = False
            yield _counted(False, found[ok])


ARROW = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("count", pa.int64())])


def exact_groups(found: np.ndarray, same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence, count) of each distinct value of all columns in `same`, by way of their fingerprints.

    Every occurrence is held against the first one of its fingerprint; those that differ are told
    apart by their values.
    """
    _, first, inverse, counts = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
    equal = np.ones(len(found), bool)
    for column in same:
        equal &= column == column[first[inverse]]
    if equal.all():
        return first, counts
    others: dict[tuple, list[int]] = defaultdict(list)
    for i in np.flatnonzero(~equal):
        others[tuple(c[i] for c in same)].append(i)
    counts = counts - np.bincount(inverse[~equal], minlength=len(first))
    return np.concatenate([first, [v[0] for v in others.values()]]), np.concatenate([counts, [len(v) for v in others.values()]])


#: So many phrases a task adds up before it hands them on.
HELD = 400_000


def _follow(batches: Iterator[pa.RecordBatch], known: list[Broadcast], mask: int, block_bytes: int, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """n-grams that may be frequent, as words: each block follows the pointer of each and adds its exact count to the task's.

    A row of n = 0 for each language holds its number of words.
    """
    sums: dict[tuple[str, int], dict[bytes, int]] = defaultdict(dict)

    def drained() -> Iterator[pa.RecordBatch]:
        for (lang, n), own in sums.items():
            words = pa.array(own.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(own), pa.string()), pa.array(np.full(len(own), n, np.int32)), words, pa.array(own.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)
        sums.clear()

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for block, a, rows, _ in blocks(batch, block_bytes, len(known)):
            salt, code = _salts(batch, a, rows), codes[a : a + rows]
            for c, total in enumerate(np.bincount(code[block.rows[: block.own]]).tolist()):
                if total:
                    sums[names[c], 0][b""] = sums[names[c], 0].get(b"", 0) + total
            for n, frequent in enumerate(known, 1):
                found, ok = block.fingerprints(n, salt, mask)
                ok &= is_set(frequent.value, found)
                ok[block.own :] = False
                at = np.flatnonzero(ok)
                first, counts = exact_groups(found[at], [block.ids[at + i] for i in range(n)] + [code[block.rows[at]]])
                at = at[first]
                mine = {c: sums[names[c], n] for c in np.unique(code).tolist()}
                for c, words, count in zip(code[block.rows[at]].tolist(), block.words(at, n), counts.tolist(), strict=True):
                    own = mine[c]
                    own[words] = own.get(words, 0) + count
            if sum(map(len, sums.values())) > held:
                yield from drained()
    yield from drained()


def _pack(rows: pa.Table) -> pa.Table:
    """The bits of one chunk of a bit map."""
    at = rows.column("at").to_numpy()
    bits = np.zeros(CHUNK, np.uint8)
    bits[at & (CHUNK - 1)] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"chunk": pa.array([int(at[0]) >> 16], pa.int64()), "bits": pa.array([packed], pa.binary())})


def bit_map(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """(width, bits): two bits set for each of fingerprints(fp); its size follows their number, up to 128 MB."""
    wanted = BITS_EACH * max(fingerprints.count(), 1)
    width = min(max(wanted.bit_length(), LEAST_BITS), MOST_BITS)
    both = F.array(F.shiftrightunsigned("fp", 64 - width), F.col("fp").bitwiseAND(F.lit((1 << width) - 1)))
    at = fingerprints.select(F.explode(both).alias("at")).distinct()
    chunks = at.groupBy(F.shiftright("at", 16).alias("chunk")).applyInArrow(_pack, "chunk long, bits binary").collect()
    bits = np.zeros(1 << (width - 3), np.uint8)
    for chunk in chunks:
        bits[chunk["chunk"] * CHUNK // 8 :][: CHUNK // 8] = np.frombuffer(chunk["bits"], np.uint8)
    return width, bits


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, mask: int = (1 << 64) - 1, block_bytes: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Phrases of two to `longest` words that occur `least` times or more in a language, the words that they hold, and how many words it has.

    docs(lang, text); a null lang is `und`, a null text is empty. Texts are lower-cased (A-Z), cut
    into pieces at `.,;:!?` and U+000A to U+000D, and pieces at blanks and tabs; a phrase lies
    within a piece. Returns phrases(lang, n, phrase, a), of n from 1, and totals(lang, n_words).
    Other columns are ignored; without any word both are empty. `longest` is 3 at least. `mask` cuts fingerprints short, for tests.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("lang_hash", F.xxhash64("lang"))
    known: list[Broadcast] = []
    for n in range(1, longest + 1):
        work = partial(_count, n=n, known=known[-1] if known else None, mask=mask, block_bytes=block_bytes, longest=longest)
        counts = texts.select("lang_hash", "text").mapInArrow(work, "word boolean, fp long, count long")
        counts = counts.groupBy("word", "fp").agg(F.sum("count").alias("count")).filter(F.col("word") | (F.col("count") >= least)).select("word", "fp")
        counts = materialise(counts, f"phrase-frequent-{n}")
        known.append(spark.sparkContext.broadcast(bit_map(counts.filter("not word"))))
        if n == 3:
            known[0] = spark.sparkContext.broadcast(bit_map(counts.filter("word")))
    found = texts.mapInArrow(partial(_follow, known=known, mask=mask, block_bytes=block_bytes), "lang string, n int, phrase string, count long")
    found = materialise(found.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("a")).filter((F.col("a") >= least) | (F.col("n") == 0)), "phrases")
    for bits in known:
        bits.unpersist()
    return found.filter("n > 0"), found.filter("n = 0").select("lang", F.col("a").alias("n_words"))


def _without_contained(phrases: DataFrame) -> DataFrame:
    """Candidates that no longer candidate holds as often as they occur.

    Phrases between the two occur as often as both, so it is enough to look one word further.
    """
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.array_join(F.slice(words, 2, F.size(words) - 1), " "))
    longer = phrases.filter("n > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    kept = phrases.filter("n > 1").join(longer, ["lang", "phrase"], "left")
    return kept.filter("longer_a is null or 100 * longer_a < 100 * a").drop("longer_a")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates: the cut that speaks least for them; of equals, the first.

    score is floor(1000 a n / (l r)), computed on decimals of 38 digits.
    """
    words = F.split("phrase", " ")
    cuts = _without_contained(phrases).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side]).drop(side)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang").withColumn("top", (F.lit(1000).cast("decimal(19,0)") * big("a")).cast("decimal(19,0)") * big("n_words")).withColumn("low", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("top div low"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "a", "n_words").agg(least)
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("n_words").alias("n"), "cut.score")


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, mask: int = (1 << 64) - 1, block_bytes: int = 4_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, count and bytes.

    Phrases of 2 to `longest` words with a >= `least` occurrences; see `frequent_phrases` and
    `scored`. A language's phrases are counted by bands of score first; only those of the bands
    that can reach `top` are ranked, by one task a language.
    """
    phrases, totals = frequent_phrases(docs, least, longest, mask, block_bytes)
    rows = materialise(scored(phrases, totals), "phrase-scores")
    band = F.coalesce(F.floor(F.log2(F.nullif("score", F.lit(0))) * 64), F.lit(-1)).cast("long")
    rows = rows.withColumn("band", band)
    better = Window.partitionBy("lang").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("lang", "band").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(better), F.lit(0)))
    reach = bands.filter(F.col("before") < top).groupBy("lang").agg(F.min("band").alias("last"))
    rows = rows.join(reach, "lang").filter(F.col("band") >= F.col("last"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long")
    return rows.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
