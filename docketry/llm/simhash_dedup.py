"""SimHash near-duplicates: positional byte index, count filter, verification, components.

A fingerprint has eight positional bytes. Two that differ in at most four bits share at least
four of them, so every such pair meets in the posting list of some three positional bytes.
There the shared positional bytes of a pair are tallied, pairs below the guaranteed four are
let go, and the rest are verified by their differing bits. Equal fingerprints enter once.

A posting list too long for one task is not compared pair by pair. Two fingerprints within four
bits have a word midway, within two bits of both, and all fingerprints within two bits of a
word are linked: each emits the words near it (2081), and those that meet at a word (2081 at
most) are linked there. This is as exact, and grows with the list, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import join_skewed, materialise, text_bytes
from docketry.llm.components import connected_components

SEED = 42
#: Bytes that a posting key holds. Four are guaranteed to agree; three keep the index half as large.
KEY_BYTES = 3
COMBOS = list(combinations(range(8), KEY_BYTES))
#: Fingerprints of a posting list that one task compares; longer lists are linked through the words midway.
LONG_LIST = 20_000
#: Nodes after which a task forgets its forest; it may then repeat links, never lose one.
FOREST_NODES = 1_000_000


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority of the shingles' XXH64 bits; zero without words; the whole sequence if shorter."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, total, ones = xxhash.xxh64_digest, len(starts), np.zeros(64, np.int64)
    for a in range(0, total, 100_000):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + 100_000], ends[a : a + 100_000], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        found = [
            fingerprint(data[a:b].tobytes().lower().split(), shingle)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(np.array(found, np.uint64).view(np.int64))], names=[*keep, "fp"]
        )


def fingerprints(docs: DataFrame, shingle: int = 4, key: str | None = None) -> DataFrame:
    """(doc_id, fp), with a `key` of longs as row if given: the 64-bit fingerprint of every whole text of docs, as a signed long."""
    keep = ["doc_id", "row"] if key else ["doc_id"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.col(key).alias("row")] if key else []))
    return texts.mapInArrow(partial(_fingerprints, shingle=shingle, keep=keep), ", ".join(f"{c} long" for c in [*keep, "fp"]))


def _first_combos() -> np.ndarray:
    """For each set of agreeing bytes (a bit mask), the first key combination inside it, or -1."""
    inside = [[sum(1 << p for p in c) & ~m == 0 for c in COMBOS] for m in range(256)]
    return np.array([x.index(True) if True in x else -1 for x in inside], np.int16)


FIRST_COMBO = _first_combos()


def verified(a: np.ndarray, b: np.ndarray, combo: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs, met under a key combination, are links seen first under that combination."""
    differ = a ^ b
    mask = np.zeros(len(a), np.int64)
    for p in range(8):
        mask |= ((differ >> np.uint64(8 * p)) & np.uint64(255) == 0).astype(np.int64) << p
    tally = np.bitwise_count(mask.astype(np.uint8))
    return (tally >= 8 - bits) & (FIRST_COMBO[mask] == combo) & (np.bitwise_count(differ) <= bits)


class Forest:
    """Keeps of a stream of links only those that join two parts; one that it has forgotten may pass again."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        if len(self.up) > FOREST_NODES:
            self.up = {}
        ra, rb = self.find(a), self.find(b)
        if ra == rb:
            return False
        self.up[max(ra, rb)] = min(ra, rb)
        return True


def _near_pairs(keys: np.ndarray, fps: np.ndarray, bits: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside runs of equal keys; keys are sorted. Runs of any length, `block` pairs at a time."""
    n, step = len(keys), 1
    ends = np.searchsorted(keys, keys, side="right")
    live = np.arange(n)
    while len(live := live[live + step < ends[live]]):
        for i in range(0, len(live), block):
            left = live[i : i + block]
            a, b = fps[left], fps[left + step]
            ok = verified(a, b, (keys[left] >> 24).astype(np.int64), bits)
            yield a[ok], b[ok]
        step += 1


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _spanning(forest: Forest, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The links (u, v) that join two parts of the forest."""
    kept = [(x, y) for x, y in zip(u.tolist(), v.tolist(), strict=True) if forest.join(x, y)]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], schema=LINKS)


def _passed_on(fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], schema=LINKS)


def _lists(batches: Iterator[pa.RecordBatch], long_list: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Whole posting lists (keys, fps, False) of rows sorted by key; longer ones in pieces (keys, fps, True)."""
    held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    passed = None  # the key of a long list that may go on
    for batch in batches:
        keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
        fps = np.concatenate([held_fps, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        starts, ends = np.searchsorted(keys, keys), np.searchsorted(keys, keys, side="right")
        far = (ends - starts > long_list) | (keys == (-1 if passed is None else passed))
        whole = ~far & (keys != keys[-1])
        yield keys[far], fps[far], True
        yield keys[whole], fps[whole], False
        passed = int(keys[-1]) if far[-1] else None
        rest = ~far & ~whole  # the last list may go on in the next batch
        held_keys, held_fps = keys[rest], fps[rest]
    yield held_keys, held_fps, False


def _links(batches: Iterator[pa.RecordBatch], bits: int, long_list: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the posting lists in a partition that is sorted by key.

    Fingerprints of a list of more than `long_list` are passed on instead, without a v.
    """
    forest = Forest()
    for keys, fps, far in _lists(batches, long_list):
        if far:
            yield _passed_on(fps)
        else:
            for a, b in _near_pairs(keys, fps, bits, 1 << 18):
                yield _spanning(forest, a.view(np.int64), b.view(np.int64))


def _words_near(batches: Iterator[pa.RecordBatch], radius: int, inner: int, block: int = 200) -> Iterator[pa.RecordBatch]:
    """Each word within `radius` flips of a fingerprint; it is far where not within `inner`."""
    flips = [c for n in range(radius + 1) for c in combinations(range(64), n)]
    masks = np.array([sum(1 << b for b in c) for c in flips], np.uint64)
    far = np.array([len(c) > inner for c in flips])
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), block):
            own = fps[at : at + block]
            yield pa.RecordBatch.from_arrays(
                [pa.array((own[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.tile(far, len(own))), pa.array(np.repeat(own, len(masks)).view(np.int64))],
                names=["word", "far", "fp"],
            )


def _word_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each word's first fingerprint, if it is not far, with the word's others; rows are sorted."""
    forest, first = Forest(), None
    for batch in batches:
        word, far, fp = batch.column("word").to_numpy(), batch.column("far").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy()
        if first is not None:  # the first of a word that may go on here
            word, far, fp = (np.concatenate([[x], column]) for x, column in zip(first, (word, far, fp), strict=True))
        if not len(word):
            continue
        new = np.concatenate([[True], word[1:] != word[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
        met = ~new & ~far[head]
        yield _spanning(forest, fp[met], fp[head][met])
        first = word[head[-1]], far[head[-1]], fp[head[-1]]


def long_list_links(lists: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) that join all of lists(fp), without repeats, that lies within `bits` bits.

    A pair within `bits` has a word within bits // 2 flips of the one and the other flips of the
    other. At each word one of those nearest is linked with the rest, all truly within `bits`.
    """
    words = lists.mapInArrow(partial(_words_near, radius=bits - bits // 2, inner=bits // 2), "word long, far boolean, fp long")
    return words.repartition("word").sortWithinPartitions("word", "far", "fp").mapInArrow(_word_links, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4, long_list: int = LONG_LIST, key: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id that chains of links reach; links join fingerprints
    that differ in at most `bits` (up to four) bits. Null is the empty text, which has
    fingerprint zero and is linked like any other. Null ids take part and are never the
    component_id unless all ids of the component are null. Other columns are ignored.

    `key` names a column of longs, unique by row. It is returned too, with kept: true for one
    row of each component, of those with its component_id the one with the smallest key.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees links of at most four differing bits")
    rows = materialise(fingerprints(docs, shingle, key), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row") if key else F.col("doc_id")
    distinct = materialise(rows.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("n")), "simhash-distinct")

    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    def posting(i: int):
        packed = F.lit(i)
        for p in COMBOS[i]:
            packed = F.shiftleft(packed.cast("long"), 8).bitwiseOR(byte(p))
        return packed

    postings = distinct.select("fp", F.explode(F.array(*(posting(i) for i in range(len(COMBOS))))).alias("key"))
    listed = postings.repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(listed.mapInArrow(partial(_links, bits=bits, long_list=long_list), "u long, v long"), "simhash-links")
    links, lists = found.filter("v is not null"), found.filter("v is null").select(F.col("u").alias("fp")).distinct()
    if not lists.isEmpty():
        links = links.union(materialise(long_list_links(lists, bits), "simhash-long-lists"))
    roots = connected_components(links)
    of_fp = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    of_fp = materialise(of_fp, "simhash-roots")
    component = materialise(of_fp.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "simhash-components")
    # A component may hold most fingerprints, and a fingerprint most rows.
    of_fp = materialise(join_skewed(of_fp, component, "root", "fps").select("fp", "component_id", "n"), "simhash-found")
    found = join_skewed(rows, of_fp, "fp", "n")
    if not key:
        return found.select("doc_id", "fp", "component_id")
    first = F.col("component_id")
    return found.select("doc_id", "fp", first["doc_id"].alias("component_id"), F.col("row").alias(key), (F.col("row") == first["row"]).alias("kept"))
