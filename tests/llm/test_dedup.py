"""Exact and SimHash deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from docketry.llm.components import connected_components
from docketry.llm.exact_dedup import exact_duplicates
from docketry.llm.queries import op4_exact_dedup, op5_simhash_dedup
from docketry.llm.simhash_dedup import _lists, fingerprint, long_list_links, near_duplicates

SF = "/root/testdata/sf0.001"


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[ascii_lower(text)].append(doc_id)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen))
            seen |= i == keep
    return sorted(out, key=str)


def exact(df, **options):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(df, **options).collect()), key=str)


ROWS = [(1, "Abc é É"), (2, "abC é É"), (3, "abc é é"), (4, None), (5, ""), (6, "long " * 50_000), (7, "LONG " * 50_000), (7, "LONG " * 50_000), (None, "abc é É"), (None, "alone"), *((100 + i, f"same {i % 3}") for i in range(60))]


def test_exact_odd_rows_and_weak_digests(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("uid", F.lit("x")).repartition(5)
    for options in ({}, {"digest": lambda t: hashlib.sha256(t).digest()[:1]}, {"digest": lambda t: b""}, {"members": 3, "block_chars": 100, "salts": 2}):
        assert exact(df, **options) == expected_exact(ROWS), options


def test_exact_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = op4_exact_dedup(spark, SF).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found), key=str) == expected_exact(rows)
    texts = dict(rows)
    assert all(r["text_sha256"] == hashlib.sha256(ascii_lower(texts[r["doc_id"]]).encode()).hexdigest() for r in found)


def plain_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict) -> dict:
    ids = list(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {k: plain_fingerprint(v) for k, v in texts.items()}
    root = components(fps)
    found = op5_simhash_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {k: (f"{fps[k]:016x}", root[k]) for k in texts}


def test_simhash_matches_spark_hash(spark):
    words = ["Été", "b", "c", "d", "e"]
    hashes = spark.createDataFrame([(" ".join(words[i : i + 4]),) for i in range(2)], "s string").select(F.xxhash64("s")).collect()
    want = 0
    for b in range(64):
        want |= (sum((h[0] >> b) & 1 for h in hashes) * 2 > 2) << b
    assert fingerprint([w.encode() for w in words], 4) == want


def test_links_at_every_distance(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {}
    for i, x in enumerate(base):
        for d in (0, 1, 4, 5):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            fps[len(fps) + 1000 * (i % 2)] = y
    # A dense group: many fingerprints within reach of each other.
    for _ in range(300):
        y = base[0]
        for b in rng.sample(range(12), 2):
            y ^= 1 << b
        fps[5000 + len(fps)] = y
    import docketry.llm.simhash_dedup as module

    rows = [(k, np.array([v], np.uint64).view(np.int64)[0].item()) for k, v in fps.items()]
    table = spark.createDataFrame(rows, "doc_id long, fp long").repartition(4)
    monkeypatch.setattr(module, "fingerprints", lambda docs, shingle, key=None: table)
    for long_list in (20_000, 30, 1):
        found = {r["doc_id"]: r["component_id"] for r in near_duplicates(table, long_list=long_list).collect()}
        assert found == components(fps), long_list


def test_long_lists_link_what_lies_near(spark):
    rng = random.Random(3)
    fps = sorted({sum(1 << b for b in rng.sample(range(9), rng.randint(0, 7))) for _ in range(25)} | {1 << 40, 1 << 63, 31 << 50})
    table = spark.createDataFrame([(np.array([v], np.uint64).view(np.int64)[0].item(),) for v in fps], "fp long").repartition(3)
    for bits in range(5):
        pairs = [(r["u"] % 2**64, r["v"] % 2**64) for r in long_list_links(table, bits).collect()]
        assert all((a ^ b).bit_count() <= bits for a, b in pairs)
        up = {f: {f} for f in fps}
        for a, b in [*pairs, *pairs]:
            for x in (joined := up[a] | up[b]):
                up[x] = joined
        want = {f: {f} for f in fps}
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= bits and want[a] is not want[b]:
                    for x in (joined := want[a] | want[b]):
                        want[x] = joined
        assert up == want, bits


def test_posting_lists_over_batches():
    keys = np.repeat([1, 2, 5, 9], [3, 30, 4, 12])
    fps = np.arange(len(keys))
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"key": keys[i : i + size], "fp": fps[i : i + size]}) for i in range(0, len(keys), size)]
        whole, far = [], []
        for k, f, long in _lists(iter(batches), 8):
            (far if long else whole).extend(f.tolist())
        assert sorted(whole) == fps[(keys == 1) | (keys == 5)].tolist() and sorted(far) == fps[(keys == 2) | (keys == 9)].tolist()


def test_simhash_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "one two"), (5, "ONE  two"), (None, "one two"), (6, "x " * 60_000), (6, "x " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("key", F.lit(0))
    found = sorted(((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates(df).collect()))
    assert found == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (6, 6)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    random.Random(2).shuffle(edges)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}
