"""Winnowing against the plain definition of windows and hits."""

from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from docketry.llm.decontam import contamination
from docketry.llm.queries import op2_decontamination

SF = "/root/testdata/sf0.001"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault((n, *w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {k[0] for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (n, *w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[n, *w[i : i + n]]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in contamination(docs, items, **options).collect()), key=str)


def test_random_texts_with_few_words(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "é", "A", "7x"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 9, 10, 11, 14, 30]))) for i in range(25)] + [(90, None), (91, "..."), (92, "a b"), (92, "b é a"), (None, "7x 7x")]
    docs = [(i, make(rng.choice([0, 1, 5, 9, 10, 25, 60]))) for i in range(80)] + [(500, None), (501, ""), (501, "A  B"), (None, "a-b" * 30)]
    for i in range(10):  # planted spans across item borders and inside longer texts
        docs.append((600 + i, make(7) + " zz " + rng.choice(items[:25])[1] + " " + make(5)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    for options in ({}, {"chunk_bytes": 50}, {"block_bytes": 200}):
        assert found(d, b, **options) == want, options


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert found(docs, items) == []
    assert found(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items) == [(1, 2, 0, [])]


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "filler " * 80_000 + item[20:] + " end " * 10)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")) == plain(docs, [(7, item)])


def test_repeated_words_on_both_sides_take_linear_time(spark):
    docs, items = [(1, "a " * 20_000), (2, "a " * 9), (3, "b " + "a " * 10 + "b")], [(7, "a " * 5_000), (8, "a " * 800 + "b")]
    began = time.monotonic()
    rows = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows == [(1, 20_000, 20_000, ["7", "8"]), (2, 9, 0, []), (3, 12, 11, ["7", "8"])]
    assert time.monotonic() - began < 60


def test_spans_are_runs_of_words(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"x {item} y {item} z"), (2, " ".join(item.split()[5:15]) + " " + " ".join(item.split()[14:24]))]
    rows = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [[(s["start"], s["stop"]) for s in r["spans"]] for r in rows] == [[(1, 31), (32, 62)], [(0, 20)]]


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in plain(docs, items)]
    rows = op2_decontamination(spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows), key=str) == sorted(want, key=str)
    assert any(r["contaminated"] for r in rows)
