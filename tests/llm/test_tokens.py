"""Tokens, packing and length sums against the tokenizer itself."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import tokens
from docketry.llm.packing import best_fit_decreasing, dominance_reduction, pack_documents, plan
from docketry.llm.queries import op3_best_fit_packing, op10_token_counts
from docketry.llm.token_counts import length_histogram, suffix_sums, token_quantile, truncated_total

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_ids_equal_the_tokenizer(spark, tokenizer):
    rng = random.Random(4)
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "a \n\n  b", "\t x", "don't we'll 's", " 's", "é è  ü", "x\x1cy z", "a b", "a   b", "<|endoftext|> x", "日本 語", "1 2  3", "a\r\n b \r\n"]
    odd += ["".join(rng.choice("ab' \n\t1é. ") for _ in range(rng.randrange(40))) for _ in range(500)]
    for cache in (0, 1000):
        encoder = tokens.ByteBpe(tokens.default_vocabulary(), cache)
        for text in [*odd, *documents(spark).values()]:
            ids = list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text)))
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_runs_of_mixed_whitespace_equal_the_tokenizer(tokenizer):
    rng = random.Random(5)
    runs = ["a \u00a0 \u00a0", "a \u00a0 \u00a0 \u00a0 \u00a0 x", " \u00a0 \u00a0", "a \n \n b", "a\n ", "a\u00a0 b", "a \u00a0b", "\u2003 \u2003 c"]
    runs += ["".join(rng.choice(["a", "b", " ", " ", " ", "\u00a0", "\n", "\t", "\u2003", "\u2009", "\u3000", "\x85", "\x1c", ".", "\u0660", "\u1e9e", "\U0001d7d8", "<|endoftext|>", "<|endoftext", "|>"]) for _ in range(rng.randrange(30))) for _ in range(1000)]
    encoder = tokens.ByteBpe(tokens.default_vocabulary())
    for text in runs:
        ids = list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text)))
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_settled_characters_mean_the_same_to_both_libraries(tokenizer):
    encoder = tokens.ByteBpe(tokens.default_vocabulary())
    for c in map(chr, range(ord(tokens.SETTLED))):
        for text in (c, f"a{c}1", f" {c}{c} b", f"1{c}a{c}.", f"'{c}s"):
            assert encoder._chunk(text) == encoder._encode(text), repr(text)


def check_packing(rows, texts, tokenizer, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == capacity or (k == 0 and r["length"] <= capacity)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_query(spark, tokenizer):
    texts = documents(spark)
    used, least = check_packing(op3_best_fit_packing(spark, SF).collect(), texts, tokenizer)
    assert used <= 1.01 * least + 1


def test_packing_odd_rows(spark, tokenizer):
    texts = {1: "", 2: "word " * 5000, 3: "x", 4: "a b c"}
    rows = [(1, None), *((k, v) for k, v in texts.items() if k > 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(9)).withColumn("piece", F.lit("p"))
    check_packing(pack_documents(df, bucket_rows=2).collect(), texts, tokenizer)
    twice = pack_documents(spark.createDataFrame([(None, "a"), (None, "a"), (7, "a")], "doc_id long, text string")).collect()
    assert sorted(r["offset"] for r in twice) == [0, 2, 4]
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def optimal(lengths, capacity):
    """The least number of bins, by trying everything."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins) if b >= lengths[i]}.values():
            bins[k] -= lengths[i]
            go(i + 1, bins)
            bins[k] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best


def expand(bins):
    return Counter({k: sum(n * dict(p).get(k, 0) for p, n in bins) for k in {x for p, _ in bins for x, _ in p}})


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(120):
        capacity = rng.choice([10, 20, 31])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = dominance_reduction(Counter(lengths), capacity)
        rest = sorted((k for k, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + optimal(rest, capacity) == optimal(lengths, capacity), lengths


def test_plans_hold_every_piece():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([7, 16, 1024])
        counts = Counter({rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(1, 40))})
        for bins in (plan(counts, capacity), best_fit_decreasing(counts, capacity)):
            assert +expand([(tuple(Counter({k: sum(m for j, m in p if j == k) for k, _ in p}).items()), n) for p, n in bins]) == counts
            assert all(sum(k * m for k, m in p) <= capacity for p, _ in bins)


def test_length_sums(spark, tokenizer):
    lengths = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in documents(spark).values())
    rows = {r["length"]: r for r in op10_token_counts(spark, SF).collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        longer = [x for x in lengths if x > limit]
        assert (r["n_docs"], r["docs_longer"], r["tokens_longer"]) == (lengths.count(limit), len(longer), sum(longer))
        assert r["truncated_total"] == sum(min(x, limit) for x in lengths)
        assert r["quantile"] == (len(lengths) - len(longer)) / len(lengths)
    sums = suffix_sums(length_histogram(spark.read.parquet(f"{SF}/documents.parquet")), group=7)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, rows.values()))
    for limit in (0, 1, 333, 10**6):
        assert truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_quantile(sums, 0.5).first()[0] == lengths[-(-len(lengths) // 2) - 1]


def test_length_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 3)], "text string, length int")
    assert [(r["length"], r["n_docs"]) for r in suffix_sums(length_histogram(df)).orderBy("length").collect()] == [(0, 2), (1, 2)]
    assert suffix_sums(length_histogram(spark.createDataFrame([], "text string"))).count() == 0
