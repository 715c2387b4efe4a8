"""Phrases, manifests and shards against plain versions, odd tables and forced collisions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docketry.llm import phrases
from docketry.llm.common import running_total
from docketry.llm.merkle import folded, manifest, proof_digest, row_digest, tampered_text, verified_manifest
from docketry.llm.queries import oracle_sql, op11_phrase_mining, op12_merkle_manifest, op13_hilbert_sharding
from docketry.llm.sharding import hilbert_index, hilbert_shards, number_code, write_shards

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- phrases


def plain_phrases(docs, least, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {k: {p: a for p, a in v.items() if a >= least} for k, v in counts.items()}, totals


def plain_collocations(docs, top, least, longest=5):
    counts, totals = plain_phrases(docs, least, longest)
    out = []
    for lang, found in counts.items():
        rows = []
        for p, a in found.items():
            holders = (q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if len(p) == 1 or any(100 * found[q] >= 100 * a for q in holders):
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, totals[lang], score) for i, (score, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def noise(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "A", "cc", "é", "日本", "x\x0b", "it's", "<t>", "\x00q", "the", "the", "of"]
    ends = [" ", " ", " ", "  ", "\t", " \t ", ".", ", ", "\n", "\r\n", "!?", "\x0c"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(80))) for _ in range(n)]
    return [(rng.choice(["en", "fr", None, "und", ""]), t) for t in [*texts, *texts[:5], "", None, " \t", ".", "the " * 500, "q" * 3000]]


@pytest.mark.parametrize(("mask", "block_bytes"), [((1 << 64) - 1, 8_000_000), ((1 << 64) - 1, 40), (0xFF << 56, 8_000_000), (0, 500)])
def test_phrases_equal_the_plain_count(spark, mask, block_bytes):
    docs = noise(1)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "phrase long, lang string, text string").repartition(3)
    for least, top in ((3, 2000), (5, 7)):
        found = phrases.collocations(df, top, least, mask=mask, block_bytes=block_bytes)
        assert sorted(map(tuple, found.collect())) == plain_collocations(docs, top, least)


def test_collisions_are_told_apart():
    found = np.array([7, 7, 7, 9, 7], np.uint64)
    first, counts = phrases.exact_groups(found, [np.array([1, 2, 1, 1, 2])])
    assert sorted(zip(first.tolist(), counts.tolist(), strict=True)) == [(0, 2), (1, 2), (3, 1)]


def test_a_long_text_is_cut_between_words():
    text = ("alpha beta  gamma. delta\t" * 50 + "x" * 300 + " end one two").encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.binary()), pa.array([0], pa.int64())], names=["text", "lang_hash"])
    for size in (1, 7, 64, 299, 10_000):
        got = Counter()
        for block, _, rows, before in phrases.blocks(batch, size, 3):
            fp, ok = block.fingerprints(3, np.zeros(rows, np.uint64), (1 << 64) - 1)
            for i in np.flatnonzero(ok[: block.own]):
                got[text[before + block.starts[i] : before + block.stops[i + 2]]] += 1
        want = Counter()
        for p in re.finditer(rb"[^.,;:!?\n-\r]+", text):
            words = list(re.finditer(rb"[^ \t]+", p[0]))
            want.update(p[0][a.start() : b.end()] for a, b in zip(words, words[2:]))
        assert got == want


def test_long_words_have_one_hash_wherever_they_stand():
    words = [b"a", b"w" * 70_000, b"b" * 900_000, b"v" * 100_000, b"c", b"w" * 1_200_000]
    alone = [phrases._word_hashes(pa.array([w], pa.binary()))[0] for w in words]
    assert phrases._word_hashes(pa.array(words, pa.binary())).tolist() == alone == [phrases._word_hashes(pa.array([*reversed(words)], pa.binary()))[-1 - i] for i in range(6)]


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)]
    found = phrases.scored(spark.createDataFrame(rows, "lang string, n int, phrase string, a long"), spark.createDataFrame([("en", 500 * big)], "lang string, n_words long"))
    assert [r["score"] for r in found.collect()] == [1000 * big * 500 * big // (2 * big * (big + 1))]


def test_phrases_of_empty_tables(spark):
    for rows in ([], [("en", None)], [(None, " . ")]):
        df = spark.createDataFrame(rows, "lang string, text string")
        assert phrases.collocations(df).collect() == []


def compared(spark, query, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    found = query(spark, SF)
    assert sorted(found.columns) == sorted(columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return rows


def test_phrase_query_equals_sql(spark):
    compared(spark, op11_phrase_mining, "op11_phrase_mining")


# ---- manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, arity):
    """(top, for each leaf the (before, behind) digests of every level)"""
    steps, of = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_of = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for j in range(len(run)):
                for leaf in of[a + j]:
                    steps[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            up_of.append([x for part in of[a : a + arity] for x in part])
        nodes, of = up, up_of
    return nodes[0], steps


def plain_manifest(docs, arity=8):
    groups = defaultdict(list)
    for d in docs:
        of = lambda text: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))  # noqa: B023, E731
        tampered = zlib.crc32(str(d["doc_id"]).encode() if d["doc_id"] is not None else b"") % 3 == 0 and d["text"] is not None
        groups[d["lang"]].append((d["doc_id"], of(d["text"]), of(lowered(d["text"]) if tampered else d["text"])))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: plain_tree([x[1] for x in groups[g]], arity) for g in names}
    if not names:
        return []
    root, over = plain_tree([trees[g][0] for g in names], arity)
    out = []
    for j, g in enumerate(names):
        for (doc, leaf, seen), steps in zip(groups[g], trees[g][1], strict=True):
            at = seen
            for l, r in [*steps, *over[j]]:
                at = sha(l + at + r)
            out.append((doc, leaf, trees[g][0], root, sha("".join(l + r for l, r in [*steps, *over[j]])), at, at == root))
    return sorted(out, key=repr)


def shown(found):
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("p"), folded(F.col("seen"), F.col("steps")).alias("f"))
    return sorted(map(tuple, found.withColumn("v", F.col("f") == F.col("root")).collect()), key=repr)


def test_manifest_equals_sql_and_plain_version(spark):
    rows = compared(spark, op12_merkle_manifest, "op12_merkle_manifest")
    assert {r[-1] for r in rows} == {True, False}
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in columns) for r in op12_merkle_manifest(spark, SF).collect()), key=repr) == plain_manifest(docs)


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_of_odd_tables(spark, arity):
    rng = random.Random(arity)
    rows = [(rng.choice([None, i, i, i, 5]), rng.choice([None, "", "Été", f"T{i}", "x" * 2000]), rng.choice(["en"] * 8 + [None, "", "é", "z", f"only{i}"]), rng.choice([None, "s"]), rng.choice([None, -3, i])) for i in range(150)]
    for some in ([], rows[:1], rows) if arity == 2 else (rows[:40] * 3,):
        df = spark.createDataFrame(some, DOCUMENT).withColumn("idx", F.lit(1)).withColumn("tree", F.lit("t")).repartition(3)
        found = verified_manifest(df, tampered_text(F.col("doc_id"), F.col("text")), arity=arity)
        assert shown(found) == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in some], arity)


def test_manifest_carries_columns_of_any_name(spark):
    df = spark.createDataFrame([(2, "a", "d2", 7), (1, "a", "d1", 8)], "id long, g string, d string, idx long")
    found = manifest(df, "id", "g", "d", ("idx",), 2)
    assert [tuple(r)[:4] for r in found.orderBy("id").collect()] == [(1, "a", 8, "d1"), (2, "a", 7, "d2")]


# ---- shards


def test_hilbert_curve_is_continuous_and_whole(spark):
    for n, bits in ((1, 4), (2, 1), (2, 4), (3, 3), (4, 2)):
        cells = spark.range(1 << (n * bits)).select(F.array(*(F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1).cast("int") for i in range(n))).alias("at"))
        path = [r["at"] for r in cells.withColumn("place", hilbert_index(F.col("at"), n, bits)).orderBy("place").collect()]
        assert [r["place"] for r in cells.select(hilbert_index(F.col("at"), n, bits).alias("place")).orderBy("place").collect()] == list(range(1 << (n * bits)))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(path, path[1:]))


def test_number_codes_ascend(spark):
    rng = random.Random(3)
    values = sorted({0, 1, -1, 2**63 - 1, -(2**63), *range(2000, 2100), *(rng.randrange(-(2**63), 2**63) >> rng.randrange(63) for _ in range(2000))})
    rows = spark.createDataFrame([(v,) for v in [None, *values]], "v long").select("v", number_code(F.col("v")).alias("code")).collect()
    codes = [r["code"] for r in sorted(rows, key=lambda r: (r["v"] is not None, r["v"] or 0))]
    assert codes == sorted(codes) and codes[0] == 0 < codes[1] and codes[-1] < 2 * 60_000
    small = {r["v"]: r["code"] for r in rows if r["v"] is not None and abs(r["v"]) < 2048}
    assert len(set(small.values())) == len(small)


def check_shards(found, docs, shards=8):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs if d is not None)
    assert len(found) == len(docs)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(found)
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    places = [(r["place"], r["size"], r["text_crc32"]) for r in order]
    assert places == sorted(places)


def test_sharding_query(spark):
    found = op13_hilbert_sharding(spark, SF)
    rows = found.collect()
    check_shards(rows, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    again = hilbert_shards(spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again.collect()}


def test_shards_of_odd_tables(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, i, 3]), rng.choice([None, "", "é", "long " * 9000, "copy"]), rng.choice([None, "", "en", f"l{i}"]), rng.choice(["hot"] * 5 + [None, f"s{i}"]), rng.choice([None, -5, 0, i, 2**62])) for i in range(120)]
    for some in ([], rows[:1], rows[:3], rows, [rows[0]] * 90):
        df = spark.createDataFrame(some, DOCUMENT).withColumn("code_0", F.lit(1)).withColumn("place", F.lit("p")).withColumn("a.b", F.lit(2)).repartition(4)
        check_shards(hilbert_shards(df).collect(), [r[:2] for r in some])
    with pytest.raises(ValueError, match="cells"):
        hilbert_shards(df, bits=6)


def test_written_shards_prune_every_dimension(spark, tmp_path):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") * 7 % 8).alias("lang"),
        F.concat(F.lit("s"), F.col("id") * 11 % 16).alias("source"), (F.col("id") * 7919 % 5003).alias("n_chars"), F.lit(1).alias("shard"), F.lit(2).alias("a.b"),
    )
    out = str(tmp_path / "out")
    write_shards(docs, out, shards=16)
    back = spark.read.parquet(out)
    assert sorted(map(tuple, back.select(*(f"`{c}`" for c in docs.columns)).collect())) == sorted(map(tuple, docs.collect()))
    files = [pq.read_table(f).select(["lang", "source", "n_chars"]).to_pydict() for f in (tmp_path / "out").rglob("*.parquet")]
    for column, value in (("lang", "l3"), ("source", "s5"), ("n_chars", 2500)):
        touched = sum(min(f[column]) <= value <= max(f[column]) for f in files)
        assert touched <= 0.6 * len(files), (column, touched, len(files))


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abbb"), rng.choice([None, 1, 2, 3]), rng.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    for group in ("g", None):
        found = running_total(df, ["o"], "v", group).collect()
        by = defaultdict(list)
        for r in found:
            by[r["g"] if group else ""].append((r["before"], r["before"] + r["v"], r["o"] or 0))
        for spans in by.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans, spans[1:]))


def test_digest_marks_nulls_and_lengths(spark):
    found = spark.createDataFrame([(None, "é")], "a long, b string").select(row_digest([F.col("a"), F.col("b")]).alias("d")).first()["d"]
    assert found == sha("-2:é")
