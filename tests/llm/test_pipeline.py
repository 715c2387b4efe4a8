"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontam import plain
from tests.llm.test_dedup import ascii_lower, components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["language_id"](spark, docs, SF)
    assert docs.columns == columns
    assert ids(docs) == sorted(k for k, t in texts.items() if any(c.isalpha() for c in t or ""))

    last = {}
    for k in ids(docs):
        last[ascii_lower(texts[k])] = max(k, last.get(ascii_lower(texts[k]), -1))
    docs = stages["exact_dedup"](spark, docs, SF)
    assert ids(docs) == sorted(last.values()) and docs.columns == columns

    root = components({k: plain_fingerprint(texts[k]) for k in ids(docs)})
    docs = stages["simhash_dedup"](spark, docs, SF)
    assert ids(docs) == sorted(set(root.values()))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted(d for d, _, n_hit, _ in plain([(k, texts[k]) for k in ids(docs)], items) if not n_hit)
    docs = stages["decontamination"](spark, docs, SF)
    assert ids(docs) == clean

    packed = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r["doc_id"] for r in packed}) == clean


def test_odd_rows_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text here", "en", "s", 1), (3, "Same text here", "en", "t", 1), (4, "12 34", "en", "s", 1), (None, "no id at all", None, None, None), (5, "other words stand in this one", "en", "s", 2)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name == "exact_dedup" and given:
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["3", "5", "None"]
        assert docs.count() == (3 if given else 0)
    assert zlib.crc32(b"") == 0 and docs.select(F.count("*")).first()[0] == 0


def test_rows_that_share_an_id_are_decided_apart(spark, tmp_path):
    words = [[f"{k}{i}" for i in range(60)] for k in ("alpha", "beta", "gamma", "delta", "epsilon")]
    copied, alone, leaked, near, clean = (" ".join(w) for w in words)
    spark.createDataFrame([("b", " ".join(words[2][20:40]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, copied), (9, copied), (None, alone), (7, leaked), (7, clean), (5, near), (5, near.replace(" ", "  ")), (None, copied.replace(" ", "  "))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def left():
        return sorted((str(r["doc_id"]), r["text"]) for r in docs.collect())

    docs = stages["exact_dedup"](spark, docs, str(tmp_path))
    assert left() == sorted((str(i), t) for i, t in rows[1:])
    docs = stages["simhash_dedup"](spark, docs, str(tmp_path))
    found = left()
    assert [i for i, _ in found] == ["5", "7", "7", "9", "None"] and {t.replace("  ", " ") for _, t in found} == {copied, alone, leaked, near, clean}
    docs = stages["decontamination"](spark, docs, str(tmp_path))
    assert [(i, t.replace("  ", " ")) for i, t in left()] == [("5", near), ("7", clean), ("9", copied), ("None", alone)]


def test_columns_of_any_name_pass_through(spark):
    extra = ["score", "lang_pred", "_text", "_gone", "row_key", "found", "sure", "kept", "n_hit", "component_id", "uid", "Row_Key_"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra)
    rows = [(i, f"text number {'abcdefgh'[i]} of its own, " * (i + 1), "en", "s", i, *range(len(extra))) for i in range(5)]
    docs = spark.createDataFrame(rows + [(7, None, None, None, None, *[None] * len(extra))], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [x.split()[0].strip("`") for x in schema.split(", ")], name
        assert sorted((r["doc_id"], r["score"], r["row_key"], r["Row_Key_"]) for r in docs.collect()) == [(i, 0, 4, 11) for i in range(5)], name


def test_rows_of_files_are_keyed_by_their_place(spark, tmp_path):
    """Tables in files with odd column names, written stage by stage; and inputs that are no plain files."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` int, key_file int, `_meta data` string"
    words = [[f"{k}{i}" for i in range(60)] for k in ("alpha", "beta", "gamma")]
    rows = [(i % 4 or None, " ".join(words[i % 3]) + (" end" if i > 8 else ""), "en", "s", i, i, -i, 5, "m") for i in range(12)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/0")
    docs = spark.read.parquet(f"{tmp_path}/0")
    keyed, key = corpus_pipeline._keyed(docs)
    again, _ = corpus_pipeline._keyed(docs)
    assert keyed.select(key).distinct().count() == 12 and keyed.exceptAll(again).count() == 0 and "keyed-" not in str(keyed.inputFiles())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k + 1}")
        docs = spark.read.parquet(f"{tmp_path}/{k + 1}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d", "key_file", "_meta data"], name
    left = docs.collect()
    assert len(left) == 3 and all(r["a.b"] == -r["c`d"] == r["n_chars"] and rows[r["a.b"]][1] == r["text"] for r in left)
    exploded = spark.read.parquet(f"{tmp_path}/0").withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    for other in (exploded, docs.unionByName(docs), docs.limit(2), docs.withColumn("_metadata", F.lit(1)), spark.read.parquet(f"{tmp_path}/0").filter("doc_id = 99")):
        keyed, key = corpus_pipeline._keyed(other)
        assert keyed.columns == [*other.columns, key] and keyed.select(key).distinct().count() == other.count()
