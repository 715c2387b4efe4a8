"""That work is dealt out by the rows there are, and is done once."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from docketry.functions import facts
from docketry.functions import lexicon as L
from docketry.functions import text as T
from docketry.operators import ocr, record, schema
from docketry.plans import derived as D
from docketry.plans import queries
from docketry.sources import documents as docs

SF = "/root/testdata/sf0.001"


def test_long_page_is_cut_in_linear_time(spark):
    rows = spark.range(12_000).selectExpr("1 AS doc_id", "id AS row", "id * 7 % 41 AS darkness")
    begun = time.time()
    cuts = ocr.cut_points(rows, band=50, radius=8, gap=47).first()["cuts"]
    assert time.time() - begun < 15
    assert cuts[0] == 0 and cuts[-1] == 12_000 and all(b - a >= 47 for a, b in zip(cuts[:-2], cuts[1:-1], strict=True))
    assert all(c * 7 % 41 == min(x * 7 % 41 for x in range(c - 4, c + 5)) for c in cuts[1:-1])


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "tasks", lambda s: 2)
    assert D.tasks_of(spark, D.table(spark, SF, "orders"), 100) == 15 and D.tasks_of(spark, D.table(spark, SF, "region")) == 2
    monkeypatch.setattr(D, "tasks_of", lambda *_: 7)
    for rows in (D.judgments(spark, SF), D.words(spark, SF), D.dealt(spark, SF, "orders"), queries._distant(spark, SF)):
        assert rows.rdd.getNumPartitions() == 7


def test_words_move_once(spark):
    plan = ocr.merged_lines(D.words(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_nearest_amount_is_computed_behind_the_deal(spark):
    plan = queries.nearest_amount(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan[plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Repartition") :].lower()


def test_empty_text_is_null_and_computed_once(spark):
    row = spark.createDataFrame([("a",), ("",), (None,)], "t string").select(T.filled(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in row] == ["a", None, None]
    plan = spark.createDataFrame([("a",)], "t string").select(T.found(F.col("t"), "(a)").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_excerpts_around_first_and_last_mention(spark):
    name = "البنك  تمويل المؤسسات الصغرى والمتوسطة"
    text = "\U0001f600" * 50 + "a" * 2000 + name + "b" * 3000 + name + "c" * 2000
    found = spark.createDataFrame([(text,)], "t string").select(docs.excerpts(F.col("t"), 4500).alias("x")).first()["x"].split("[EXTRAIT: ")
    assert [p.count(name) for p in found if p.startswith("contexte banque")] == [1, 1]
    first, last = (p.split("\n", 1)[1].strip() for p in found if p.startswith("contexte banque"))
    at, again = text.index(name), text.rindex(name)
    for got, k in ((first, at), (last, again)):
        whole = text[k - 120 : k + len(name) + 430]
        room = 400 - len(L.SHORTENED)
        assert got == whole[: room // 2].rstrip() + L.SHORTENED + whole[len(whole) - (room - room // 2) :].lstrip()


def test_items_are_written_outside_of_lambdas(spark):
    """Spark compiles no function of an array's elements, so amounts are written a line item at a time, before items are grouped."""
    plan = D.judgments(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    values = [0.0, 0.0005, 0.0015, 1.0005, -1.0005, 999.9995, 999999.9996, 12345678.0125, 1e9 + 0.0005, -1234567.891]
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(D.millimes(x).alias("m"), F.round(x.cast("decimal(20,6)") * 1000).cast("long").alias("want"))
    rows = rows.select("m", "want", D.written(F.col("m"), F.lit(2)).alias("w"), F.concat(F.format_number(F.floor(F.col("m") / 1000), 0), F.lit(","), F.lpad((F.col("m") % 1000).cast("string"), 3, "0")).alias("long"))
    assert all(r["m"] == r["want"] and r["w"] == r["long"] for r in rows.collect())


def test_decision_is_worked_out_where_an_award_stands(spark):
    judgment = f"المدعي: {L.BANK_NAME}\nولهذه الأسباب\nقضت المحكمة {{}} المبالغ\nعن الطور الحالي"
    texts = [judgment.format(w) for w in (*L.AWARDED, "برفض")] + [None]
    text = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", facts.bank_role(text).alias("role"), facts.operative_part(text).alias("part"))
    got = rows.select(facts.bank_decision(F.col("role"), F.col("part"), text).alias("a"), facts.bank_decision(F.col("role"), F.col("part")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == ["Favorable"] * 4 + [None] * 2
    plan = queries.bank_decision(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains") < plan.index(L.BANK)


def test_json_records_are_packed(spark, tmp_path):
    rows = record.strengthen(D.judgments(spark, SF)).select("doc_id", "extraction.*").coalesce(1)
    docs.write_json(rows, str(tmp_path / "packed"))
    rows.write.json(str(tmp_path / "plain"))
    size = {x: sum(f.stat().st_size for f in (tmp_path / x).glob("part-*")) for x in ("packed", "plain")}
    assert size["packed"] * 5 < size["plain"]
    read = lambda x: sorted(map(str, spark.read.schema(rows.schema).json(str(tmp_path / x)).collect()))
    assert read("packed") == read("plain") and len(read("packed")) == rows.count()


def test_decided_are_the_rows_of_that_decision(spark):
    rows = D.judgments(spark, SF).withColumn("k", F.col("doc_id") % 4)
    given = F.when(F.col("k") == 0, F.struct(*(F.lit({"decision": " Favorable ", "role_banque": "demandeur"}.get(n)).cast(v).alias(n) for n, v in schema.FIELDS.items())))
    for df, name in ((rows, None), (rows.withColumn("given", given), "given")):
        want = record.strengthen(df, record=name).filter("extraction.decision = 'Favorable'")
        assert sorted(map(str, record.decided(df, "Favorable", record=name).collect())) == sorted(map(str, want.collect()))
    plan = record.decided(rows, "Favorable")._jdf.queryExecution().optimizedPlan().toString()
    # Above the rendering of the text, which is not repeated in it.
    at = re.search(r"Filter [^\n]*_hit#", plan).start()
    assert at < plan.index("RepartitionByExpression") and plan.count("قسط رقم الدين") == 1


def test_ends_of_texts_are_cut_by_bytes(spark):
    texts = ["", "a", "é", "\U0001f600", "اaé\U0001f600" * 3, "\U0001f600" * 9, "ا" * 9, None]
    rows = spark.createDataFrame([(t, t[2:] if t else t) for t in texts], "t string, tail string")
    found = rows.select("t", "tail", *(T.last_chars(F.col("t"), n).alias(f"n{n}") for n in (1, 3, 5)), T.before_tail(F.col("t"), F.col("tail")).alias("head")).collect()
    for r in found:
        assert [r["n1"], r["n3"], r["n5"], r["head"]] == ([None] * 4 if r["t"] is None else [r["t"][-1:], r["t"][-3:], r["t"][-5:], r["t"][:2]])
    plan = rows.select(T.before_last(F.col("t"), "a"), T.last_chars(F.col("t"), 3))._jdf.queryExecution().optimizedPlan().toString()
    assert " length(" not in plan.replace("octet_length(", "")


def test_every_name_of_the_bank_is_a_mention(spark):
    rest = " تمويل المؤسسات الصغرى والمتوسطة"
    texts = [x + rest for x in ("بنك", "البنك", "يتنك", "اليتنك", "تنك", "نك", "ال نك", "")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.has(F.col("t"), L.BANK).alias("a"), T.has(F.col("t"), L.MENTION).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] == [True] * 4 + [False] * 4
