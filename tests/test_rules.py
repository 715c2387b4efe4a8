"""Rules that synthetic tables do not reach: quirks, nulls, edge cases."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docketry.functions import amounts as A
from docketry.functions import facts as X
from docketry.functions import lexicon as L
from docketry.functions import text as T
from docketry.operators import ocr, record, registry
from docketry.operators import schema as S
from docketry.sources import documents


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").withColumn("y", f(F.col("x"))).orderBy("i").collect()
        return [r["y"] for r in rows]

    return run


def test_amounts(apply):
    given = ["90.408.292", "15,557,041", "153,820", "500.000", "1.234,5", "1.23", "12", "٩٠.٤٠٨.٢٩٢ د", "", "1,2345", ",5", ".500", "abc", None]
    assert apply(A.parse_millimes, *given) == [90408292, 15557041, 153820, 500000, 1234500, 123000, 12000, 90408292, None, 1234, 5000, 500000, None, None]
    assert apply(A.format_millimes, 1234567, 5, 0, kind="long") == ["1.234,567 دينار", "0,005 دينار", "0,000 دينار"]
    assert apply(A.clean_label, " 3) فائض (12.000 د) : ", "(x)") == ["فائض", "(x)"]


def test_corrupted_layers(apply):
    flag = lambda x: T.is_corrupted(T.corruption_metrics(T.compact(x)))
    assert apply(flag, "ددرر تتمم " * 8, "نص قانوني عادي", "", None, "aaaa" + "b" * 46, "aaab cd") == [True, False, False, False, True, True]


def test_cleaning(apply):
    assert apply(T.clean_text, "الفيول 10\n ي11\n ي60", "صدر الحكم في القضية", None) == ["الفصول 10 و11 و60", "صدر الحكم في القضية", None]
    # Blank lines collapse before blanks at line ends go, so these three stay.
    assert apply(T.clean_whitespace, "a\n \n \nb", "a\n\n\n\nb", " a \t b ") == ["a\n\n\nb", "a\n\nb", "a b"]
    # A word that ends in alef is fused with a word that begins with lam.
    assert apply(T.rejoin_ocr_arabic, "ا لمحكمة", "و المدعي", "‏نص") == ["المحكمة", "والمدعي", "نص"]


def test_masks_and_null_words(apply):
    assert apply(T.is_masked_party, "ح.ح", "س . س", "شركة النور", "A***", "أبو", None, "") == [True, True, False, True, True, False, False]
    assert apply(T.nullable, " x ", "N/A", "", "Indeterminee", None) == ["x", None, None, None, None]


def test_numbers_and_dates(apply):
    assert apply(X.normalize_case_number, "68182.2019.دد القضية", "12/2019", None) == ["68182/2019", "12/2019", None]
    assert apply(X.normalize_date, "2020/10/13", "2020-1-2", "13/10/2020", None) == ["13/10/2020", "02/01/2020", "13/10/2020", None]
    assert apply(X.decision_date, "بتاريخ ٣ جوان 2020", "32 مايو 1999", "3 june 2020", None) == ["03/06/2020", "32/05/1999", None, None]
    assert apply(X.case_number, "القضية عدد 12/2019 ثم قضية عدد: 7", "رسمت القضية بكتابة المحكمة تحت عدد 55", None) == ["12/2019", "55", None]


def test_references(apply):
    assert apply(X.legal_references, "الفصل 10 و الفصل 010 من عقد القرض ثم فصل 7. الفصل 10 والفصل 0 هنا", "لا شيء", None) == [["الفصل 10 من عقد القرض", "الفصل 7"], None, None]


def test_operative_part(apply):
    text = "لهذه الأسباب طلب\nو لهذه الاسباب\nقضت المحكمة\n12\n--- Page 3 ---\nعن الطور الاستئنافي. ./\nبقية\nوحرر"
    assert apply(X.operative_part, text, "قضت المحكمة نهائيا\nحرر", "لا شيء", None) == ["ولهذه الأسباب\nقضت المحكمة\nعن الطور الاستئنافي", "قضت المحكمة نهائيا", None, None]


def test_status_sizes_errors(apply):
    assert apply(T.normalize_status, "Invalide", "pending", "", "En cours", "VALID") == ["Valide", "Anomalie", "Anomalie", "En cours", "Valide"]
    assert apply(T.readable_size, 512, 1024 * 1024, 3 * 1024 * 1024, kind="long") == ["1 KB", "1024 KB", "3.0 MB"]
    assert [len(x) if x else x for x in apply(T.truncate_error, "x" * 4001, "x" * 4000, "", None)] == [4000, 4000, None, None]


BANKED = f"المدعي: {L.BANK_NAME}\n{'.' * 50}\n"


def award(spark, text, kind="original", role="demandeur"):
    df = spark.createDataFrame([(text, kind, role)], "t string, k string, r string")
    return df.select(record.applicable_amounts(F.col("t"), F.col("k"), F.col("r")).alias("m")).first()["m"]


def test_award_rules(spark):
    listed = "المبالغ المالية التالية:\n1) أصل الدين (1.000,000 د)\n2) الفائض الجاري بنسبة 5 % (2.000,000 د)\n3) أداء بنسبة 7 % (3.000,000 د)\nوبعد الاطلاع"
    got = award(spark, BANKED + listed)
    assert got["millimes"] == 4_000_000 and len(got["variable"]) == 1
    assert award(spark, BANKED + listed, kind="infirmatif") is None
    assert award(spark, listed, role="appelant") is None
    assert award(spark, BANKED + "المبالغ التالية:\n1) الفائض الجاري\nوبعد ذلك") is None
    assert award(spark, BANKED + "بلا قائمة") is None


def test_delayed_interest_is_recovered_once(spark):
    grounds = BANKED + "فائض التأخير المقدر بـ 5.500 ثم فائض التاخير بداية من اليوم 9.900\n"
    listed = "المبالغ المالية التالية:\n1) أصل الدين (1.000,000 د)\n2) فائض التأخير غير مقروء\nوبعد الاطلاع"
    assert award(spark, grounds + listed)["millimes"] == 1_005_500
    again = listed.replace("غير مقروء", "(5.500 د)")
    assert award(spark, grounds + again)["millimes"] == 1_005_500


def test_summary_and_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "حكم بتفليس سنة 2019 مبلغ قدره خمسمائة دينار (500.000)")], "id int, text string")
    rows = {r["id"]: r["extraction"] for r in record.strengthen(df).collect()}
    assert all(v is None for k, v in rows[1].asDict(True).items() if k != "parties")
    assert rows[1] == rows[2]
    assert rows[3]["resume"].count(".") >= 3 and "2019" in rows[3]["resume"]


def test_model_record_is_completed(spark):
    reply = '```json\n{"tribunal": "T", "decision": "Nulle", "references_juridiques": ["x"], "resume": "a. b. c. d. e. f."}\n``` fin'
    df = spark.createDataFrame([(reply, BANKED + "قضية عدد 12/2019")], "raw string, text string")
    df = df.withColumn("reply", record.normalize_record(record.parse_model_reply(F.col("raw"))))
    e = record.strengthen(df, record="reply").first()["extraction"]
    assert (e["tribunal"], e["decision"], e["references_juridiques"], e["resume"]) == ("T", None, ["x"], "a. b. c. d. e. f.")
    assert e["parties"]["demandeur"] == L.BANK_NAME and e["role_banque"] == "demandeur"
    broken = spark.createDataFrame([('{"tribunal": "T"',), ("none",), (None,)], "raw string")
    assert [r[0] for r in broken.select(record.parse_model_reply(F.col("raw"))).collect()] == [None] * 3


def test_references_alone_make_a_record_sufficient(spark):
    record_of = lambda refs: spark.createDataFrame([(refs,)], "r array<string>").select(F.struct(*(F.col("r").alias(k) if k == "references_juridiques" else F.lit(None).cast(v).alias(k) for k, v in S.FIELDS.items())).alias("x"))
    assert record_of(["a", "b", "c"]).select(registry.is_sufficient(F.col("x"))).first()[0]
    assert not record_of(["a", " ", None]).select(registry.is_sufficient(F.col("x"))).first()[0]


def test_refs_grow_beyond_four_digits(spark):
    new = spark.createDataFrame([(1, 2024), (25_000, 2024), (3, 2025)], "id long, year int")
    old = spark.createDataFrame([("D-2024-9999",), ("D-2024-x",), ("odd",)], "ref string")
    assert sorted(r["ref"] for r in registry.allocate_refs(new, old, "year", "id").collect()) == ["D-2024-10000", "D-2024-10001", "D-2025-0001"]


def test_reading_choice_and_merge(spark):
    found = spark.createDataFrame([(1, 1, "11", 100, 70.0), (1, 1, "6", 98, 71.5), (2, 1, "11", 50, 99.0), (2, 1, "6", 100, 60.0)], "doc_id long, page int, psm string, words long, confidence double")
    assert {r["doc_id"]: r["psm"] for r in ocr.choose_reading(found).collect()} == {1: "11", 2: "6"}
    lines = spark.createDataFrame([(1, 1, "6", 1, "نص أول"), (1, 1, "6", 2, "المحكمة هنا"), (1, 1, "11", 1, "سابق"), (1, 1, "11", 2, "المحكمة هنا"), (1, 1, "11", 3, "لاحق"), (1, 1, "11", 4, "بعيد"), (1, 1, "11", 5, "خارج")], "doc_id long, page int, psm string, line int, text string")
    chosen = spark.createDataFrame([(1, 1, "6")], "doc_id long, page int, psm string")
    merged = [r["text"] for r in ocr.merge_readings(lines, chosen).orderBy("position").collect()]
    assert merged == ["سابق", "المحكمة هنا", "لاحق", "بعيد", "نص أول", "المحكمة هنا"]


def test_excerpts_keep_to_the_budget(apply):
    text = "مقدمة " * 2000 + BANKED + "حشو " * 1000 + "المبالغ التالية:\n1) أصل (1.000 د)\nوبعد\nولهذه الأسباب\nقضت المحكمة"
    short, long = apply(lambda x: documents.excerpts(x, 1500), "قصير", text)
    assert short == "قصير" and len(long) <= 1500 and "[EXTRAIT: dispositif final]\nولهذه الأسباب" in long


def test_pages_and_routes(spark):
    df = spark.createDataFrame([(1, "--- Page 1 ---\na\n\n--- Page 2 ---\nb"), (2, "plain"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["page"], r["text"]) for r in documents.split_pages(df).collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "plain")]
    pages = spark.createDataFrame([(1, 1, "x" * 5), (1, 2, "a normal page of text"), (2, 1, "short"), (3, 1, None)], "doc_id long, page int, text string")
    types = {r["doc_id"]: (r["pdf_type"], r["pdf_type_detailed"]) for r in documents.document_types(documents.page_types(pages)).collect()}
    assert types == {1: ("scanned", "mixed_or_text"), 2: ("scanned", "scanned"), 3: ("scanned", "scanned")}
    routed = documents.route(spark.createDataFrame([("good text of a page", "o"), ("دددددددد", "o"), (None, " ")], "text string, ocr_text string")).collect()
    assert [(r["extraction_method"], r["usable_text"], r["error"]) for r in routed] == [("native", "good text of a page", None), ("ocr", "o", None), ("ocr", " ", "empty_text")]


def test_files_readers_and_clients(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    files = documents.scan_pdfs(spark, str(tmp_path))
    assert files.count() == 2
    pages = documents.read_with(files, lambda data: [data.decode(), "two"])
    assert sorted(r["text"] for r in pages.collect()) == ["a.pdf", "b.PDF", "two", "two"]

    def client(text):
        if text == "bad":
            raise RuntimeError("no")
        return "{}"

    replies = documents.complete_with(spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, text string"), client)
    assert {r["doc_id"]: (r["raw"], r["error"]) for r in replies.collect()} == {1: ("{}", None), 2: (None, "RuntimeError: no")}
    documents.write_text(spark.createDataFrame([(1, "é\n")], "doc_id long, text string"), str(tmp_path / "out"))
    assert [tuple(r) for r in documents.read_text(spark, str(tmp_path / "out")).collect()] == [("1", "é\n")]


def test_ocr_by_injected_engine_end_to_end(spark):
    """Pages of a file, each read in two modes, become words, lines, a choice of readings and one text."""
    said = {b"p1": "خبر عدد 5 \nنص", b"p2": "ص"}

    def engine(image, psm):
        found = []
        for i, line in enumerate(said[image].split("\n")):
            for j, word in enumerate(line.split(" ")):
                conf = 90.0 if psm == "psm6" else 50.0
                found.append({"block_num": 1, "par_num": 1, "line_num": i, "text": word, "conf": conf, "left": j, "top": i, "width": 2, "height": 1})
        return found

    files = spark.createDataFrame([("a.pdf", bytearray(b"p1,p2")), ("b.pdf", bytearray(b"p2"))], "path string, content binary")
    words = documents.recognise_with(files, lambda content: content.split(b","), engine)
    assert words.count() == 2 * (5 + 1 + 1)  # the blank word at a line's end is there until lines are built
    texts = {(r["doc_id"], r["page"]): r["text"] for r in ocr.page_text(ocr.merged_lines(words)).collect()}
    assert texts == {("a.pdf", 1): "خبر عدد 5\nنص", ("a.pdf", 2): "ص", ("b.pdf", 1): "ص"}
    both = ocr.merge_readings(ocr.lines(words), ocr.choose_reading(ocr.readings(words)))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, ocr.merged_lines(words).select(*both.columns).collect()))
    boxes = ocr.visible_words(words).filter("doc_id = 'a.pdf' and page = 1 and psm = 'psm6' and line_num = 0").orderBy("idx").select("confidence", "bbox").collect()
    assert (boxes[1]["confidence"], list(boxes[1]["bbox"])) == (0.9, [1, 0, 3, 1])


def test_blocks_by_injected_reader(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"x"))], "path string, content binary")
    found = documents.blocks_with(files, lambda content: [[([0.0, 1.0, 2.0, 3.0], " one "), ([0.0, 0.0, 1.0, 1.0], " ")], [([5.0, 5.0, 6.0, 6.0], "two")]]).collect()
    assert [(r["path"], r["page"], list(r["bbox"]), r["text"]) for r in found] == [("a.pdf", 1, [0, 1, 2, 3], "one"), ("a.pdf", 2, [5, 5, 6, 6], "two")]


def test_repeated_changes_make_no_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    changes = spark.createDataFrame([(1, "c"), (1, "d")], "id long, x string")
    assert sorted(map(tuple, registry.update_by_id(rows, changes, ["x"]).collect())) == [(1, "d"), (2, "b")]


def test_spans_of_very_many_matches(spark):
    found = spark.createDataFrame([("ab " * 20_000 + "é ab",), ("",), (None,)], "t string").select(T.spans(F.col("t"), "(?U)ab").alias("x")).collect()
    assert len(found[0]["x"]) == 20_001 and [tuple(x) for x in (found[0]["x"][19_999], found[0]["x"][-1])] == [(59_997, 59_999, "ab"), (60_002, 60_004, "ab")]
    assert found[1]["x"] == [] and found[2]["x"] is None


def test_spans_of_texts_that_hold_marks(spark):
    texts = ["a\x01b ab", "\x01\x01ab\x01", "ab\x02\x01\x02ab\x01\x01", "\x02ab\x01\x02", "ab\x01ab\x02\x01\x01\x02\x02ab"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.spans(F.col("t"), "ab").alias("x")).collect()
    for r in found:
        assert [(x["start"], x["stop"]) for x in r["x"]] == [m.span() for m in re.finditer("ab", r["t"])]
    name = L.BANK_NAME.replace(" ", "\x01", 1) + " " + L.BANK_NAME
    spans = spark.createDataFrame([(name,)], "t string").select(T.spans(F.col("t"), f"(?U){L.BANK}").alias("x")).first()["x"]
    assert [name[x["start"] : x["stop"]] for x in spans] == [x["value"] for x in spans]


@pytest.mark.parametrize("condition", ["extraction.montants_fixes is not null", "extraction.decision = 'Favorable' and doc_id % 2 = 0", "extraction.explication_montant like '%x%' or extraction.resume is null", "extraction.montant is not null and size(extraction.references_juridiques) > 2 and extraction.tribunal is not null"])
def test_filters_on_records_plan_in_seconds(spark, condition):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("قضية عدد 12/2019").alias("text"))
    began = time.monotonic()
    rows = record.strengthen(docs).filter(condition).select("extraction.montant")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert time.monotonic() - began < 20
    assert plan.index("Filter") < plan.index("Generate")
    rows.collect()


def test_filters_on_other_columns_reach_the_source(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "docs"))
    rows = record.strengthen(spark.read.parquet(str(tmp_path / "docs"))).filter("doc_id = 1 and extraction.decision is null")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1)]" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1


def test_the_advance_is_noted_once(spark):
    said = f"{L.BANK_NAME} مبلغ 1.234,567 د تسبقة مبلغ قدره خمسمائة دينار (500,000)"
    once = record.strengthen(spark.createDataFrame([(1, said), (2, said.split(" تسبقة")[0]), (3, said[len(L.BANK_NAME) :])], "doc_id long, text string"))
    found = {r["doc_id"]: r["extraction"] for r in once.collect()}
    assert found[1]["explication_montant"].endswith(f" {L.ADVANCE_NOTE}") and found[1]["montant_justification"] == found[1]["explication_montant"]
    assert L.ADVANCE_NOTE not in found[2]["explication_montant"] and found[3]["explication_montant"] is None
    again = record.strengthen(once.withColumn("text", F.lit(said)).withColumnRenamed("extraction", "given"), record="given")
    notes = {r["doc_id"]: (r["extraction"]["explication_montant"] or "").count(L.ADVANCE_NOTE) for r in again.collect()}
    assert notes == {1: 1, 2: 1, 3: 1}


def test_nearest_amounts_against_a_plain_walk(spark):
    rng = random.Random(5)
    pieces = [L.BANK_NAME, L.BANK_NAME.replace(" ", "\n "), "1.234,567", "12.345.678,900", "999,999", "٩.٩٩٩,٩٩٩", "x " * 40, "نص " * 150, "5", "\x01", ".", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(14))) for _ in range(200)]

    def plain(text):
        banks = [m.span() for m in re.finditer(L.BANK, text)]
        best = None
        for m in re.finditer(r"[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{3}", text):
            before = [a for a, b in banks if b <= m.start()]
            if before and m.start() - before[-1] <= L.AMOUNT_REACH and (best is None or m.start() - before[-1] < best[0]):
                best = (m.start() - before[-1], m[0])
        return best and f"{best[1]} {L.DINAR}"

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", record.nearest_bank_amount(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == {t: plain(t) for t in texts} and len({r["x"] for r in rows}) > 2


def test_nearest_amount_is_linear_in_the_text(spark):
    # What follows the last amount was searched anew from each of its characters: 15 s for a text a tenth as long.
    text = F.concat(F.lit(f"{L.BANK_NAME} 1.234,567 "), F.repeat(F.lit("كلام "), 40_000))
    began = time.perf_counter()
    assert spark.range(4).select(record.nearest_bank_amount(text).alias("v")).distinct().collect()[0]["v"] == "1.234,567 دينار"
    assert time.perf_counter() - began < 20


def test_digits_of_other_scripts_are_matched_where_they_stand(spark):
    text = "الفصل ٢١ من عقد القرض و الفصل 7 . بتاريخ ٣ ماي ٢٠١٩ ثم x12 جانفي 2018"
    row = spark.createDataFrame([(text,)], "t string").select(X.decision_date(F.col("t")).alias("d"), X.legal_references(F.col("t")).alias("r"), T.strip(F.lit("\u3000\x85 a \u2028")).alias("s")).first()
    assert tuple(row) == ("03/05/2019", ["الفصل 21 من عقد القرض", "الفصل 7"], "a")


def test_words_of_many_pages_go_together(spark, monkeypatch):
    # Each page made a table of its own.
    word = {"block_num": 1, "par_num": 1, "line_num": 1, "text": "w", "conf": 9.0, "left": 0, "top": 0, "width": 1, "height": 1}
    files = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit(b"x").alias("content"))
    found = documents.recognise_with(files, lambda data: [data, data], lambda image, psm: [word])
    made = []
    monkeypatch.setattr(documents.pd, "DataFrame", lambda rows, columns: made.append(len(rows)) or rows)
    monkeypatch.setattr(type(files), "mapInPandas", lambda self, run, schema: run)
    run = documents.recognise_with(files, lambda data: [data, data], lambda image, psm: [word])
    assert sum(len(x) for x in run([{"path": ["a"] * 3000, "content": [b"x"] * 3000}])) == 12_000 and len(made) == 2
    monkeypatch.undo()
    assert found.count() == 12_000


def test_a_tie_of_tenths_goes_up(apply):
    assert apply(T.readable_size, 2_359_296, 786_432 * 3, kind="long") == ["2.3 MB", "2.3 MB"]
