"""Page ranges, model calls that go on, the substring index, paged listings, kept counts and cut points."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docketry.operators import ocr, paging, registry, search_index
from docketry.plans import arrivals, outside
from docketry.sources import completions, documents
from docketry.sources.pages import FormFeedFiles, read_pages
from docketry.streaming import counts

# ---- pages


class Counting(FormFeedFiles):
    """Notes in a file which pages were opened."""

    def read(self, name, first, last):
        with open(Path(name).parent / "opened", "a") as f:
            f.write(f"{Path(name).name} {first} {last}\n")
        return super().read(name, first, last)


@pytest.fixture
def books(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "large.txt").write_text("".join(f"page {i}\n é {i}\f" for i in range(1, 201)))
    (tmp_path / "in" / "small.txt").write_text("only\f")
    (tmp_path / "in" / "empty.txt").write_text("")
    return tmp_path / "in"


@pytest.mark.parametrize(("condition", "pages", "most"), [
    ("page = 150", [150], 1), ("page between 190 and 195", range(190, 196), 6), ("page > 198", [199, 200], 2), ("page >= 5 and page < 7", [5, 6], 2), ("page in (3, 4, 77)", [3, 4, 77], 3),
    ("page <= 0", [], 0), ("page in (1) and page = 2", [], 0), ("text like '%9 9%' and page < 20", [], 19 + 1),
])
def test_page_filters_read_few_pages(spark, books, condition, pages, most):
    rows = read_pages(spark, Counting(), str(books), pages_per_task=10).filter(condition).filter("path like '%large%'")
    assert sorted(r["page"] for r in rows.collect()) == list(pages)
    opened = (books / "opened").read_text().split("\n")[:-1] if (books / "opened").exists() else []
    assert sum(int(x.split()[2]) - int(x.split()[1]) + 1 for x in opened) <= most + 1


def test_large_files_are_read_by_many_tasks(spark, books):
    rows = read_pages(spark, FormFeedFiles(), str(books), pages_per_task=10)
    assert rows.rdd.getNumPartitions() == 21
    found = {(Path(r["path"]).name, r["page"]): r["text"] for r in rows.collect()}
    assert len(found) == 201 and found["large.txt", 123] == "page 123\n é 123" and found["small.txt", 1] == "only"
    name = next(r["path"] for r in rows.select("path").distinct().collect() if "small" in r["path"])
    assert rows.filter(F.col("path") == name).count() == 1
    blocks = read_pages(spark, FormFeedFiles(), str(books), blocks=True, name="blocks").filter("page = 7").collect()
    assert [(list(b["bbox"]), b["text"]) for b in blocks] == [([0, 0, 6, 1], "page 7"), ([0, 1, 4, 2], "é 7")]


def test_a_task_goes_to_its_pages(spark, tmp_path):
    # Each task read its file from the first page on.
    (tmp_path / "a.txt").write_bytes("".join(f"é {i}\f" for i in range(1, 301_001)).encode())
    files, name = FormFeedFiles(), str(tmp_path / "a.txt")
    first = [1, 2, 150_000, 300_999, 301_000]
    for p, at in zip(first, files.offsets(name, first), strict=True):
        files.begin(name, p, at)
        assert [(k, t) for k, t, _ in files.read(name, p, p)] == [(p, f"é {p}")]
    rows = read_pages(spark, files, str(tmp_path), pages_per_task=10, name="many")
    assert rows.rdd.getNumPartitions() <= 4096
    assert rows.filter("page > 300990 and text = concat('é ', page)").count() == 10


# ---- model calls


def test_a_killed_run_calls_each_document_once(spark, tmp_path):
    log, armed = tmp_path / "calls", tmp_path / "armed"
    armed.write_text("")

    def client(prompt, max_tokens):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if armed.exists() and prompt == "doc 7":
            raise SystemExit("killed")  # no client's failure: the task dies, and the run with it
        return prompt.upper()

    docs = spark.createDataFrame([(i, f"doc {i % 12}") for i in range(40)] + [(99, None), (98, " \n")], "doc_id long, text string")
    store = str(tmp_path / "store")
    run = lambda: completions.complete_once(docs, client, store, slices=12)
    with pytest.raises(Exception):  # noqa: B017, PT011
        run()
    kept = spark.read.schema(completions.RESULTS).parquet(f"{store}/*").count() if completions.has_results(spark, store) else 0
    before = log.read_text().split("\n")[:-1]
    armed.unlink()
    found = {r["doc_id"]: (r["raw"], r["error"]) for r in run().collect()}
    assert found == {**{i: (f"DOC {i % 12}", None) for i in range(40)}, 99: (None, "empty_text"), 98: (None, "empty_text")}
    after = log.read_text().split("\n")[len(before) : -1]
    # What was kept is not called again; the rest is, each once.
    assert len(after) == len(set(after)) == 12 - kept
    calls = len(log.read_text())
    run().collect()
    assert len(log.read_text()) == calls


def test_retries_are_bounded_and_prompts_shortened(spark, tmp_path):
    log = tmp_path / "calls"

    def client(prompt, max_tokens):
        with open(log, "a") as f:
            f.write(f"{prompt[:5]} {len(prompt)} {max_tokens}\n")
        if prompt.startswith("flaky") and log.read_text().count("flaky") < 3:
            raise TimeoutError("slow")
        if prompt.startswith("never"):
            raise TimeoutError("slow")
        if prompt.startswith("wrong"):
            raise completions.Refused("bad")
        if len(prompt) > 2500:
            raise ValueError("n_keep 9 >= n_ctx 8")
        return "ok"

    rows = [(1, "flaky"), (2, "never"), (3, "wrong"), (4, "large " * 700), (5, "fine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    run = lambda: {r["doc_id"]: tuple(r)[1:] for r in completions.complete_once(docs, client, str(tmp_path / "store"), slices=3, pause=0.01, max_tokens=100).collect()}
    found = run()
    assert found[1] == ("ok", None, 3, False) and found[2] == (None, "TimeoutError: slow", 3, False) and found[3] == (None, "Refused: bad", 1, False)
    assert found[4] == ("ok", None, 2, True) and found[5] == ("ok", None, 1, False)
    assert "large 4200 100" in log.read_text().replace(" 4199 ", " 4200 ")
    assert log.read_text().count(" 50\n") == 1
    again = run()  # only what failed for now is tried again
    assert again == found and log.read_text().count("never") == 6 and log.read_text().count("wrong") == 1


# ---- search


def test_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(1)
    letters = ["a", "b", "A", "%", "_", "\\", "ب", "ت", "é", " ", "ß", "😀"]
    text = lambda n: None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    rows = [(i, text(9), text(5), f"{text(3)}.pdf") for i in range(150)] + [(3, "twin", None, "t.pdf"), (500, None, None, None)]
    df = spark.createDataFrame(rows, "id long, client string, ref string, file_name string").repartition(3)
    path = str(tmp_path / "index")
    search_index.build(df, path)
    asked = ["", "a", "ab", "%_", "بت", "aba", "%_b", "b%a", ".pdf", ".PD", "twin", "zzz", "\\", "tت", "n" * 50, "😀a", "ببب"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    want = {q: sorted(r["id"] for r in registry.search(df, q).collect()) for q in asked}
    for q in asked[:17]:
        assert sorted(r["id"] for r in search_index.search(spark, path, q).collect()) == want[q], q
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)] + [(-1, None)], "query_id long, query string")
    found = {}
    for r in search_index.search_all(spark, path, queries).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    assert found == {i: set(want[q]) for i, q in enumerate(asked) if want[q]}


def test_index_reads_postings_of_one_gram(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit("client "), F.hex(F.xxhash64("id"))).alias("client"), F.lit(None).cast("string").alias("ref"), F.lit("a.pdf").alias("file_name"))
    search_index.build(df, str(tmp_path / "i"))
    some = df.filter("id = 77").first()["client"]
    found = search_index.search(spark, str(tmp_path / "i"), some[-6:])
    assert 77 in [r["id"] for r in found.collect()]
    assert "PushedFilters: [In(id" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(id" in found._jdf.queryExecution().executedPlan().toString()


# ---- listing


def test_pages_of_the_listing(spark, tmp_path):
    rng = random.Random(4)
    day = datetime(2024, 1, 1)
    rows = [(rng.choice([None, i, i]), rng.choice([None, day, day + timedelta(days=rng.randrange(5))]), rng.choice(["x", "valide", "En cours"])) for i in range(95)]
    df = spark.createDataFrame(rows, "id long, date timestamp, status string").withColumn("file_data", F.lit(b"x"))
    path = str(tmp_path / "listing")
    paging.write_listing(df, path, 10, record=None)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or day).timestamp(), r[0] is None, -(r[0] or 0)))
    want = [(i, d, registry_status(s)) for i, d, s in order]
    for size in (1, 7, 10, 40, 200):
        got = [tuple(r)[:3] for k in range(-(-95 // size)) for r in paging.page(spark, path, k, size, 10).collect()] if size > 1 else [tuple(paging.page(spark, path, 42, 1, 10).first())[:3]]
        assert [g[:2] for g in got] == [w[:2] for w in (want if size > 1 else [want[42]])]
    plan = paging.page(spark, path, 3, 10, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(part#\d+L?\), \(part#\d+L? >= 3\), \(part#\d+L? <= 3\)\]", plan)
    for at in (0, 9, 10, 44, 93):
        i, d, _ = want[at]
        behind = [w for w in want if (w[1] is None, -(w[1] or day).timestamp(), w[0] is None, -(w[0] or 0)) > (d is None, -(d or day).timestamp(), i is None, -(i or 0))]
        if i is not None:
            assert [tuple(r)[:2] for r in paging.page_after(spark, path, d, i, 12, 10).collect()] == [w[:2] for w in behind[:12]]


def registry_status(s):
    return {"x": "Anomalie", "valide": "Valide"}.get(s, s)


# ---- counts


def test_all_pages_are_one_scan(spark, tmp_path):
    rows = spark.range(500).select("id", F.lit(datetime(2020, 1, 1)).alias("date"), F.lit("Valide").alias("status"))
    paging.write_listing(rows, str(tmp_path), 40, record=None)
    found = paging.pages(spark, str(tmp_path), 7)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["page"]: r["n"] for r in found.groupBy("page").agg(F.count("*").alias("n")).collect()} == {k: 7 if k < 71 else 3 for k in range(72)}
    assert [tuple(r) for r in found.filter("page = 3").select("id", "place").orderBy("place").collect()] == [(r["id"], r["place"]) for r in paging.page(spark, str(tmp_path), 3, 7, 40).collect()]


def test_counts_follow_changes_in_any_order(spark, tmp_path):
    arrivals._with_rocks(spark)
    rng = random.Random(6)
    changes = [(i, n, rng.choice(["insert", "update", "delete", None]), rng.choice(["Valide", "valide", "En cours", "x", None])) for i in range(30) for n in range(rng.randrange(1, 5))]
    rng.shuffle(changes)
    changes += [changes[3], changes[7], (None, 1, "insert", "Valide"), (1, None, "insert", "Valide")]
    seen = []
    for k in range(3):
        part = changes[k * len(changes) // 3 : (k + 1) * len(changes) // 3]
        seen += part
        spark.createDataFrame(part, counts.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(counts.CHANGES).parquet(str(tmp_path / "in"))
        counts.kept_counts(stream, str(tmp_path / "counts"), str(tmp_path / "check")).awaitTermination()
        last = {}
        for i, n, op, status in seen:
            if i is not None and n is not None and (i not in last or n > last[i][0]):
                last[i] = (n, None if op == "delete" else registry_status(status) if status else "Anomalie")
        want = {}
        for _, status in last.values():
            if status:
                want[status] = want.get(status, 0) + 1
        assert {r["status"]: r["n"] for r in counts.current(spark, str(tmp_path / "counts")).collect()} == want


def test_counts_are_kept_without_python_and_over_many_batches(spark, tmp_path, monkeypatch):
    """The log of last changes is written anew now and then; a batch that runs again changes nothing."""
    monkeypatch.setattr(counts, "WHOLE_EVERY", 3)
    rng = random.Random(9)
    seen, best = [], {}
    run = lambda: counts.kept_counts(spark.readStream.schema(counts.CHANGES).parquet(str(tmp_path / "in")), str(tmp_path / "counts"), str(tmp_path / "check")).awaitTermination()
    for k in range(8):
        part = [(rng.randrange(12), rng.randrange(6), rng.choice(["insert", "delete", None, "DELETE"]), rng.choice(["Valide", "En cours", "x", None])) for _ in range(15)]
        seen += part
        spark.createDataFrame(part, counts.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        if k in (3, 4):
            for name in (f"{k}", f".{k}.crc"):
                (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
            run()
        for i, n, op, status in seen:
            gone = (op or "").lower() == "delete"
            best[i] = max(best.get(i, (-1, False, "")), (n, gone, "" if gone else registry_status(status) if status else "Anomalie"))
        want = {}
        for _, gone, status in best.values():
            if not gone:
                want[status] = want.get(status, 0) + 1
        assert {r["status"]: r["n"] for r in counts.current(spark, str(tmp_path / "counts")).collect()} == want
    assert len(list((tmp_path / "counts" / "last").iterdir())) <= 4
    rows = counts.taken(spark.createDataFrame(seen, counts.CHANGES))
    plan = counts.deltas(counts.renewed(rows, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- cut points and sinks


def plain_cuts(dark, band, radius, gap):
    cuts, target = [0], band
    while target < len(dark):
        first, last = max(cuts[-1] + 1, target - radius), min(len(dark) - 1, target + radius)
        at = min(range(first, last + 1), key=lambda y: dark[y])
        if at - cuts[-1] >= gap:
            cuts.append(at)
            target = at + band
        else:
            target += band
    return [*cuts, len(dark)]


def test_cut_points(spark):
    rng = random.Random(8)
    pages = {k: [rng.randrange(4) for _ in range(n)] for k, n in enumerate((1, 5, 49, 50, 51, 333, 700))}
    df = spark.createDataFrame([(k, y, d) for k, rows in pages.items() for y, d in enumerate(rows) if d or y == len(rows) - 1], "doc_id int, row int, darkness int").repartition(3)
    for band, radius, gap in ((50, 8, 20), (50, 8, 47), (20, 10, 10), (30, 0, 30)):
        found = {r["doc_id"]: list(r["cuts"]) for r in ocr.cut_points(df, band=band, radius=radius, gap=gap).collect()}
        assert found == {k: plain_cuts(rows, band, radius, gap) for k, rows in pages.items()}


def test_text_sink_keeps_any_text(spark, tmp_path):
    rows = [(1, "a\x1eb\x1f\x1b0\n\x1b"), (2, None), (None, "é\r\n"), (3, "")]
    documents.write_text(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"))
    found = sorted(map(tuple, documents.read_text(spark, str(tmp_path / "out")).collect()))
    assert found == sorted([("1", rows[0][1]), ("2", ""), ("", "é\r\n"), ("3", "")])


def test_classes_hold_every_pair_once(spark, tmp_path):
    clients = ["Bank One", "bank one", "BANK TWO", None, "anker"]
    rows = [(i, clients[i % 5], f"D-{i % 3}", f"file_{i}.pdf") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, client string, ref string, file_name string").repartition(3)
    asked = [*(["ank", "BANK ONE", "bank one", "", "d-1", "file_5", "e_59.pdf", "nothing", "k o"] * 4), None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    search_index.build_classes(df, str(tmp_path / "i"))
    found = search_index.search_classes(spark, str(tmp_path / "i"), queries).collect()
    of_query = {r["query_id"]: r["class_id"] for r in found if r["kind"] == "query"}
    of_row = {(r["field"], r["id"]): r["class_id"] for r in found if r["kind"] == "row"}
    matches = [(r["query_id"], r["field"], r["class_id"]) for r in found if r["kind"] == "match"]
    assert len(of_row) == 48 + 60 + 60 and len(set(matches)) == len(matches) < 200
    pairs = {(q, i) for q, k in of_query.items() for i in range(60) if any((k, c, of_row.get((c, i), -1)) in matches for c in search_index.COLUMNS)}
    search_index.build(df, str(tmp_path / "j"))
    assert pairs == {(r["query_id"], r["id"]) for r in search_index.search_all(spark, str(tmp_path / "j"), queries).collect()}
    assert pairs == {(k, r["id"]) for q, text in enumerate(asked[:9]) for r in registry.search(df, text).collect() for k in range(q, 36, 9)}


def test_pairs_are_whole_and_come_once(spark, tmp_path):
    """All pairs of equal queries and equal texts, also where several columns of a row contain a query."""
    clients = ["Bank One", "bank one", "BANK TWO", None, "file d-1"]
    rows = [(i, clients[i % 5], f"D-{i % 3}" if i % 7 else None, f"file_{i}.pdf") for i in range(60)]
    df = spark.createDataFrame([*rows, (None, "bank", "D-1", "f")], "id long, client string, ref string, file_name string").repartition(3)
    asked = [*(["ank", "BANK ONE", "bank one", "", "d", "d-1", "file", "e_59.pdf", "nothing", "k o"] * 3), None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    search_index.build_classes(df, str(tmp_path / "i"))
    found = sorted((r["query_id"], r["id"]) for r in search_index.search_pairs(spark, str(tmp_path / "i"), queries).collect())
    assert found == sorted((q, r[0]) for q, s in enumerate(asked) if s is not None for r in rows if any(s.lower() in (x or "").lower() for x in r[1:]))


def test_search_query_gives_pairs(spark):
    assert outside.registry_search_index(spark, "/root/testdata/sf0.001").columns == ["query_id", "id"]


def test_long_query_meets_long_pieces(spark, tmp_path):
    """A piece of three digits stands in a share of all rows, one of six hardly in any."""
    df = spark.range(20_000).select("id", F.lpad(F.col("id").cast("string"), 9, "0").alias("client"), F.lit(None).cast("string").alias("ref"), F.lit("a").alias("file_name"))
    search_index.build(df, str(tmp_path / "i"))
    counts = spark.read.parquet(str(tmp_path / "i" / "counts"))
    asked = spark.createDataFrame([("000012345",)], "q string").select(F.explode(search_index.pieces(F.col("q"))).alias("gram"))
    assert asked.join(counts, "gram").agg(F.min("n")).first()[0] <= 10
