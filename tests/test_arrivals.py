"""Streams that are replayed, restarted and broken off, and the stored registry."""

from __future__ import annotations

import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docketry.operators import registry
from docketry.plans import arrivals
from docketry.sources.store import Store
from docketry.streaming import ingest, states, uploads

DAY = datetime(2024, 1, 1)


def at(seconds):
    return DAY + timedelta(seconds=seconds)


def streamed(spark, rows, schema, folder, out, make, parts):
    """What a stream makes of rows that arrive in so many files, restarted after each."""
    target = str(out / "target")
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        make(stream, target, str(out / "check")).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(target)


# ---- the state machine of attempts


def events(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        for n in range(rng.randrange(1, 4)):
            start = rng.randrange(2000)
            some = [(k, n, "start", at(start), None, None, None, None)] if rng.random() < 0.8 else []
            for _ in range(rng.randrange(3)):
                some.append((k, n, "result", at(start + rng.randrange(1200)), rng.choice(["success", "error", None]), rng.choice([True, False, None]), rng.choice(["native", None]), rng.choice([None, "", "broken", "x" * 5000])))
            rows += [e for e in some for _ in range(rng.choice([1, 1, 2]))]
    rows += [(None, 1, "start", DAY, None, None, None, None), (1, None, "start", DAY, None, None, None, None), (1, 9, "other", DAY, None, None, None, None), (1, 9, "start", None, None, None, None, None)]
    rng.shuffle(rows)
    # Received in this order, whatever the events' own times.
    return [(*e[:4], at(10_000 + 10 * i), *e[4:]) for i, e in enumerate(rows)]


@pytest.mark.parametrize("parts", [1, 3])
def test_states_of_a_stream_equal_the_batch(spark, tmp_path, parts):
    arrivals._with_rocks(spark)
    rows = events(parts)
    # A last event moves the watermark past all but the attempts that are about the far future.
    rows += [(100, 1, "start", at(20_000), at(16_000), None, None, None, None)]
    make = lambda stream, target, check: uploads.in_epochs(states.states(stream, "1 second"), target, check)
    changes = streamed(spark, rows, states.EVENTS, tmp_path / "in", tmp_path, make, parts)
    df = spark.createDataFrame(rows, states.EVENTS)
    want = states.states_at(df, arrivals.final_watermark(df, 1))
    assert sorted(map(tuple, states.latest(changes).collect())) == sorted(map(tuple, want.collect()))
    assert {r["status"] for r in want.collect()} == {"En cours", "Valide", "Anomalie"}
    # The same events once more, in another order: nothing changes.
    before = changes.count()
    again = [(*e[:4], at(15_999), *e[5:]) for e in reversed(rows[:-1])]
    streamed(spark, again, states.EVENTS, tmp_path / "in", tmp_path, make, 1)
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "target")).count() == before


@pytest.mark.parametrize("parts", [1, 4])
def test_kept_states_equal_the_batch(spark, tmp_path, parts):
    """Of Spark's aggregates, without a Python worker: the batch's rows, after restarts, repeated events and a batch that runs again."""
    arrivals._with_rocks(spark)
    rows = [*events(parts), (100, 1, "start", at(20_000), at(16_000), None, None, None, None), (101, 1, "start", at(5), None, None, None, None, None)]
    make = lambda stream, target, check: states.kept_states(stream, target, str(tmp_path / "kept"), check, timedelta(seconds=1))

    def same(rows, changes):
        df = spark.createDataFrame(rows, states.EVENTS)
        want = states.states_at(df, arrivals.final_watermark(df, 1))
        assert sorted(map(tuple, states.latest(changes).collect())) == sorted(map(tuple, want.collect()))

    changes = streamed(spark, rows, states.EVENTS, tmp_path / "in", tmp_path, make, parts)
    same(rows, changes)
    found = sorted(map(str, changes.collect()))
    last = max(int(x.name) for x in (tmp_path / "check" / "commits").iterdir() if x.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    make(spark.readStream.schema(states.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "target"), str(tmp_path / "check")).awaitTermination()
    changes = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "target"))
    assert sorted(map(str, changes.collect())) == found
    # What comes again in another order, and an event received long before, which counts too.
    more = [(*e[:4], at(15_999), *e[5:]) for e in reversed(rows[:-1])] + [(102, 1, "result", at(1), at(1), "success", True, None, None)]
    same([*rows, *more], streamed(spark, more, states.EVENTS, tmp_path / "in", tmp_path, make, 1))
    plan = states.newest_attempts(spark.createDataFrame(rows, states.EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_an_attempt_is_given_up_and_retried(spark):
    def standing(rows, now):
        return [tuple(r)[1:] for r in states.states_at(spark.createDataFrame(rows, states.EVENTS), now).collect()]

    start, result = (7, 1, "start", at(0), at(0), None, None, None, None), (7, 1, "result", at(601), at(601), "success", True, "ocr", None)
    assert standing([start], at(599)) == [(1, "En cours", "retrying", None)]
    assert standing([start], at(600)) == standing([start, result], at(599)) == [(1, "Anomalie", "failed", "Le service d'extraction IA a depasse le delai autorise.")]
    assert standing([result], None) == [(1, "Valide", "ocr", None)]
    assert standing([start, result, (7, 2, "start", at(700), at(700), None, None, None, None)], at(700)) == [(2, "En cours", "retrying", None)]


# ---- uploads


UPLOAD = "id long, content string, received timestamp, year int"


def test_uploads_sent_again_make_no_row(spark, tmp_path):
    rows = [(1, "a", at(0), 2024), (1, "a", at(1), 2024), (2, "a", at(2), 2024), (1, "b", at(3), 2024), (None, None, at(4), 2024), (1, "a", at(5), 2024), (None, None, at(6), 2024), (2, "a", at(86_400), 2024)]
    for name, arrived in (("forever", None), ("within", "received")):
        make = lambda stream, target, check: uploads.in_epochs(uploads.once(stream, ["id"], "content", arrived, "2 days"), target, check)  # noqa: B023, E731
        found = streamed(spark, rows, UPLOAD, tmp_path / name / "in", tmp_path / name, make, 4)
        assert sorted(((r["id"], r["content"]) for r in found.collect()), key=str) == sorted([(1, "a"), (2, "a"), (1, "b"), (None, None)], key=str)


def test_uploads_are_forgotten_after_a_while(spark, tmp_path):
    rows = [(1, "a", at(0), 2024), (9, "z", at(86_400 * 4), 2024), (8, "y", at(86_400 * 8), 2024), (1, "a", at(86_400 * 9), 2024)]
    make = lambda stream, target, check: uploads.in_epochs(uploads.once(stream, ["id"], "content", "received", "2 days"), target, check)
    assert streamed(spark, rows, UPLOAD, tmp_path / "in", tmp_path, make, 4).count() == 4


def test_ingest_takes_a_document_once(spark, tmp_path):
    rows = [(1, "قضية عدد 12/2019"), (2, None), (1, "قضية عدد 12/2019"), (2, None), (1, "قضية عدد 13/2019")]
    found = streamed(spark, rows, "doc_id long, text string", tmp_path / "in", tmp_path, ingest.ingest, 5)
    assert sorted((r["doc_id"], r["extraction"]["numero_dossier"] or "") for r in found.collect()) == [(1, "12/2019"), (1, "13/2019"), (2, "")]


def check_numbers(rows, start=0):
    """Without gaps or repeats in each year."""
    by = {}
    for r in rows:
        by.setdefault(r["year"], []).append(r["ref"])
    assert all(x is None for x in by.pop(None, []))
    for year, refs in by.items():
        assert sorted(refs) == [f"D-{year:04d}-{n:04d}" for n in range(start + 1, start + len(refs) + 1)]


def test_references_after_restarts_and_failures(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "x", at(i), rng.choice([2024, 2024, 2025, None])) for i in range(120)]
    counters, broken = str(tmp_path / "counters"), []

    def number_or_fail(batch, *rest):
        if len(broken) in (1, 3):
            broken.append(1)
            raise RuntimeError("lost")
        broken.append(0)
        return registry.number_refs(batch, *rest)

    monkeypatch.setattr(uploads, "number_refs", number_or_fail)

    def make(stream, target, check):
        return uploads.register(stream, target, counters, check, "year", "id", spark.createDataFrame([(2024, 0)], uploads.COUNTERS))

    for i in range(4):
        spark.createDataFrame(rows[i * 30 : (i + 1) * 30], UPLOAD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(UPLOAD).parquet(str(tmp_path / "in"))
        try:
            make(stream, str(tmp_path / "target"), str(tmp_path / "check")).awaitTermination()
        except StreamingQueryException:
            make(stream, str(tmp_path / "target"), str(tmp_path / "check")).awaitTermination()
    assert sum(broken) == 2
    found = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "target"))
    check_numbers(found.collect())
    before = {(r["id"], r["ref"]) for r in found.collect()}
    # Broken off after the rows of the last batch, before its counters: it runs again, and numbers stay.
    last = uploads.epochs(spark, counters)[-1]
    shutil.rmtree(f"{counters}/epoch={last}")
    for f in (tmp_path / "check" / "commits").iterdir():
        if f.name.strip(".").startswith(str(last)):
            f.unlink()
    make(spark.readStream.schema(UPLOAD).parquet(str(tmp_path / "in")), str(tmp_path / "target"), str(tmp_path / "check")).awaitTermination()
    assert {(r["id"], r["ref"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "target")).collect()} == before
    assert len(uploads.epochs(spark, counters)) <= 3


def test_references_of_ties_and_large_numbers(spark):
    rows = [(2024, 5, "b"), (2024, 5, "a"), (2024, 5, "a"), (None, 1, "c"), (2023, 1, "d")]
    old = spark.createDataFrame([("D-2024-9999",), ("D-2024-12",), ("D-2024-1a",), ("X-2024-99999",), (None,)], "ref string")
    for parts in (1, 4):
        found = registry.allocate_refs(spark.createDataFrame(rows, "y int, o int, x string").repartition(parts), old, "y", "o")
        assert sorted(map(tuple, found.collect()), key=str) == sorted([(2024, 5, "a", "D-2024-10000"), (2024, 5, "a", "D-2024-10001"), (2024, 5, "b", "D-2024-10002"), (None, 1, "c", None), (2023, 1, "d", "D-2023-0001")], key=str)


# ---- the stored registry


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(path, 16)
    rows = [(i, f"s{i % 3}", None if i % 5 == 0 else i) for i in range(200)] + [(7, "twin", 0), (None, "nobody", 1)]
    store.create(spark.createDataFrame(rows, "id long, status string, n long"))
    before = files(path)
    changes = spark.createDataFrame([(7, "old", 1), (7, "new", 2), (8, None, 1), (999, "none", 1), (None, "null", 1)], "id long, status string, at int")
    touched = store.update(changes, ["status"], order="at")
    after = files(path)
    assert 1 <= len(touched) <= 3
    kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept)
    want = {(i, {7: "new", 8: None}.get(i, s) if i is not None else s, n) for i, s, n in rows}
    assert {tuple(r) for r in store.read(spark).collect()} == want and store.read(spark).count() == len(rows)
    # Taking out all rows of a bucket takes its folder away.
    gone = [r["id"] for r in spark.read.parquet(path).filter(F.col("bucket") == touched[0]).select("id").collect() if r["id"] is not None]
    told = store.delete(spark.createDataFrame([(i,) for i in [*gone, gone[0], 12345]], "id long"))
    assert sorted(map(tuple, told.collect())) == sorted([(i, 200) for i in set(gone)] + [(12345, 404)])
    assert {tuple(r) for r in store.read(spark).collect()} == {r for r in want if r[0] not in gone}
    assert all(files(path).get(f) == before[f] for f in kept if int(f.split("/")[0].split("=")[1]) != touched[0])
    store.insert(spark.createDataFrame([(gone[0], "back", 5)], "id long, status string, n long"))
    assert [tuple(r) for r in store.lookup(spark, gone[0]).collect()] == [(gone[0], "back", 5)]


def test_store_looks_into_one_bucket(spark, tmp_path):
    store = Store(str(tmp_path / "store"), 16)
    store.create(spark.range(500).withColumn("x", F.lit("y")))
    found = store.lookup(spark, 42)
    assert [r["id"] for r in found.collect()] == [42]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,42)]" in plan
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value() == 1


def test_updates_by_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    changes = spark.createDataFrame([(1, "z", 1), (1, None, 2), (2, "q", None), (2, "p", 0)], "id long, x string, at int")
    assert sorted(map(tuple, registry.update_by_id(rows, changes, ["x"], "at").collect())) == [(1, None), (2, "p")]
    assert sorted(map(tuple, registry.update_by_id(rows, changes, ["x"]).collect())) == [(1, "z"), (2, "q")]
