"""Where each judgment's extraction stands, from events that come late, again and out of order.

An attempt begins with a `start` and ends with a `result`, or by itself once `limit` has passed.
Events of an attempt may arrive in any order; those of an earlier attempt than the newest change
nothing. What stands for a judgment depends on which events there are and on no order of theirs, so
a stream, a replay of it and a batch over all of them agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry.functions import lexicon as L
from docketry.functions import text as T
from docketry.operators.tables import remove_path
from docketry.streaming.uploads import epochs

EVENTS = "id long, attempt int, kind string, ts timestamp, received timestamp, service string, sufficient boolean, method string, error string"
STATES = "id long, version long, attempt int, status string, extraction_method string, error_message string"
#: The newest attempt and what is known of it; times in microseconds.
KEPT = "version long, attempt int, started long, ended long, status string, method string, error string, shown string"
NAMES = [x.split()[0] for x in KEPT.split(", ")]
LIMIT = timedelta(seconds=600)

RUNNING, DONE, FAILED = "En cours", "Valide", "Anomalie"


def ended_status(service: Column, sufficient: Column) -> Column:
    return F.when(service.eqNullSafe(F.lit("success")) & F.coalesce(sufficient, F.lit(False)), DONE).otherwise(FAILED)


def prepared(events: DataFrame) -> DataFrame:
    """events(EVENTS) as both ways take them: results with their status and message, times in microseconds.

    An event without id, attempt, kind or time, or of another kind, says nothing and is dropped.
    """
    status = ended_status(F.col("service"), F.col("sufficient"))
    said = T.truncate_error(F.coalesce(F.nullif("error", F.lit("")), F.when((status == FAILED) & F.col("service").eqNullSafe(F.lit("success")), F.lit(L.PARTIAL_MESSAGE))))
    known = F.col("id").isNotNull() & F.col("attempt").isNotNull() & F.col("ts").isNotNull()
    ended = F.col("kind") == "result"
    return events.filter(known & F.col("kind").isin("start", "result")).select(
        "id", "attempt", "received", F.unix_micros("ts").alias("at"), ended.alias("is_end"), F.when(ended, status).alias("status"),
        F.when(ended, F.coalesce("method", F.lit("failed"))).alias("method"), F.when(ended, said).alias("error"),
    )


class Retries(StatefulProcessor):
    """Keeps one row a judgment; gives a row whenever what stands for it changes."""

    def __init__(self, limit: timedelta):
        self._limit = int(limit.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getValueState("attempt", KEPT)

    def _standing(self, kept: dict, watermark: int) -> tuple[str, str, str | None]:
        """(status, method, message) of what is known once all times up to the watermark have passed."""
        over = None if kept["started"] is None else kept["started"] + self._limit
        if kept["ended"] is not None and (over is None or kept["ended"] <= over):
            return kept["status"], kept["method"], kept["error"]
        if kept["ended"] is not None or watermark >= over:
            return FAILED, "failed", L.TIMEOUT_MESSAGE
        return RUNNING, "retrying", None

    def _told(self, key: tuple, kept: dict, watermark_ms: int) -> Iterator[Row]:
        standing = self._standing(kept, watermark_ms * 1000)
        shown = repr((kept["attempt"], *standing))
        if shown != kept["shown"]:
            kept["version"] += 1
            kept["shown"] = shown
            self._kept.update(tuple(kept.values()))
            yield Row(id=key[0], version=kept["version"], attempt=kept["attempt"], status=standing[0], extraction_method=standing[1], error_message=standing[2])
        else:
            self._kept.update(tuple(kept.values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = dict(zip(NAMES, tuple(self._kept.get() or (0, *[None] * 7)), strict=True))
        for e in rows:
            if kept["attempt"] is not None and e["attempt"] < kept["attempt"]:
                continue
            if kept["attempt"] is None or e["attempt"] > kept["attempt"]:
                kept |= {"attempt": e["attempt"], "started": None, "ended": None, "status": None, "method": None, "error": None}
            if not e["is_end"]:
                if kept["started"] is None or e["at"] < kept["started"]:
                    kept["started"] = e["at"]
                    self._handle.registerTimer((e["at"] + self._limit + 999) // 1000)
                continue
            order = lambda x: (x[0], x[1], x[2], x[3] or "")
            mine, now = (e["at"], e["status"], e["method"], e["error"]), (kept["ended"], kept["status"], kept["method"], kept["error"])
            if kept["ended"] is None or order(mine) < order(now):
                kept |= dict(zip(("ended", "status", "method", "error"), mine, strict=True))
        if kept["attempt"] is not None:
            yield from self._told(key, kept, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self._kept.get()
        if kept is not None:
            passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            yield from self._told(key, dict(zip(NAMES, tuple(kept), strict=True)), passed)

    def close(self) -> None:
        pass


def states(events: DataFrame, late: str = "1 hour", limit: timedelta = LIMIT) -> DataFrame:
    """A stream of (id, version, attempt, status, extraction_method, error_message): what now stands for a judgment.

    events(EVENTS) is a stream. Time is what `received` says, so an event counts whenever it comes:
    one that is about long ago is not dropped, only one *received* more than `late` before the
    newest. An attempt without a result is given up once all events received up to its limit are in.
    Of repeated or differing results of an attempt the earliest holds, of equals the smallest. A
    judgment's highest version is the one that holds.
    """
    taken = prepared(events).withWatermark("received", late)
    return taken.groupBy("id").transformWithState(statefulProcessor=Retries(limit), outputStructType=STATES, outputMode="Update", timeMode="EventTime")


def states_at(events: DataFrame, watermark: datetime | None, limit: timedelta = LIMIT) -> DataFrame:
    """(id, attempt, status, extraction_method, error_message) by a batch over all events, as `states` has it at a watermark.

    Without a watermark no time has passed: attempts without a result are running.
    """
    rows = prepared(events)
    newest = rows.groupBy("id").agg(F.max(F.struct("attempt")).alias("x")).select("id", F.col("x.attempt").alias("attempt"))
    found = rows.join(newest, ["id", "attempt"]).groupBy("id", "attempt").agg(
        F.min(F.when(~F.col("is_end"), F.col("at"))).alias("started"),
        F.min(F.when(F.col("is_end"), F.struct("at", "status", "method", F.coalesce("error", F.lit("")).alias("error")))).alias("ended"),
    )
    now = -(2**62) if watermark is None else int(watermark.replace(tzinfo=watermark.tzinfo or timezone.utc).timestamp() * 1_000_000)
    return found.select("id", "attempt", *_standing(now, limit))


def _standing(now: int, limit: timedelta) -> list[Column]:
    """status, extraction_method and error_message of attempts (started, ended) once all times up to `now`, in microseconds, have passed."""
    over = F.col("started") + int(limit.total_seconds() * 1_000_000)
    in_time = F.col("ended").isNotNull() & (over.isNull() | (F.col("ended.at") <= over))
    given_up = F.col("ended").isNotNull() | (over <= now)
    pick = lambda result, failed, running: F.when(in_time, result).when(given_up, failed).otherwise(running)
    return [
        pick(F.col("ended.status"), F.lit(FAILED), F.lit(RUNNING)).alias("status"), pick(F.col("ended.method"), F.lit("failed"), F.lit("retrying")).alias("extraction_method"),
        pick(F.nullif("ended.error", F.lit("")), F.lit(L.TIMEOUT_MESSAGE), F.lit(None)).alias("error_message"),
    ]


def newest_attempts(events: DataFrame) -> DataFrame:
    """(id, attempt, started, ended, newest): each judgment's newest attempt and its earliest start and result, and when its newest event was received, of a stream or a table.

    All are smallest or largest values, so Spark aggregates keep them: a stream's state never leaves the JVM.
    """
    first = lambda end, *known: F.min(F.when(F.col("is_end") == end, F.struct((-F.col("attempt")).alias("older"), F.col("at"), *known)))
    rows = prepared(events).groupBy("id").agg(
        first(False).alias("s"), first(True, F.col("status"), F.col("method"), F.coalesce("error", F.lit("")).alias("error")).alias("e"), F.max(F.unix_micros("received")).alias("newest")
    )
    older = F.least("s.older", "e.older")
    return rows.select("id", (-older).alias("attempt"), F.when(F.col("s.older") == older, F.col("s.at")).alias("started"), F.when(F.col("e.older") == older, F.col("e")).alias("ended"), "newest")


def kept_states(events: DataFrame, target: str, kept: str, checkpoint: str, late: timedelta = timedelta(hours=1), limit: timedelta = LIMIT, keep: int = 3) -> StreamingQuery:
    """Append to `target` what stands for each judgment that a micro-batch of the stream has events of, and for those that are given up at its end.

    Rows are as those of `states`, whose times and rules hold, but a judgment that has events gets a
    row whether anything changed or not, and no event comes too late. Running attempts are a table
    for each micro-batch under `kept`, which plays the timers' part; beside it stands the newest
    time of receipt. A batch that is run again starts from the tables of the batch before and
    replaces its own folders; the tables of the last `keep` batches stay.
    """
    micros = lambda x: int(x.total_seconds() * 1_000_000)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = [e for e in epochs(spark, f"{kept}/clock") if e < epoch]
        begun = spark.read.schema("newest long").parquet(f"{kept}/clock/epoch={done[-1]}").first()["newest"] if done else None
        passed = lambda newest: -(2**62) if newest is None else newest - micros(late)
        standing = batch.select("id", F.lit(2 * epoch).cast("long").alias("version"), "attempt", *_standing(passed(begun), limit), (F.col("started") + micros(limit)).alias("over"), "newest")
        standing.write.mode("overwrite").parquet(f"{target}/epoch={epoch}/seen")
        seen = spark.read.schema(standing.schema).parquet(f"{target}/epoch={epoch}/seen")
        clock = seen.agg(F.max("newest").alias("newest")).first()["newest"]
        clock = max((x for x in (begun, clock) if x is not None), default=None)
        running = seen.filter(F.col("status") == RUNNING).select("id", "attempt", "over")
        if done:
            before = spark.read.schema(running.schema).parquet(f"{kept}/running/epoch={done[-1]}")
            running = running.unionByName(before.join(seen.select("id"), "id", "left_anti"))
        over = F.col("over") <= passed(clock)
        failed = (F.lit(FAILED).alias("status"), F.lit("failed").alias("extraction_method"), F.lit(L.TIMEOUT_MESSAGE).alias("error_message"))
        running.filter(over).select("id", F.lit(2 * epoch + 1).cast("long").alias("version"), "attempt", *failed).write.mode("overwrite").parquet(f"{target}/epoch={epoch}/given_up")
        running.filter(~over).write.mode("overwrite").parquet(f"{kept}/running/epoch={epoch}")
        spark.range(1).select(F.lit(clock).cast("long").alias("newest")).write.mode("overwrite").parquet(f"{kept}/clock/epoch={epoch}")
        for old in epochs(spark, f"{kept}/clock")[:-keep]:
            remove_path(spark, f"{kept}/running/epoch={old}")
            remove_path(spark, f"{kept}/clock/epoch={old}")

    return newest_attempts(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """The rows of `states` that hold: each judgment's highest version."""
    best = changes.groupBy("id").agg(F.max(F.struct("version", "attempt", "status", "extraction_method", "error_message")).alias("x"))
    return best.select("id", "x.attempt", "x.status", "x.extraction_method", "x.error_message")
