"""Calls of a language model whose results are kept by content, so that a run goes on where another broke off."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.tables import child_names, path_exists, scratch_path
from docketry.sources.documents import excerpts, is_overflow_message

RESULTS = "prompt_sha256 string, raw string, error string, calls int, shortened boolean, final boolean"
LEAST_BUDGET = 1200


class Refused(Exception):
    """A client raises it for a request that no repetition makes better."""


def _call(batches: Iterator[pd.DataFrame], client: Callable[[str, int], str], tries: int, pause: float, max_tokens: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for sha, prompt, smaller in zip(batch["prompt_sha256"], batch["prompt"], batch["smaller"], strict=True):
            raw, error, calls, shortened, final = None, None, 0, False, False
            while calls < tries and not final:
                calls += 1
                try:
                    raw, error, final = client(smaller if shortened else prompt, max_tokens // 2 if shortened else max_tokens), None, True
                except Exception as e:  # noqa: BLE001  any failure of the client is the row's result
                    error = f"{type(e).__name__}: {e}"
                    if is_overflow_message(str(e)):
                        final = shortened or len(prompt) <= LEAST_BUDGET
                        shortened = not final or shortened
                    elif isinstance(e, Refused):
                        final = True
                    elif calls < tries:
                        time.sleep(pause * 2 ** (calls - 1))
            rows.append((sha, raw, error, calls, shortened, final))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULTS.split(", ")])


def complete_once(
    docs: DataFrame, client: Callable[[str, int], str], store: str, key: str = "doc_id", text: str = "text", model: str = "", budget: int = 4500, max_tokens: int = 4096,
    tries: int = 3, pause: float = 1.0, slices: int = 64,
) -> DataFrame:
    """(key, raw, error, calls, shortened) for each row of docs(key, text), by client(prompt, max_tokens) -> reply.

    A prompt is the text, or its excerpts within `budget` characters. Results lie under `store`, keyed
    by the sha256 of model, budget and prompt: equal prompts are called once, and one that has a
    result is not called again, in this run or a later one. If the client says that the context is
    too small, the call is made once more with excerpts of half the budget and half the tokens. Any
    other failure is tried up to `tries` times with growing pauses; what still fails is an error row
    and is tried again by the next run, unless the client said `Refused`. A blank text is not sent:
    its error is `empty_text`.

    Calls are made in `slices` jobs by hash, each of which keeps its results when it ends: a run that
    is killed loses those of the slice in hand. A call's reply has no bound but the client's.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    prompt = excerpts(value, budget)
    rows = docs.select(F.col(key).alias("row_key"), value.alias("text"), prompt.alias("prompt"))
    rows = rows.withColumn("prompt_sha256", F.when(F.col("prompt") != "", F.sha2(F.concat(F.lit(f"{len(model)}:{model}:{budget}:"), F.col("prompt")), 256)))
    path = scratch_path(spark, "prompts")
    slice_of = F.pmod(F.xxhash64("prompt_sha256"), F.lit(slices)).cast("int")
    todo = rows.filter(F.col("prompt_sha256").isNotNull())
    if has_results(spark, store):
        done = spark.read.schema(RESULTS).parquet(f"{store}/*").filter("final").select("prompt_sha256").distinct()
        todo = todo.join(done, "prompt_sha256", "left_anti")
    todo = todo.groupBy("prompt_sha256").agg(F.first("prompt").alias("prompt"), F.first("text").alias("text"))
    smaller = excerpts(F.col("text"), max(LEAST_BUDGET, budget // 2))
    todo.select("prompt_sha256", "prompt", smaller.alias("smaller"), slice_of.alias("slice")).write.partitionBy("slice").parquet(path)
    work = partial(_call, client=client, tries=tries, pause=pause, max_tokens=max_tokens)
    for name in child_names(spark, path):
        if name.startswith("slice="):
            part = spark.read.parquet(f"{path}/{name}").repartition(spark.sparkContext.defaultParallelism)
            part.select("prompt_sha256", "prompt", "smaller").mapInPandas(work, RESULTS).write.parquet(f"{store}/{path.rsplit('-', 1)[-1]}-{name.removeprefix('slice=')}")
    empty = F.when(F.col("prompt_sha256").isNull(), "empty_text")
    told = ["raw", "error", "calls", "shortened"]
    if not has_results(spark, store):
        none = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in RESULTS.split(", ")) if c in told and c != "error"]
        return rows.select(F.col("row_key").alias(key), none[0], empty.alias("error"), *none[1:])
    # Of several runs' results for a prompt, one that is final, else any.
    found = spark.read.schema(RESULTS).parquet(f"{store}/*").groupBy("prompt_sha256").agg(F.max(F.struct("final", *told)).alias("x")).select("prompt_sha256", *(F.col(f"x.{c}").alias(c) for c in told))
    joined = rows.select("row_key", "prompt_sha256").join(found, "prompt_sha256", "left")
    return joined.select(F.col("row_key").alias(key), "raw", F.coalesce(empty, F.col("error")).alias("error"), "calls", "shortened")


def has_results(spark, store: str) -> bool:
    return path_exists(spark, store) and any("_SUCCESS" in child_names(spark, f"{store}/{x}") for x in child_names(spark, store))
