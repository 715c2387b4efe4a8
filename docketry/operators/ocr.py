"""Reconciling OCR readings: words to lines, a choice of readings, lines that only another one has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import text as T

PAGE = ("doc_id", "page")


def visible_words(words: DataFrame) -> DataFrame:
    """Words with text and a confidence, the confidence also as a share, and their box where the words have one."""
    if {"left", "top", "width", "height"} <= set(words.columns):
        words = words.withColumn("bbox", F.array(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height")))
    return words.filter((T.strip(F.col("text")) != "") & (F.col("conf") >= 0)).withColumn("confidence", F.round(F.col("conf") / 100, 3))


def lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, psm, line, text): words joined while block, paragraph and line stay the same."""
    reading = Window.partitionBy(*PAGE, "psm").orderBy("idx")
    words = words.filter(T.strip(F.col("text")) != "")
    place = F.struct("block_num", "par_num", "line_num")
    fresh = F.coalesce((place != F.lag(place).over(reading)).cast("int"), F.lit(1))
    numbered = words.withColumn("line", F.sum(fresh).over(reading))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", T.strip(F.col("text")).alias("w")))), lambda x: x["w"]), " ")
    return numbered.groupBy(*PAGE, "psm", "line").agg(joined.alias("text"))


def readings(words: DataFrame) -> DataFrame:
    """(doc_id, page, psm, words, confidence): words with a confidence and their mean, 0 without any."""
    seen = (F.col("conf") >= 0) & (T.strip(F.col("text")) != "")
    return words.groupBy(*PAGE, "psm").agg(F.count_if(seen).alias("words"), F.coalesce(F.avg(F.when(seen, F.col("conf"))), F.lit(0.0)).alias("confidence"))


def weighted_confidence(bands: DataFrame) -> DataFrame:
    """(doc_id, page, words, confidence): mean confidence of readings weighted by their words, 0 without words."""
    total = F.sum("words")
    return bands.groupBy(*PAGE).agg(total.alias("words"), F.when(total > 0, F.sum(F.col("confidence") * F.col("words")) / total).otherwise(0.0).alias("confidence"))


def choose_reading(found: DataFrame, order: str = "psm") -> DataFrame:
    """The reading of each page: nearly as many words as the fullest, confidence within the band of the best,
    then the most words, the highest confidence and the first in order."""
    page = Window.partitionBy(*PAGE)
    full = found.withColumn("_most", F.max("words").over(page)).filter(F.col("words") >= L.WORDS_SHARE * F.col("_most"))
    close = full.withColumn("_best", F.max("confidence").over(page)).filter(F.col("confidence") >= F.col("_best") - L.CONFIDENCE_BAND)
    rank = F.row_number().over(page.orderBy(F.desc("words"), F.desc("confidence"), order))
    return close.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_most", "_best")


def merge_readings(found: DataFrame, chosen: DataFrame, anchor: str = L.STRUCTURED_ANCHOR) -> DataFrame:
    """(doc_id, page, position, text, supplementary): the chosen reading's lines after those that other readings
    add around anchors.

    Another reading offers the lines from one before to two after each line with an anchor, of
    equal ones the first. A line that the chosen reading also has is added only if it is an
    anchor itself. Every step is a window within a page, so pages are dealt out once.
    """
    return _merged(found.join(chosen.select(*PAGE, F.col("psm").alias("_own")), list(PAGE)), anchor)


def _merged(rows: DataFrame, anchor: str) -> DataFrame:
    page = Window.partitionBy(*PAGE)
    reading = Window.partitionBy(*PAGE, "psm").orderBy("line")
    rows = rows.select(
        *PAGE, "psm", "line", "text", (F.col("psm") == F.col("_own")).alias("own"), T.line_key(F.col("text")).alias("key"), T.has(F.col("text"), anchor).alias("anchor")
    )
    rows = rows.withColumn("near", F.max("anchor").over(reading.rowsBetween(-2, 1)))
    rows = rows.withColumn("known", F.max("own").over(Window.partitionBy(*PAGE, "key")))
    rows = rows.filter("own or (near and key <> '')")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE, "psm", "key").orderBy("line")))
    rows = rows.filter("own or (n = 1 and (anchor or not known))")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE, "own", "key").orderBy("psm", "line")))
    rows = rows.filter("own or n = 1")
    place = F.row_number().over(page.orderBy("own", "psm", "line"))
    return rows.select(*PAGE, (place - 1).alias("position"), "text", (~F.col("own")).alias("supplementary"))


def merged_lines(words: DataFrame) -> DataFrame:
    """`merge_readings` of the lines and the chosen reading of words, in one pass: words are grouped to lines once, and
    windows over a page's lines tell its readings and the choice."""
    reading = Window.partitionBy(*PAGE, "psm").orderBy("idx")
    page, whole = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE, "psm")
    shown = T.strip(F.col("text"))
    place = F.struct("block_num", "par_num", "line_num")
    words = words.filter(shown != "")
    words = words.withColumn("line", F.sum(F.coalesce((place != F.lag(place).over(reading)).cast("int"), F.lit(1))).over(reading))
    seen = F.col("conf") >= 0
    found = words.groupBy(*PAGE, "psm", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", shown.alias("w")))), lambda x: x["w"]), " ").alias("text"),
        F.count_if(seen).alias("_n"), F.coalesce(F.sum(F.when(seen, F.col("conf"))), F.lit(0.0)).alias("_sum"),
    )
    found = found.withColumns({"_words": F.sum("_n").over(whole), "_sums": F.sum("_sum").over(whole)})
    found = found.withColumn("_confidence", F.when(F.col("_words") > 0, F.col("_sums") / F.col("_words")).otherwise(0.0))
    full = F.col("_words") >= L.WORDS_SHARE * F.max("_words").over(page)
    found = found.withColumn("_full", full)
    close = F.col("_full") & (F.col("_confidence") >= F.max(F.when(F.col("_full"), F.col("_confidence"))).over(page) - L.CONFIDENCE_BAND)
    found = found.withColumn("_rank", F.when(close, F.struct("_words", "_confidence")))
    found = found.withColumn("_top", F.max("_rank").over(page))
    found = found.withColumn("_own", F.min(F.when(F.col("_rank") == F.col("_top"), F.col("psm"))).over(page))
    return _merged(found.select(*PAGE, "psm", "line", "text", "_own"), L.STRUCTURED_ANCHOR)


def page_text(merged: DataFrame) -> DataFrame:
    """(doc_id, page, text) of merged lines."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    return merged.groupBy(*PAGE).agg(T.strip(joined).alias("text"))


def islands(rows: DataFrame, by: str, at: str, gap: int = 1) -> DataFrame:
    """(by, first, last): runs of positions that are at most `gap` apart."""
    order = Window.partitionBy(by).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_island", F.sum(new).over(order)).groupBy(by, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_island")


def cut_points(rows: DataFrame, key: str = "doc_id", row: str = "row", darkness: str = "darkness", band: int = 850, radius: int = 120, gap: int = 300) -> DataFrame:
    """(key, cuts): where to cut a page image into bands of about `band` rows, near its lightest rows.

    rows(key, row, darkness) has one row for each row of pixels, from 0 on; one that is missing is
    blank, of repeated ones the darkest counts. From the last cut on, the lightest row within
    `radius` of the place a band further is the next cut, the first of equals; one less than `gap`
    behind the last is passed over and the next is sought a band further. Cuts begin with 0 and end
    with the page's height. A page is folded in its own row, whose rows its image bounds.
    """
    some = rows.filter(F.col(row).isNotNull()).groupBy(key, row).agg(F.max(F.coalesce(F.col(darkness).cast("double"), F.lit(0.0))).alias("dark"))
    # Rows in order with where each one's predecessor stands: a row is put behind its gap's blanks, none is looked up in the page.
    inked = F.array_sort(F.collect_list(F.struct(F.col(row).cast("int").alias("y"), "dark")))
    filled = lambda v: F.flatten(F.transform(v, lambda x, i: F.concat(F.array_repeat(F.lit(0.0), x["y"] - F.when(i > 0, F.get(v, i - 1)["y"]).otherwise(-1) - 1), F.array(x["dark"]))))
    pages = some.groupBy(key).agg((F.max(row) + 1).cast("int").alias("height"), inked.alias("inked"))
    # An outer generator of one row: the page is filled once, not again by every step that reads it.
    pages = pages.select(key, "height", F.explode_outer(F.array(T.let(F.filter("inked", lambda x: x["y"] >= 0), filled))).alias("line"))

    def step(s: Column, _: Column) -> Column:
        first, last = F.greatest(s["cut"] + 1, s["target"] - radius), F.least(F.col("height") - 1, s["target"] + radius)

        def chosen(window: Column) -> Column:
            at = (first + F.array_position(window, F.array_min(window)) - 1).cast("int")
            far = at - s["cut"] >= gap
            return F.struct(
                F.when(far, at).otherwise(s["cut"]).alias("cut"), F.when(far, at + band).otherwise(s["target"] + band).cast("int").alias("target"),
                F.when(far, F.array_append(s["cuts"], at)).otherwise(s["cuts"]).alias("cuts"),
            )

        return F.when((s["target"] < F.col("height")) & (first <= last), T.let(F.slice(F.col("line"), first + 1, F.greatest(last - first + 1, F.lit(0))), chosen)).otherwise(s)

    start = F.struct(F.lit(0).alias("cut"), F.lit(band).alias("target"), F.array(F.lit(0)).alias("cuts"))
    steps = F.sequence(F.lit(0), F.ceil(F.col("height") / max(1, min(gap, band))).cast("int"))
    cuts = F.concat(F.aggregate(steps, start, step)["cuts"], F.array("height"))
    return pages.select(key, cuts.alias("cuts"))
