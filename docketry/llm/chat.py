"""Chat formatting by perspective rotation: each participant in turn is the assistant.

Turns are put in order by a range sort, so a conversation of any length is spread over tasks;
it is rendered in parts of `part_turns` turns. An ordinary conversation is one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import materialise

END = "<|end|>\n"
#: Parts of a conversation, of `part_turns` turns, that one task joins with its participants.
TASK_PARTS = 256


def escaped(text: Column) -> Column:
    """text without control marks: `<|` becomes `<\\|`, and `<\\` becomes `<\\\\`, so that nothing is lost."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_name(name: Column) -> Column:
    """A name that neither opens nor closes a control mark."""
    return escaped(F.replace(F.replace(name, F.lit("|\\"), F.lit("|\\\\")), F.lit("|>"), F.lit("|\\>")))


def rotate_perspectives(conversations: DataFrame, part_turns: int = 64) -> DataFrame:
    """One row for each conversation, participant and part of conversations(conv_id, turn, role, text).

    Participants are the roles other than system; a null role is the participant `unknown`, a
    null text is empty. Turns are ordered by turn, role and text, nulls first; repeated rows are
    repeated turns. Rows of a null conv_id form one conversation. A conversation of system turns
    alone has no participant and gives no rows. Other columns are ignored. conv_id may be of any
    type that can be sorted and keeps it; a turn that is no number is taken as null.

    Control marks inside texts and roles are escaped (see `escaped`), so that no text can open or
    end a turn. rendered: every turn as `<|assistant|>`, `<|system|>` or `<|user:NAME|>`, a line break, the
    text and an end mark. mask: `start:stop` of what the assistant says, end mark included, in
    characters of this part; part_offset: characters of the rendering before this part.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").try_cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    turns = turns.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", 33))
    turns = materialise(turns, "chat-turns").withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    turns = turns.join(blocks, ["conv", "block"]).withColumn("index", F.col("before") + F.col("at") - F.col("first"))
    turns = turns.select("conv", "conv_id", "index", F.floor(F.col("index") / part_turns).alias("part"), "role", "text")
    people = turns.filter("role <> 'system'").select("conv", F.col("role").alias("perspective")).distinct()
    # Parts meet participants by conversation and salt, turns by conversation and part: no task gets a whole conversation.
    pieces = materialise(turns.groupBy("conv", "part").agg(F.count("*").alias("n")), "chat-pieces")
    salts = pieces.groupBy("conv").agg((1 + F.floor(F.count("*") / TASK_PARTS)).cast("int").alias("salts"))
    people = people.join(salts, "conv").select("conv", "perspective", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    views = pieces.join(salts, "conv").select("conv", "part", F.pmod("part", "salts").cast("int").alias("salt")).join(people, ["conv", "salt"])
    views = views.select("conv", "part", "perspective")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == "system", F.lit("<|system|>\n"))
    head = head.otherwise(F.concat(F.lit("<|user:"), escaped_name(F.col("role")), F.lit("|>\n")))
    parts = (
        turns.join(views, ["conv", "part"])
        .groupBy("conv", "perspective", "part")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.array_sort(F.collect_list(F.struct("index", head.alias("head"), F.concat(escaped(F.col("text")), F.lit(END)).alias("body"), own.alias("own")))).alias("turns"),
        )
    )
    said = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("mask")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(
                t["own"],
                F.array_append(
                    s["mask"],
                    F.concat_ws(":", (s["at"] + F.length(t["head"])).cast("string"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).cast("string")),
                ),
            ).otherwise(s["mask"]).alias("mask"),
        ),
    )
    parts = parts.withColumn("said", said).select(
        "conv",
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("said.mask").cast("long").alias("n_assistant"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("rendered"),
        F.array_join("said.mask", ",").alias("mask"),
        F.col("said.at").cast("long").alias("n_chars"),
    )
    parts = materialise(parts, "chat-parts")
    above = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv", "perspective", "part", F.coalesce(F.sum("n_chars").over(above), F.lit(0)).alias("part_offset"))
    return parts.join(offsets, ["conv", "perspective", "part"]).drop("conv")


def whole_dialogues(parts: DataFrame) -> DataFrame:
    """The parts of `rotate_perspectives` put together: one row for each conversation and participant, with masks over the whole.

    For corpora whose dialogues each fit in a row; others stay in parts.
    """
    shifted = F.transform(
        F.filter(F.split("mask", ","), lambda m: m != ""),
        lambda m: F.concat_ws(":", *((F.split_part(m, F.lit(":"), F.lit(i)).cast("long") + F.col("part_offset")).cast("string") for i in (1, 2))),
    )
    rows = parts.withColumn("mask", F.array_join(shifted, ","))
    every = F.array_sort(F.collect_list(F.struct("part", "rendered", "mask")))
    return rows.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_assistant").alias("n_assistant"), every.alias("parts")).select(
        "conv_id", "perspective", "n_turns", "n_assistant",
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"),
        F.array_join(F.filter(F.transform("parts", lambda p: p["mask"]), lambda m: m != ""), ",").alias("mask"),
    )
