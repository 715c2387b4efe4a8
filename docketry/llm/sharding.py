"""Shards along a Hilbert curve over a table's metadata.

Each dimension is cut into steps of about equal numbers of rows, from exact counts over the whole
table. A cell of the grid has a place on the curve; rows are sorted by it and cut into runs of equal
numbers. A shard then holds a compact part of every dimension, so the smallest and largest value
that Parquet keeps of a file let a filter on any of them skip most files. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import fresh_name, join_skewed, materialise, running_total

#: Metadata along which documents are sharded.
DIMENSIONS = ("source", "lang", "n_chars")
#: All cells of a grid have so many bits at most: their places, 8 bytes each, are sent to every task.
MOST_CELL_BITS = 16
#: Numbers are counted by their leading bits, ten behind the first: fewer than 120,000 codes whatever the values.
CODE_BITS = 10
ZERO = 60_000
WHOLE = ("byte", "short", "integer", "long")


def number_code(value: Column) -> Column:
    """A code that ascends with a whole number and keeps its leading bits; null comes first."""
    size = F.abs(F.greatest(value.cast("long"), F.lit(-(2**63) + 1)))
    drop = F.greatest(F.length(F.bin(size)) - (CODE_BITS + 1), F.lit(0))
    code = drop * (1 << CODE_BITS) + F.call_function("shiftrightunsigned", size, drop)
    return F.when(value.isNull(), 0).otherwise(ZERO + F.when(value < 0, -code).otherwise(code)).cast("int")


def hilbert_index(at: Column, dimensions: int, bits: int) -> Column:
    """The place on the Hilbert curve of a cell, given as an array of `dimensions` numbers of `bits` bits.

    From the highest bit down, the bits of all coordinates name a corner of the current cube. The
    cube's entry corner and direction turn that into the corner's rank along the curve, and into the
    entry and direction of the part cube that is next.
    """
    n, corners = dimensions, 1 << dimensions
    turn = lambda x, k: ((x >> k) | (x << (n - k))) & (corners - 1)  # noqa: E731  to the right, by k below n
    gray = lambda w: w ^ (w >> 1)
    rank = {gray(w): w for w in range(corners)}
    enters = [0 if w == 0 else gray((w - 1) // 2 * 2) for w in range(corners)]
    ones = lambda w: (w ^ (w + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    heads = [0 if w == 0 else ones(w if w % 2 else w - 1) % n for w in range(corners)]
    table = lambda values: F.array(*(F.lit(v) for v in values))
    right = table([turn(x, (k + 1) % n) for x in range(corners) for k in range(n)])
    left = table([turn(x, (n - (k + 1) % n) % n) for x in range(corners) for k in range(n)])
    look = lambda values, i: F.get(values, i)

    def corner(level: Column) -> Column:
        found = F.lit(0)
        for i in range(n):
            found = found + F.call_function("shiftright", F.get(at, F.lit(i)), level).bitwiseAND(F.lit(1)) * (1 << i)
        return found

    def step(s: Column, level: Column) -> Column:
        turned = look(right, corner(level).bitwiseXOR(s["entry"]) * n + s["head"])
        w = look(table([rank[x] for x in range(corners)]), turned)
        entry = s["entry"].bitwiseXOR(look(left, look(table(enters), w) * n + s["head"]))
        head = (s["head"] + look(table(heads), w) + 1) % n
        return F.struct((s["place"] * corners + w).cast("long").alias("place"), entry.cast("int").alias("entry"), head.cast("int").alias("head"))

    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("entry"), F.lit(0).alias("head"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["place"])


def _steps(rows: DataFrame, column: str, kind: str, bits: int, total: int, into: str) -> DataFrame:
    """rows with `into`: the step of `column`, so that steps hold about equal numbers of rows."""
    share = lambda before: F.floor(before * (1 << bits) / total).cast("int")
    counts = rows.groupBy(column).agg(F.count("*").alias("weight"))
    if kind == "number":
        before = F.sum("weight").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
        placed = counts.select(column, share(F.coalesce(before, F.lit(0))).alias(into))
        return rows.join(F.broadcast(placed), column)
    placed = running_total(materialise(counts, "shard-values"), [column], "weight", into="rows_before")
    placed = materialise(placed.select(column, "weight", share(F.col("rows_before")).alias(into)), "shard-steps")
    return join_skewed(rows, placed, column, "weight")


def hilbert_shards(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = 5, key: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, place, shard, slot) for each row of docs(doc_id, text, dimensions).

    size is the text's UTF-8 bytes and one; a null text has none and counts as empty. Rows ascend by
    their place on the curve, then by size, crc32 and doc_id, so equal texts of equal metadata stand
    together; rows equal in all of these are dealt in any order. Shards are runs whose numbers of
    rows differ by one at most; slot counts from 0 inside a shard. Whole numbers are a dimension by
    value, anything else by its text's bytes; a null comes first. Other columns are ignored, but for
    `key`, which is returned if named. No rows, no shards.
    """
    if len(dimensions) * bits > MOST_CELL_BITS:
        raise ValueError(f"a grid of {len(dimensions)} dimensions of {bits} bits has more than 2^{MOST_CELL_BITS} cells")
    kinds = ["number" if docs.schema[d].dataType.typeName() in WHOLE else "text" for d in dimensions]
    codes = [
        number_code(F.col(f"`{d}`")) if k == "number" else F.coalesce(F.concat(F.lit("x"), F.col(f"`{d}`").cast("string")), F.lit(""))
        for d, k in zip(dimensions, kinds, strict=True)
    ]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *(c.alias(f"code_{i}") for i, c in enumerate(codes)), *([F.col(key).alias("row_key")] if key else []),
    )
    rows = materialise(rows, "shard-rows")
    total = rows.count()
    for i, kind in enumerate(kinds):
        rows = _steps(rows, f"code_{i}", kind, bits, max(total, 1), f"step_{i}")
        if kind == "text":
            rows = materialise(rows, "shard-placed")
    cell = F.lit(0)
    for i in range(len(kinds)):
        cell = cell * (1 << bits) + F.col(f"step_{i}")
    rows = rows.drop(*(f"code_{i}" for i in range(len(kinds)))).withColumn("cell", cell)
    steps = [f"step_{i}" for i in range(len(kinds))]
    cells = rows.select("cell", *steps).distinct().select("cell", hilbert_index(F.array(*steps), len(steps), bits).alias("place"))
    rows = materialise(rows.drop(*steps).join(F.broadcast(cells), "cell").drop("cell"), "shard-cells")
    ranked = running_total(rows, ["place", "size", "text_crc32", "doc_id"], into="rank")
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(((rank * {shards}) div {max(total, 1)}) * {total} + {shards - 1}) div {shards}")
    out = ["doc_id", "size", "text_crc32", "place", shard.cast("int").alias("shard"), (F.col("rank") - first).alias("slot")]
    return ranked.select(*out, *([F.col("row_key").alias(key)] if key else []))


def write_shards(docs: DataFrame, path: str, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = 5) -> None:
    """All columns of docs as Parquet under `path`/shard=N, each file a run of the curve in its order."""
    key = fresh_name(docs.columns, "shard_key")
    taken = [*docs.columns, key]
    shard, slot = fresh_name(taken, "shard"), fresh_name(taken, "slot")
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "shard-keyed")
    placed = hilbert_shards(keyed, shards, dimensions, bits, key).select(key, F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = keyed.join(placed, key).drop(key).repartitionByRange(F.col(f"`{shard}`"), F.col(f"`{slot}`")).sortWithinPartitions(f"`{shard}`", f"`{slot}`")
    rows.drop(slot).write.partitionBy(shard).parquet(path)
