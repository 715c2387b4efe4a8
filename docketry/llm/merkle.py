"""A Merkle tree over a table, with a proof for every row.

Every level joins its nodes with themselves on computed sibling numbers: XOR 1 in a binary tree,
the other slots of the run otherwise. The node in slot zero then has its whole run and emits the
parent. Proofs are handed down from the root, a parent to its children at a time, so no join has
more rows to a key than a run has nodes, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import crc_remainder, materialise, running_total

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<l:string,r:string>>"


def row_digest(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values, each as its bytes' number, a colon and itself; null is a dash."""
    parts = (F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (v.cast("string") for v in values))
    return F.sha2(F.concat(*parts), 256)


def _with_siblings(nodes: DataFrame, arity: int, carried: list[str]) -> DataFrame:
    """nodes(tree, idx, digest, carried) with l and r: the digests of the run's nodes before and behind, joined."""
    idx = F.col("idx")
    slot = idx % arity
    others = [idx, idx.bitwiseXOR(F.lit(1).cast("long"))] if arity == 2 else [idx - slot + (slot + d) % arity for d in range(arity)]
    own = F.struct(*(F.col(c) for c in ("digest", *carried)))
    wanted = nodes.select("tree", "idx", F.explode(F.array(*others)).alias("other"), own.alias("own"))
    wanted = wanted.withColumn("own", F.when(F.col("other") == idx, F.col("own")))
    met = wanted.join(nodes.select("tree", F.col("idx").alias("other"), F.col("digest").alias("met")), ["tree", "other"])
    runs = met.groupBy("tree", "idx").agg(F.max("own").alias("own"), F.array_sort(F.collect_list(F.struct("other", "met"))).alias("run"))
    side = lambda keep: F.array_join(F.transform(F.filter("run", lambda x: keep(x["other"])), lambda x: x["met"]), "")
    return runs.select("tree", "idx", "own.*", side(lambda i: i < idx).alias("l"), side(lambda i: i > idx).alias("r"))


HAS_PARENT = "(idx > 0 or l <> '' or r <> '')"


def _levels(leaves: DataFrame, arity: int, carried: list[str]) -> list[DataFrame]:
    """The tables of all levels, leaves first. A tree ends at the level where it has one node."""
    levels, nodes = [], leaves
    while True:
        level = materialise(_with_siblings(nodes, arity, carried if not levels else []), f"merkle-{len(levels)}")
        levels.append(level)
        above = level.filter(HAS_PARENT)
        if above.isEmpty():
            return levels
        parent = F.sha2(F.concat("l", "digest", "r"), 256)
        nodes = above.filter(F.col("idx") % arity == 0).select("tree", (F.col("idx") / arity).cast("long").alias("idx"), parent.alias("digest"))


def _handed_down(levels: list[DataFrame], tops: DataFrame, arity: int, given: list[str], carried: list[str]) -> DataFrame:
    """The leaves with `steps`, all siblings up to the root, and what `tops`(tree, steps, given) says of their tree."""
    above = None
    for k, level in reversed(list(enumerate(levels))):
        columns = ["tree", "idx", *(["digest", *carried] if k == 0 else [])]
        ended = level.filter(f"not {HAS_PARENT}").join(tops, "tree").select(*columns, "steps", *given)
        if above is not None:
            up = above.select("tree", F.col("idx").alias("parent"), F.col("steps").alias("more"), *given)
            mine = F.array(F.struct("l", "r"))
            going = level.filter(HAS_PARENT).withColumn("parent", (F.col("idx") / arity).cast("long")).join(up, ["tree", "parent"])
            ended = going.select(*columns, F.concat(mine, "more").alias("steps"), *given).unionByName(ended)
        above = ended
    return above


def _ends(levels: list[DataFrame]) -> DataFrame:
    out = None
    for level in levels:
        ended = level.filter(f"not {HAS_PARENT}").select("tree", F.col("digest").alias("top"))
        out = ended if out is None else out.unionByName(ended)
    return out


def manifest(rows: DataFrame, order: str, group: str, digest: str, carried: tuple[str, ...] = (), arity: int = 8) -> DataFrame:
    """rows(order, group, digest, carried) as leaves of a tree for each group, whose tops are leaves of one tree.

    Leaves ascend by `order`, null first, and then by digest. While there are several nodes, every
    `arity` consecutive ones, in the last run fewer or even one, become the sha256 of their hex
    digests joined. The groups' tops, by the group's bytes, null first, do the same. Returns the
    leaves with subroot, root and steps: for each level up to the root the digests before (l) and
    behind (r). Rows that are equal in order and digest are leaves of their own; which comes first
    is not fixed, and nothing but their steps differs. No rows, no tree.
    """
    shown = list(dict.fromkeys([order, group, *carried]))
    tree = F.coalesce(F.concat(F.lit("x"), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(digest).alias("digest"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(shown)))
    first = f"c_{shown.index(order)}"
    kept = [f"c_{i}" for i in range(len(shown))]
    leaves = running_total(leaves, [first, "digest"], group="tree", into="idx")
    levels = _levels(leaves, arity, kept)
    tops = materialise(_ends(levels), "merkle-tops")
    upper = _levels(running_total(tops, ["tree"], into="idx").select(F.lit("").alias("tree"), "idx", F.col("top").alias("digest"), F.col("tree").alias("name")), arity, ["name"])
    roots = _ends(upper).select("tree", F.col("top").alias("root"), F.expr(f"cast(array() as {STEP})").alias("steps"))
    over = _handed_down(upper, roots, arity, ["root"], ["name"]).select(F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    out = _handed_down(levels, materialise(over, "merkle-over"), arity, ["subroot", "root"], kept)
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(shown)), F.col("digest").alias(digest), "subroot", "root", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest leads to with the given siblings."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["l"], at, s["r"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def verified_manifest(docs: DataFrame, changed: Column, order: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, arity: int = 8) -> DataFrame:
    """(order, leaf, subroot, root, steps, seen) of each row of docs; other columns are ignored.

    `seen` is the digest of the row as it is found later, with the text `changed`; folding it with
    the steps gives the root only if nothing changed.
    """
    rows = docs.select(*dict.fromkeys([order, group, *fields]), row_digest([F.col(c) for c in fields]).alias("leaf_digest"), changed.alias("changed_text"))
    later = row_digest([F.col("changed_text" if c == "text" else c) for c in fields])
    seen = F.when(F.col("changed_text").eqNullSafe(F.col("text")), F.col("leaf_digest")).otherwise(later)
    return manifest(rows.select(order, group, F.col("leaf_digest").alias("leaf"), seen.alias("seen")), order, group, "leaf", ("seen",), arity)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """What a later reader finds: where 3 divides the id's crc32, the text with A-Z lower-cased. A null id counts as empty."""
    return F.when(crc_remainder(doc_id, 3) == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
