"""The registry of judgments: references, status, listing, search, backfill, retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import text as T
from docketry.operators import schema as S
from docketry.operators.tables import running_total


def promoted(r: Column) -> dict[str, Column]:
    """The record's values for the registry's flat columns."""
    own = {k: r[k] for k in S.PROMOTED if k not in ("demandeur", "defendeur", "explication_montant")}
    own |= {k: r["parties"][k] for k in ("demandeur", "defendeur")}
    own["explication_montant"] = F.coalesce(r["explication_montant"], r["montant_justification"])
    return {k: own[k] for k in S.PROMOTED}


def is_sufficient(r: Column) -> Column:
    """At least three non-blank values among eight fields, each legal reference counting."""
    fields = (r["tribunal"], r["numero_dossier"], r["date_decision"], r["parties"]["demandeur"], r["parties"]["defendeur"], r["montant"], r["decision"], r["decision_justification"])
    values = F.concat(F.array(*fields), F.coalesce(r["references_juridiques"], F.expr("cast(array() as array<string>)")))
    return F.size(F.filter(values, lambda v: F.coalesce(T.strip(v) != "", F.lit(False)))) >= 3


def outcome(status: Column, r: Column) -> Column:
    """Valide for a successful and sufficient extraction, else Anomalie."""
    return F.when((status == "success") & is_sufficient(r), "Valide").otherwise("Anomalie")


def outcome_message(status: Column, r: Column) -> Column:
    return F.when(outcome(status, r) == "Anomalie", L.PARTIAL_MESSAGE)


def needs_backfill(record: Column, flat: DataFrame | None = None) -> Column:
    """A record is there, but court, case number, amount and decision are all null or empty."""
    out = record.isNotNull()
    for c in ("tribunal", "numero_dossier", "montant", "decision"):
        out = out & (F.coalesce(F.col(c), F.lit("")) == "")
    return out


def backfill(registry: DataFrame, record: str = "extraction_result") -> DataFrame:
    """The registry with the flat columns of rows in need taken from their record."""
    need = needs_backfill(F.col(record))
    return registry.withColumns({k: F.when(need, v).otherwise(F.col(k)) for k, v in promoted(F.col(record)).items()})


def backfilled(registry: DataFrame, record: str = "extraction_result") -> DataFrame:
    """One row: how many rows `backfill` fills."""
    return registry.agg(F.count_if(needs_backfill(F.col(record))).alias("backfilled"))


def prepend(registry: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in front of the listed ones, marked by is_new; each side newest first and then by id."""
    both = new.withColumn("is_new", F.lit(True)).unionByName(registry.withColumn("is_new", F.lit(False)))
    return both.orderBy(F.desc("is_new"), F.desc("date"), F.desc("id"))


def update_by_id(registry: DataFrame, changes: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """Rows of changes(id, columns) replace those columns of the registry's rows with their id, nulls included.

    Of changes that repeat an id, the last by `order` holds, a column of theirs with null first; of
    equals, or without an order, the one whose values are largest.
    """
    last = changes.groupBy("id").agg(F.max(F.struct(*([F.col(order).alias("_order")] if order else []), *columns)).alias("x")).select("id", *(F.col(f"x.{c}").alias(c) for c in columns))
    new = last.select("id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = registry.join(new, "id", "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*registry.columns)


def delete_ids(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("id"), "id", "left_anti")


def file_of(registry: DataFrame, row_id: int) -> DataFrame:
    """Name and bytes of one row's file; only these columns are read."""
    return registry.filter(F.col("id") == row_id).select("file_name", "file_data")


def files_of(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, http, file_name, file_data) for each of wanted(id): 200 with the file, 404 where there is no such row or no file."""
    found = wanted.select("id").join(registry.select("id", "file_name", "file_data"), "id", "left")
    has = F.col("file_data").isNotNull()
    return found.select("id", F.when(has, 200).otherwise(404).alias("http"), *(F.when(has, F.col(c)).alias(c) for c in ("file_name", "file_data")))


def listing(registry: DataFrame, record: str = "extraction_result") -> DataFrame:
    """All rows without their files, backfilled, status normalized, newest first and then by id."""
    rows = backfill(registry.drop("file_data"), record).withColumn("status", T.normalize_status(F.col("status")))
    return rows.orderBy(F.desc("date"), F.desc("id"))


def recent(registry: DataFrame, n: int = 5) -> DataFrame:
    """The n newest rows; Spark keeps n rows a task and merges them."""
    return registry.orderBy(F.desc("date"), F.desc("id")).limit(n)


def stats(registry: DataFrame) -> DataFrame:
    """One row: total and the counts of each normalized status."""
    status = T.normalize_status(F.col("status"))
    return registry.agg(
        F.count("*").alias("total"),
        F.count_if(status == "Valide").alias("valide"),
        F.count_if(status == "En cours").alias("en_cours"),
        F.count_if(status == "Anomalie").alias("anomalie"),
    )


def search(registry: DataFrame, query: str = "", status: str = "All", columns: tuple[str, ...] = ("client", "ref", "file_name")) -> DataFrame:
    """Rows that contain query, as it stands, in one of the columns whatever the case, and have the status."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return registry.filter(hit if status == "All" else hit & (T.normalize_status(F.col("status")) == status))


def retry_eligible(registry: DataFrame) -> DataFrame:
    return registry.filter(T.normalize_status(F.col("status")) == "Anomalie")


REF = r"^D-(\d{4})-(\d+)$"


def counters(existing: DataFrame) -> DataFrame:
    """(year, largest): the largest number among existing(ref) of each year; other references don't count."""
    rows = existing.filter(F.col("ref").startswith("D-") & F.col("ref").rlike(REF))
    year, number = F.regexp_extract("ref", REF, 1).cast("int"), F.regexp_extract("ref", REF, 2).cast("long")
    return rows.groupBy(year.alias("year")).agg(F.max(number).alias("largest"))


def allocate_refs(new: DataFrame, existing: DataFrame, year: str, order: str | list[str]) -> DataFrame:
    """new(year, order) with `ref` D-YYYY-NNNN after the largest number of existing(ref) of that year.

    Numbers follow `order` within the year, and then the rows' other columns, so that only rows
    equal in all of them can change places. Without a year there is no reference. Rows are dealt out
    by ranges of year and order and counted inside a range, so a year with most rows is not ranked
    by one task.
    """
    return number_refs(new, counters(existing), year, order)


def number_refs(new: DataFrame, largest: DataFrame, year: str, order: str | list[str]) -> DataFrame:
    """`allocate_refs` after the numbers in largest(year, largest)."""
    first = [order] if isinstance(order, str) else list(order)
    sortable = [c for c, kind in new.dtypes if c not in first and not kind.startswith(("map", "variant"))]
    rows = running_total(new, [*first, *sortable], group=year, into="_before")
    rows = rows.withColumn("_year", F.col(year).cast("int")).join(F.broadcast(largest.select(F.col("year").alias("_year"), F.col("largest").alias("_largest"))), "_year", "left")
    serial = F.coalesce("_largest", F.lit(0)) + F.col("_before") + 1
    ref = F.concat(F.lit("D-"), F.format_string("%04d", "_year"), F.lit("-"), F.format_string("%04d", serial))
    return rows.select(*new.columns, F.when(F.col("_year").isNotNull(), ref).alias("ref"))


def display_record(record: str = "extraction_result") -> Column:
    """The record if there, else one rebuilt from the flat columns, else null."""
    flat = {k: F.nullif(F.col(k), F.lit("")) for k in S.PROMOTED if k != "references_juridiques"}
    some = F.coalesce(*flat.values(), F.array_join("references_juridiques", ",")).isNotNull()
    values = {k: flat.get(k, F.lit(None)) for k in S.FIELDS} | {
        "references_juridiques": F.col("references_juridiques"),
        "parties": F.struct(flat["demandeur"].alias("demandeur"), flat["defendeur"].alias("defendeur")),
    }
    return F.coalesce(F.col(record), F.when(some, F.struct(*(values[k].cast(v).alias(k) for k, v in S.FIELDS.items()))))


def report_rows(registry: DataFrame, record: str = "extraction_result") -> DataFrame:
    """(id, position, label, value): twelve rows a judgment; null prints `null`, references as `- item` lines.

    The record has no bank and no company any more, so their rows print `null`.
    """
    r = F.col(record)
    lines = F.array_join(F.transform(r["references_juridiques"], lambda x: F.concat(F.lit("- "), x)), "\n")
    none = F.lit(None).cast("string")
    values = (
        r["tribunal"], r["numero_dossier"], r["date_decision"], r["parties"]["demandeur"], r["parties"]["defendeur"], none, none, r["montant"],
        lines, r["decision"], r["decision_justification"], r["resume"],
    )
    pairs = enumerate(zip(L.REPORT_LABELS, values, strict=True))
    rows = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(k).alias("label"), F.coalesce(v, F.lit("null")).alias("value")) for i, (k, v) in pairs))
    return registry.select("id", F.explode(rows).alias("x")).select("id", "x.*")
