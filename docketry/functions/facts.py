"""Facts of a judgment as column expressions; null where the text does not tell."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import text as T


def mentions_bank(text: Column) -> Column:
    return T.has(text, L.MENTION)


def operative_part(text: Column) -> Column:
    """What the court ruled: from the last reasons marker, else the last ruling verb, to the closing formula."""
    marked = T.strip(F.concat(F.lit(L.REASONS_HEADING), T.after_last(text, L.REASONS)))
    ruled = T.strip(T.filled(F.regexp_extract(text, f"(?sU)^.*({L.RULED}.*)$", 1)))
    # Spark keeps the compiled pattern of a replacement, and compiles that of a split anew for every row, but for a single letter.
    tail = F.regexp_replace(F.coalesce(marked, ruled), f"(?sU)(?:{L.PARAGRAPH_END}).*", "")
    lines = F.transform(F.split(F.regexp_replace(tail, T.OTHER_LINE_BREAK, "\n"), "\n"), T.strip)
    lines = F.filter(lines, lambda x: (x != "") & ~T.has(x, rf"^(?:\d+|{L.PAGE_MARKER})$"))
    costs = "|".join(L.COSTS)

    def cut(line: Column) -> Column:
        ends = [T.filled(F.regexp_extract(line, f"(?sU)^(.*?{p})", 1)) for p in L.COSTS]
        return F.rtrim(F.coalesce(*ends), F.lit(" './|،"))

    def whole(x: Column) -> Column:
        ended = F.concat(F.slice(x["lines"], F.lit(1), F.greatest(x["at"] - 1, F.lit(0)).cast("int")), F.array(cut(F.get(x["lines"], (x["at"] - 1).cast("int")))))
        return T.filled(F.array_join(F.when(x["at"] > 0, ended).otherwise(x["lines"]), "\n"))

    located = lambda v: F.struct(v.alias("lines"), F.array_position(F.transform(v, lambda x: T.has(x, costs)), True).alias("at"))
    return T.let(T.let(lines, located), whole)


def starts_with_marker(x: Column) -> Column:
    return T.has(x, rf"^\s*(?:{L.REASONS}|{L.RULED})")


def tribunal(text: Column) -> Column:
    """The Tunis court of first instance if named at all, else the first such court within one line."""
    return F.coalesce(T.found(text, L.TUNIS_COURT), T.found(text, L.FIRST_INSTANCE.replace(r"\s", T.BLANK_IN_LINE)))


def decision_date(text: Column) -> Column:
    """DD/MM/YYYY of the first day, month name and year; not checked against the calendar."""
    names = "|".join(L.MONTHS)
    # The word's bound is looked for behind a first digit, as it holds at far more places than digits stand.
    pattern = rf"(?U)(\d(?<=\b\d)\d?)\s+({names})\s+(\d{{4}})\b"
    months = F.create_map(*(F.lit(v) for kv in L.MONTHS.items() for v in kv))

    def written(date: Column) -> Column:
        day, month, year = (F.regexp_extract(date, pattern, k) for k in (1, 2, 3))
        return F.when(date != "", F.format_string("%02d/%02d/%s", day.try_cast("int"), months[month], year))

    # Digits of all scripts match, so what is found, and not the text, is written with western ones.
    return T.let(T.western_digits(F.regexp_extract(text, pattern, 0)), written)


def case_number(text: Column) -> Column:
    return F.coalesce(*(T.found(text, lead + L.CASE_NUMBER) for lead in L.CASE_LEADS))


def normalize_case_number(x: Column) -> Column:
    pattern = r"\b(\d{3,8})[./](\d{4})\b"
    return F.when(x.rlike(pattern), F.concat_ws("/", F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2))).otherwise(x)


def normalize_date(x: Column) -> Column:
    pattern = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
    part = lambda k: F.regexp_extract(x, pattern, k)
    return F.when(x.rlike(pattern), F.concat_ws("/", F.lpad(part(3), 2, "0"), F.lpad(part(2), 2, "0"), part(1))).otherwise(x)


def judgment_type(text: Column, operative: Column) -> Column:
    """The first family of ruling verbs in the operative part, or in the last 3000 characters without one."""

    def family(ruling: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(L.RULINGS):
            out = F.when(T.has(ruling, pattern), name).otherwise(out)
        return out

    return F.coalesce(T.let(F.coalesce(operative, T.last_chars(text, 3000)), family), F.when(operative.isNotNull(), "original"))


def bank_role(text: Column) -> Column:
    """The first role whose words stand within reach of the bank's name."""
    gap = rf"[\s\S]{{0,{L.ROLE_REACH}}}?"

    # Words before the bank stand before its last mention. Whether any word stands behind a mention is asked once for all roles.
    def cued(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for role, before, after in reversed(L.ROLE_CUES):
            hit = T.has(x["to_last"], f"{before}{gap}{L.BANK}") if before else x["follows"] & T.has(text, f"{L.MENTION}{gap}{after}")
            out = F.when(hit, role).otherwise(out)
        return out

    behind = "|".join(after for _, _, after in L.ROLE_CUES if after)
    sides = F.struct(F.regexp_extract(text, f"(?sU)^.*{L.MENTION}", 0).alias("to_last"), T.has(text, f"{L.MENTION}{gap}(?:{behind})").alias("follows"))
    return T.let(sides, lambda x: F.when(x["to_last"] != "", cued(x)))


def bank_decision(role: Column, operative: Column, text: Column | None = None) -> Column:
    """Whether the bank, as plaintiff, was awarded something. With the text, role and operative part are only worked out where it has an award's word."""
    favourable = (role == "demandeur") & T.has(operative, L.FAVOURABLE)
    # A word has no blanks, so the operative part has it from the text as it stands.
    awarded = reduce(or_, (text.contains(w) for w in L.AWARDED)) if text is not None else F.lit(True)
    return F.when(awarded, F.when(favourable, "Favorable"))


def defendant(text: Column) -> Column:
    """The company named after a defendant marker, unless it is masked."""
    def named(marker: str) -> Column:
        section = F.regexp_extract(text, rf"(?U){marker}[\s:،-]*([\s\S]{{0,550}})", 1)
        company = F.element_at(F.split(T.found(section, L.COMPANY), f"(?U){L.COMPANY_END}", 2), 1)
        company = F.btrim(F.regexp_replace(company, r"(?U)\s+", " "), F.lit(" .،:-"))
        return T.let(company, lambda c: F.when((c != "") & ~T.is_masked_party(c), c))
    return F.coalesce(*(named(m) for m in L.DEFENDANT_MARKERS))


def legal_references(text: Column) -> Column:
    """Cited articles in order of first citation; one that is ever said to be of the loan contract is named so."""
    t = F.coalesce(text, F.lit(""))
    contract = r"\s+" + L.LOAN_CONTRACT.replace(" ", r"\s+")
    # One search over the text; what follows an article is part of the match and holds no other one.
    cited = F.regexp_extract_all(t, F.lit(rf"(?U){L.ARTICLE}(?:{contract})?"), F.lit(0))
    pairs = F.filter(
        F.transform(cited, lambda m: F.struct(T.western_digits(F.regexp_extract(m, r"(?U)\d+", 0)).try_cast("int").alias("n"), m.contains(L.LOAN_CONTRACT.split()[-1]).alias("c"))),
        lambda x: x["n"] > 0,
    )

    def named(found: Column) -> Column:
        of_contract = F.transform(F.filter(found, lambda x: x["c"]), lambda x: x["n"])
        numbers = F.array_distinct(F.transform(found, lambda x: x["n"]))
        suffix = lambda x: F.when(F.array_contains(x["contract"], x["n"]), F.lit(f" {L.LOAN_CONTRACT}")).otherwise("")
        pairs = F.transform(numbers, lambda n: F.struct(n.alias("n"), of_contract.alias("contract")))
        return F.transform(pairs, lambda x: F.concat(F.lit("الفصل "), x["n"].cast("string"), suffix(x)))

    return T.let(T.let(pairs, named), lambda x: F.when(F.size(x) > 0, x))


def final_references(text: Column) -> Column:
    """References of the grounds before the last ruling marker."""
    # No grounds and empty ones have no references alike.
    return T.let(F.regexp_extract(text, f"(?sU)^(.*)(?:{L.FINAL_GROUNDS})", 1), lambda grounds: legal_references(T.last_chars(grounds, L.GROUNDS_REACH)))
