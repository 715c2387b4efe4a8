"""From a judgment's text, with or without a model's reply, to its normalized record.

Everything about a document is computed inside its row: there is no shuffle, and Spark reads
the text once. Facts that several fields need are columns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import amounts as A
from docketry.functions import facts as X
from docketry.functions import lexicon as L
from docketry.functions import text as T
from docketry.operators import schema as S


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def empty_record() -> Column:
    return F.struct(*(_null(v).alias(k) if k != "parties" else F.struct(_null("string").alias("demandeur"), _null("string").alias("defendeur")).alias(k) for k, v in S.FIELDS.items()))


def parse_model_reply(raw: Column) -> Column:
    """The record in a model's reply: fences dropped, first `{` to last `}`; null if that is not JSON."""
    body = F.regexp_replace(raw, "(?i)```(?:json)?", "")
    body = T.filled(F.regexp_extract(body, r"(?s)(\{.*\})", 1))
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, S.RECORD))


def normalize_record(r: Column) -> Column:
    """Null words, masked parties, values outside the enumerations and blank lists become null; formats are settled."""
    words = {k: T.nullable(r[k]) for k, v in S.FIELDS.items() if v == "string"}
    party = lambda k: (v := T.nullable(r["parties"][k]), F.when(~T.is_masked_party(v), v))[1]
    references = F.transform(F.filter(r["references_juridiques"], lambda x: T.nullable(x).isNotNull()), T.strip)
    justified = words["decision_justification"]
    fields = words | {
        "parties": F.struct(party("demandeur").alias("demandeur"), party("defendeur").alias("defendeur")),
        "references_juridiques": F.when(F.size(references) > 0, references),
        "montants_fixes": r["montants_fixes"],
        "montants_variables": r["montants_variables"],
        "decision": T.gate(words["decision"], L.DECISIONS),
        "type_jugement": T.gate(words["type_jugement"], L.JUDGMENT_TYPES),
        "role_banque": T.gate(words["role_banque"], L.ROLES),
        "decision_justification": F.when(X.starts_with_marker(justified), justified),
        "explication_montant": F.coalesce(words["explication_montant"], words["montant_justification"]),
        "montant_justification": F.coalesce(words["montant_justification"], words["explication_montant"]),
        "numero_dossier": X.normalize_case_number(words["numero_dossier"]),
        "date_decision": X.normalize_date(words["date_decision"]),
    }
    return F.struct(*(fields[k].alias(k) for k in S.FIELDS))


def applicable_amounts(text: Column, kind: Column, role: Column) -> Column:
    """struct<fixed, variable, millimes, total, explanation>: what the ruling awards the bank; null if nothing.

    A reversal awards nothing. The bank must be meant: named before the list or at its head,
    or named anywhere with the list's plaintiff being a bank, or the plaintiff of an original
    judgment. Without a fixed amount the variable ones do not count either.
    """
    reason = F.when(kind == "original", L.FIXED_REASON_ORIGINAL).otherwise(L.FIXED_REASON_CONFIRMED)

    def fixed_item(label: Column, written: Column, millimes: Column) -> Column:
        return F.struct(
            label.alias("libelle_original"), written.alias("valeur_originale"), millimes.alias("valeur_millimes"),
            F.lit(True).alias("accorde_banque"), F.lit(True).alias("fixe"), F.lit(True).alias("include_dans_total"),
            reason.alias("raison_inclusion_exclusion"),
        )

    def is_meant(block: Column) -> Column:
        about = lambda c: X.mentions_bank(c) | (X.mentions_bank(text) & T.has(c, L.PLAINTIFF_BANK)) | ((kind == "original") & (role == "demandeur"))
        return F.coalesce(T.let(F.concat_ws("\n", block["prefix"], F.substring(block["items"], 1, 500)), about), F.lit(False))

    def read(block: Column) -> Column:
        recovered = F.when(T.has(block["items"], L.DELAY_INTEREST), A.recovered_interest(block["grounds"]))
        return F.struct(A.classify_items(A.numbered_items(block["items"])).alias("items"), T.let(recovered, lambda x: F.struct(x.alias("written"), A.parse_millimes(x).alias("millimes"))).alias("recovered"))

    def split(x: Column) -> Column:
        fixed = F.transform(F.filter(x["items"], lambda i: i["is_fixed"]), lambda i: fixed_item(i["label"], i["written"], i["millimes"]))
        variable = F.transform(
            F.filter(x["items"], lambda i: i["is_variable"]),
            lambda i: F.struct(i["label"].alias("libelle_original"), i["label"].alias("formule_originale"), F.lit(L.VARIABLE_REASON).alias("raison_non_calculable")),
        )
        return F.struct(fixed.alias("fixed"), variable.alias("variable"), x["recovered"].alias("recovered"))

    def recover(x: Column) -> Column:
        value = x["recovered"]["millimes"]
        fresh = value.isNotNull() & ~F.exists(x["fixed"], lambda i: i["valeur_millimes"] == value)
        extra = F.array(fixed_item(F.lit(L.RECOVERED_LABEL), F.concat(x["recovered"]["written"], F.lit(" د")), value))
        return F.struct(F.when(fresh, F.concat(x["fixed"], extra)).otherwise(x["fixed"]).alias("fixed"), x["variable"].alias("variable"))

    def add_up(x: Column) -> Column:
        total = F.aggregate(x["fixed"], F.lit(0).cast("long"), lambda s, i: s + i["valeur_millimes"])
        return F.struct(x["fixed"].alias("fixed"), x["variable"].alias("variable"), total.alias("millimes"), A.format_millimes(total).alias("total"))

    def explain(x: Column) -> Column:
        details = F.array_join(F.transform(x["fixed"], lambda i: F.concat(i["valeur_originale"], F.lit(" ("), i["libelle_original"], F.lit(")"))), " + ")
        explanation = F.concat(
            F.lit("نوع الحكم: "), F.coalesce(kind, F.lit("غير محدد")), F.lit(". "),
            F.when(kind == "original", L.LIST_SOURCE_ORIGINAL).otherwise(L.LIST_SOURCE_CONFIRMED),
            F.lit(f"المبالغ الثابتة المحتسبة لفائدة {L.BANK_NAME} هي: "), details,
            F.lit(". المجموع الثابت هو "), x["total"], F.lit("."),
            F.when(F.size(x["variable"]) > 0, L.VARIABLE_EXCLUDED).otherwise(""),
        )
        whole = F.struct(*(x[k].alias(k) for k in ("fixed", "variable", "millimes", "total")), explanation.alias("explanation"))
        return F.when(F.size(x["fixed"]) > 0, whole)

    def award(block: Column) -> Column:
        steps = block
        for step in (read, split, recover, add_up, explain):
            steps = T.let(steps, step)
        return F.when(block.isNotNull() & is_meant(block), steps)

    return T.let(F.when(F.coalesce(kind != "infirmatif", F.lit(True)), A.amount_list(text)), award)


def nearest_preceding(left: DataFrame, right: DataFrame, key: str, reach: int) -> DataFrame:
    """Backward as-of join within a tolerance: each left span with the last right span of its key that lies
    wholly inside the `reach` characters before it.

    left and right hold key, start, stop, value. Spans are cut into blocks of `reach`
    characters, so the join is an equality on key and block: a span meets only its own and the
    next block, and a key with many spans is spread over its blocks.
    """
    block = lambda c: F.floor(F.col(c) / reach)
    l = left.select(key, F.col("start").alias("l_start"), F.col("value").alias("l_value"), block("start").alias("block"))  # noqa: E741
    r = right.select(F.col(key), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), F.explode(F.array(block("start"), block("start") + 1)).alias("block"))
    met = l.join(r, [key, "block"]).filter((F.col("r_stop") <= F.col("l_start")) & (F.col("r_start") >= F.col("l_start") - reach))
    return met.groupBy(key, "l_start", "l_value").agg(F.max("r_start").alias("r_start"))


AMOUNT_PATTERN = r"\d{1,3}(?:\.\d{3})+,\d{3}"


#: As AMOUNT_PATTERN, which has no other digits than these without (?U).
AMOUNT = r"[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{3}"


def nearest_bank_amount(text: Column) -> Column:
    """The amount that follows the bank's name most closely, within reach; of equals the first.

    The text is cut at the mentions. The last mention before an amount is the nearest one, so only
    the first amount between a mention and the next one counts; no bank's name holds a digit.
    """

    def walked(mark: Column) -> Column:
        # At odd places a mention, behind it what follows up to the next one.
        pieces = F.split(F.regexp_replace(text, F.lit(f"(?U){L.BANK}"), F.concat(mark, F.lit("$0"), mark)), mark, -1)
        return T.let(pieces, nearest)

    def nearest(pieces: Column) -> Column:
        def behind(bank: Column, i: Column) -> Column:
            follows = F.get(pieces, i + 1)
            return F.when((i % 2 == 1) & (F.regexp_instr(follows, F.lit(AMOUNT)) > 0), F.struct((F.length(bank) + F.regexp_instr(follows, F.lit(AMOUNT)) - 1).alias("distance"), i.alias("i"), F.regexp_extract(follows, AMOUNT, 0).alias("value")))

        return F.array_min(F.filter(F.transform(pieces, behind), lambda x: x["distance"] <= L.AMOUNT_REACH))["value"]

    best = T.let(T.absent_mark(text), walked)
    return F.when(X.mentions_bank(text) & text.rlike(AMOUNT_PATTERN), F.concat(best, F.lit(f" {L.DINAR}")))


def summary(text: Column, tribunal: Column, date: Column, amount: Column) -> Column:
    """Sentences on what the text mentions; null if none applies."""
    from_court = F.concat(F.lit("صدر الحكم"), F.coalesce(F.concat(F.lit(" عن "), tribunal), F.lit("")), F.coalesce(F.concat(F.lit(" بتاريخ "), date), F.lit("")), F.lit("."))
    debt = F.concat(F.lit(f"ورد بالحكم أن ديون الشركة تشمل مديونية لفائدة {L.BANK_NAME}"), F.coalesce(F.concat(F.lit(" قدرها "), amount), F.lit("")), F.lit("."))
    (trustee, estate), appointed = L.SUMMARY_TRUSTEE
    said = F.concat_ws(
        " ",
        F.when(tribunal.isNotNull() | date.isNotNull(), from_court),
        *(F.when(text.contains(word), F.lit(sentence)) for word, sentence in (L.SUMMARY_BANKRUPTCY, L.SUMMARY_2019)),
        F.when(X.mentions_bank(text), debt),
        F.when(text.contains(L.SUMMARY_SOCIAL_FUND[0]), F.lit(L.SUMMARY_SOCIAL_FUND[1])),
        F.when(text.contains(trustee) & text.contains(estate), F.lit(appointed)),
        F.when(text.contains(L.SUMMARY_ADVANCE[0]), F.lit(L.SUMMARY_ADVANCE[1])),
    )
    return T.filled(said)


def strengthen(docs: DataFrame, text: str = "text", record: str | None = None) -> DataFrame:
    """docs with `extraction`: a model's record (an all-null one without it) completed from the text.

    Court, date, type, role, case number, decision and parties fill gaps; final references, the
    operative part and applicable amounts override; the nearest amount fills a missing total;
    a short summary is replaced. A null text completes nothing.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    given = F.coalesce(F.col(record), empty_record()) if record else empty_record()
    keep = [F.col(f"`{c}`") for c in docs.columns]
    staged = docs.select(*keep, given.alias("_r"), t.alias("_t"), X.operative_part(t).alias("_operative"), X.bank_role(t).alias("_role_text"))
    r, operative = F.col("_r"), F.col("_operative")
    filled = lambda k: F.nullif(r[k], F.lit(""))
    staged = staged.select(
        "*",
        F.coalesce(filled("type_jugement"), X.judgment_type(F.col("_t"), operative)).alias("_type"),
        F.coalesce(filled("role_banque"), F.col("_role_text")).alias("_role"),
        F.coalesce(filled("tribunal"), X.tribunal(F.col("_t"))).alias("_tribunal"),
        F.coalesce(filled("date_decision"), X.decision_date(F.col("_t"))).alias("_date"),
    )
    staged = staged.withColumn("_amounts", applicable_amounts(F.col("_t"), F.col("_type"), F.col("_role")))
    # The nearest amount fills a total that neither the list nor the record tells; else it is not looked for.
    staged = staged.withColumn("_nearest", F.when(F.col("_amounts").isNull() & filled("montant").isNull(), nearest_bank_amount(F.col("_t"))))
    m, role, kind = F.col("_amounts"), F.col("_role"), F.col("_type")
    amount = F.coalesce(m["total"], filled("montant"), F.col("_nearest"))
    by_nearest = m.isNull() & filled("montant").isNull() & F.col("_nearest").isNotNull()
    nearest_note = F.concat(F.lit(L.NEAREST_EXPLANATION[0]), F.col("_nearest"), F.lit(L.NEAREST_EXPLANATION[1]))
    explained = F.coalesce(m["explanation"], filled("explication_montant"), F.when(by_nearest, nearest_note))
    justified = F.coalesce(m["explanation"], filled("montant_justification"), F.when(by_nearest, nearest_note))
    advance = T.has(F.col("_t"), L.PROCEDURE_ADVANCE) & explained.isNotNull() & ~explained.contains(L.ADVANCE_NOTE)
    with_advance = F.concat(explained, F.lit(f" {L.ADVANCE_NOTE}"))
    party = lambda k, own: F.coalesce(F.nullif(r["parties"][k], F.lit("")), own)
    defendant = F.coalesce(F.when(role == "defendeur", F.lit(L.BANK_NAME)), X.defendant(F.col("_t")))
    brief = T.count_sentences(r["resume"]) < L.MIN_SUMMARY_SENTENCES
    values = {
        "tribunal": F.col("_tribunal"),
        "numero_dossier": F.coalesce(filled("numero_dossier"), X.case_number(F.col("_t"))),
        "date_decision": F.col("_date"),
        "type_jugement": kind,
        "role_banque": role,
        "parties": F.struct(party("demandeur", F.when(role == "demandeur", F.lit(L.BANK_NAME))).alias("demandeur"), party("defendeur", defendant).alias("defendeur")),
        "montants_fixes": F.coalesce(m["fixed"], r["montants_fixes"]),
        "montants_variables": F.coalesce(m["variable"], r["montants_variables"]),
        "montant": amount,
        "explication_montant": F.when(advance, with_advance).otherwise(explained),
        "montant_justification": F.when(advance, with_advance).otherwise(justified),
        "references_juridiques": F.coalesce(X.final_references(F.col("_t")), F.when(F.size(r["references_juridiques"]) > 0, r["references_juridiques"]), X.legal_references(F.col("_t"))),
        "decision": F.coalesce(filled("decision"), X.bank_decision(role, operative)),
        "decision_justification": F.coalesce(operative, r["decision_justification"]),
        "resume": F.when(brief, F.coalesce(summary(F.col("_t"), F.col("_tribunal"), F.col("_date"), amount), r["resume"])).otherwise(r["resume"]),
    }
    merged = staged.withColumn("_merged", F.struct(*(values[k].cast(v).alias(k) for k, v in S.FIELDS.items())))
    # A generator of one row: filters on other columns pass below it, those on the record stay above, so
    # that the record's expressions are neither copied into them nor computed twice.
    return merged.select(*keep, F.explode(F.array(normalize_record(F.col("_merged")))).alias("extraction"))


def decided(docs: DataFrame, decision: str, text: str = "text", record: str | None = None) -> DataFrame:
    """The rows of `strengthen` whose record has this decision. A decision follows from the bank's role and the operative part alone, so only these documents are worked out whole."""
    t = F.coalesce(F.col(text), F.lit(""))
    given = F.coalesce(F.col(record), empty_record()) if record else empty_record()
    role = F.coalesce(F.nullif(given["role_banque"], F.lit("")), X.bank_role(t))
    found = F.coalesce(F.nullif(given["decision"], F.lit("")), X.bank_decision(role, X.operative_part(t), t))
    # An outer generator: a filter on a plain column would move below the text's rendering and repeat it.
    hit = F.explode_outer(F.array(T.gate(T.nullable(found), L.DECISIONS) == decision)).alias("_hit")
    return strengthen(docs.select("*", hit).filter("_hit").drop("_hit"), text, record)
