"""Cleaning and text predicates as column expressions. A null text stays null unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketry.functions import lexicon as L

LETTER = "ء-ي"
#: A blank, under (?U), at which no line ends.
BLANK_IN_LINE = r"[\s&&[^\n\x0B\f\r\x1C-\x1E\u0085\u2028\u2029]]"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\u0085  ]"

#: Marks above and below letters, and the tatweel.
DIACRITICS = "ً-ْٰـ"
DIRECTION_MARKS = "‎‏‪-‮⁦-⁩"
#: What LINE_BREAK covers beside the newline itself.
OTHER_LINE_BREAK = r"\r\n|[\x0B\f\r\x1C-\x1E\u0085\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(x: Column) -> Column:
    """x, null if it is empty; x is computed once, where NULLIF becomes a condition on it and x again."""
    return let(x, lambda v: F.when(v != "", v))


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of numbers; two levels of about its root keep the copying linear."""
    none = F.expr("cast(array() as array<int>)")

    def running(array: Column) -> Column:
        return F.aggregate(array, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out")))["out"]

    def in_parts(v: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / wide).cast("int") - 1, F.lit(0))), lambda i: running(F.slice(v, i * wide + 1, wide)))

    def joined(inner: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), running(F.transform(inner, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)))))
        return let(ends, lambda e: F.flatten(F.transform(inner, lambda p, i: let(F.get(e, i), lambda add: F.transform(p, lambda x: x + add)))))

    return let(values, lambda v: let(in_parts(v), joined))


def absent_mark(text: Column) -> Column:
    """A mark that the text does not hold, nor any text that it is put into: U+0001, or a longer run of it than the text has, between U+0002."""
    longest = F.length(F.array_max(F.regexp_extract_all(text, F.lit("\x01+"), F.lit(0))))
    return F.when(text.contains("\x01"), F.concat(F.lit("\x02"), F.repeat(F.lit("\x01"), longest + 1), F.lit("\x02"))).otherwise("\x01")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of a pattern's matches, in code points.

    The pieces between matches are cut at a mark that replaces them: Spark keeps the compiled
    pattern of a replacement, and compiles that of a split anew for every row.
    """

    def placed(v: Column) -> Column:
        stops = prefix_sums(F.transform(v["found"], lambda m, i: F.length(F.get(v["pieces"], i)) + F.length(m)))
        return F.transform(F.arrays_zip(stops.alias("stop"), v["found"].alias("m")), lambda x: F.struct((x["stop"] - F.length(x["m"])).alias("start"), x["stop"].alias("stop"), x["m"].alias("value")))

    def cut(mark: Column) -> Column:
        return F.struct(F.split(F.regexp_replace(text, F.lit(pattern), mark), mark, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    return let(let(absent_mark(text), cut), placed)


#: What \\s covers under (?U): all code points that are white space.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.btrim(x, F.lit(BLANKS))


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where there is none or it is empty."""
    return filled(F.regexp_extract(x, f"(?U){pattern}", group))


def has(x: Column, pattern: str) -> Column:
    return x.rlike(f"(?U){pattern}")


def after_last(x: Column, pattern: str) -> Column:
    """What follows the last match, null where there is none. No match may be empty."""
    return let(from_last(x, pattern), lambda v: F.when(v != "", F.regexp_replace(v, f"(?sU)^(?:{pattern})", "")))


def before_last(x: Column, pattern: str) -> Column:
    """What precedes the last match, null where there is none. No match may be empty."""
    return let(from_last(x, pattern), lambda v: F.when(v != "", before_tail(x, v)))


def before_tail(x: Column, tail: Column) -> Column:
    """x without a text that it ends with, by bytes: to count a long text's characters costs more than a search in it."""
    return F.substring(x.cast("binary"), F.lit(1), F.octet_length(x) - F.octet_length(tail)).cast("string")


def from_last(x: Column, pattern: str) -> Column:
    """The last match and what follows it, empty where there is none: one search, from the end on."""
    return F.regexp_extract(x, f"(?sU)^.*((?:{pattern}).*)$", 1)


def last_chars(x: Column, n: int) -> Column:
    """The last n characters, or all; no more than the bytes that these can take are looked at."""
    return F.substring(F.substring(x.cast("binary"), -4 * n, 4 * n).cast("string"), -n, n)


def remove_tatweel(x: Column) -> Column:
    return F.replace(x, F.lit("ـ"), F.lit(""))


def strip_diacritics(x: Column) -> Column:
    return F.regexp_replace(x, f"[{DIACRITICS}]", "")


def rejoin_ocr_arabic(x: Column) -> Column:
    """Drop direction marks; rejoin a split article and a standing-alone waw with the word after it."""
    return _rejoined(F.regexp_replace(x, f"[{DIRECTION_MARKS}]", ""))


def _rejoined(x: Column) -> Column:
    x = F.regexp_replace(x, rf"(?U)[اأإآ]\s+ل(?=[{LETTER}])", "ال")
    return F.regexp_replace(x, rf"(?U)و(?<![{LETTER}]و)\s+(?=[{LETTER}]{{2}})", "و")


def repair_article_lists(x: Column) -> Column:
    """Misread plurals before digits, connectors between numbers, and lists broken over lines."""
    x = F.regexp_replace(x, f"(?U){L.MISREAD_ARTICLES}", L.ARTICLES)
    # Matches begin with the digit before them, which is put back: to look back from every place costs more. The digit behind is left to the next match.
    x = F.regexp_replace(x, r"(?U)(\d)\s*[يى]\s*(?=\d)", "$1 و")
    x = F.regexp_replace(x, r"(?U)(\d)\s*و\s*(?=\d)", "$1 و")
    # Inside a list every blank run becomes one blank: the list's head, then each connector.
    x = F.regexp_replace(x, rf"(?U)({L.ARTICLES})\s+(?=\d+\s+[ويى]\s*\d)", "$1 ")
    return F.regexp_replace(x, r"(?U)(\d)\s+و\s*(?=\d)", "$1 و")


def clean_whitespace(x: Column) -> Column:
    """Runs of blanks, then runs of line breaks, then blanks before breaks, then the ends, in this order."""
    x = F.regexp_replace(x, "\t[ \t]*| [ \t]+", " ")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(x, " +\n", "\n"))


def remove_page_markers(x: Column) -> Column:
    return F.regexp_replace(x, f"(?U){L.PAGE_MARKER}", "")


def clean_text(x: Column, keep_page_markers: bool = False) -> Column:
    x = x if keep_page_markers else remove_page_markers(x)
    return clean_whitespace(repair_article_lists(_rejoined(_unmarked(x))))


def _unmarked(x: Column) -> Column:
    """Without diacritics, tatweel and direction marks. All but the tatweel lie in one range, which is one comparison a character."""
    return let(remove_tatweel(x), lambda v: F.when(v.rlike("[\\u064B-\\u2069]"), F.regexp_replace(v, f"[{DIACRITICS}{DIRECTION_MARKS}]+", "")).otherwise(v))


def western_digits(x: Column) -> Column:
    """Arabic-Indic digits as ASCII, one for one."""
    # Ten searches for bytes: a translation looks up every character of the text in a table of strings.
    def mapped(v: Column) -> Column:
        for arabic, western in zip(L.ARABIC_DIGITS, L.WESTERN_DIGITS, strict=True):
            v = F.replace(v, F.lit(arabic), F.lit(western))
        return v

    # A range is one comparison a character, ten listed digits are ten.
    return let(x, lambda v: F.when(v.rlike(f"[{L.ARABIC_DIGITS[0]}-{L.ARABIC_DIGITS[-1]}]"), mapped(v)).otherwise(v))


def line_key(x: Column) -> Column:
    """A line without anything but letters and digits, for comparison."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}]+", "")


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(x: Column) -> Column:
    """Compatibility composition; Spark has no such function, so texts beyond ASCII, and only they, take an Arrow UDF."""
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def compact(x: Column) -> Column:
    """Without any blank; null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")


def corruption_metrics(x: Column) -> Column:
    """Of a compact text: characters, those in runs of four or more, tokens, tokens with a run of three, Arabic doubles."""
    tokens = F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.struct(
        F.length(x).cast("long").alias("n_chars"),
        (F.length(x) - F.length(F.regexp_replace(x, r"(.)\1{3,}", ""))).cast("long").alias("n_repeated"),
        F.size(tokens).cast("long").alias("n_tokens"),
        F.size(F.filter(tokens, lambda t: t.rlike(r"(.)\1{2,}"))).cast("long").alias("n_bad_tokens"),
        F.regexp_count(x, F.lit(rf"([{LETTER}])\1")).cast("long").alias("n_doubles"),
    )


def is_corrupted(metrics: Column) -> Column:
    """Whether any share reaches its threshold; an empty text is not corrupted."""
    m = metrics
    return (m["n_chars"] > 0) & (
        (m["n_repeated"] >= L.REPEATED_SHARE * m["n_chars"])
        | ((m["n_tokens"] > 0) & (m["n_bad_tokens"] >= L.BAD_TOKEN_SHARE * m["n_tokens"]))
        | (m["n_doubles"] >= L.ARABIC_DOUBLE_SHARE * m["n_chars"])
    )


def segment_language(x: Column) -> Column:
    """ar, fr, mixed or unknown, by the share of Arabic among Arabic and Latin letters."""
    arabic = F.regexp_count(x, F.lit("[؀-ۿ]"))
    total = arabic + F.regexp_count(x, F.lit("[A-Za-zÀ-ÿ]"))
    return F.when(total == 0, "unknown").when(arabic > 0.7 * total, "ar").when(arabic < 0.3 * total, "fr").otherwise("mixed")


def nullable(x: Column) -> Column:
    """Trimmed; blank texts and words for `unknown` become null."""
    return let(strip(x), lambda v: F.when((v != "") & ~F.lower(v).isin(*L.NULL_WORDS), v))


def is_masked_party(x: Column) -> Column:
    """Starred or elided names, or no more than four letters once blanks, quotes, commas and dots go."""
    short = F.regexp_replace(x, r"""(?U)[\s"'،,.]""", "")
    return F.coalesce(short.rlike(r"[*…]|^[A-Za-zء-ي]{1,4}$"), F.lit(False))


def gate(x: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(x.isin(*allowed), x)


def count_sentences(x: Column) -> Column:
    return F.when(x.isNull(), 0).otherwise(F.size(F.filter(F.split(x, r"(?U)[.!؟؛]\s+|\n+"), lambda s: strip(s) != "")))


def shorten(x: Column, budget: int | Column) -> Column:
    """Both ends of a text that is longer than the budget, half from each, around a mark."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    room = F.greatest(F.lit(1), budget - len(L.SHORTENED)).cast("int")

    def ends(v: Column) -> Column:
        value, size, head = v["value"], F.length(v["value"]), F.floor(v["room"] / 2).cast("int")
        start = F.regexp_replace(F.substring(value, F.lit(1), head), r"(?U)\s+$", "")
        end = F.regexp_replace(F.substring(value, F.greatest(size - (v["room"] - head), F.lit(0)) + 1, v["room"]), r"(?U)^\s+", "")
        return F.when(size <= v["budget"], value).otherwise(F.concat(start, F.lit(L.SHORTENED), end))

    return let(F.struct(strip(F.coalesce(x, F.lit(""))).alias("value"), budget.alias("budget"), room.alias("room")), ends)


def display_date(x: Column) -> Column:
    """A day as dd/mm/yyyy, a dash without one."""
    return display(F.date_format(x, "dd/MM/yyyy"))


def truncate_error(x: Column) -> Column:
    """Null if blank; beyond 4000 characters the first 3997 and three dots."""
    return F.when(F.length(x) > 4000, F.concat(F.substring(x, 1, 3997), F.lit("..."))).when(x != "", x)


def readable_size(n: Column) -> Column:
    """Bytes as `x.x MB` above 1024 KB, else whole KB."""
    kb = n / 1024
    return F.when(kb > 1024, F.format_string("%.1f MB", kb / 1024)).otherwise(F.format_string("%.0f KB", kb))


def normalize_status(x: Column) -> Column:
    """The three canonical statuses pass; else anything that contains `valid` is Valide, the rest Anomalie."""
    return F.when(x.isin(*L.STATUSES), x).when(F.lower(x).contains("valid"), "Valide").otherwise("Anomalie")


def display(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("-"))


def display_list(x: Column) -> Column:
    return display(F.array_join(x, ", "))
