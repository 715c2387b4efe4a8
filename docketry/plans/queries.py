"""The registered queries, each with the SQL that gives the same rows.

Queries over judgments, words and the registry run on tables derived from the given ones; their
SQL reads the source columns that were rendered into the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import amounts as A
from docketry.functions import facts as X
from docketry.functions import lexicon as L
from docketry.functions import text as T
from docketry.operators import ocr, record, registry
from docketry.operators.tables import materialise, running_total
from docketry.plans import derived as D
from docketry.sources import documents as docs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# ---- pieces of SQL that several queries share

MILLIMES = "CAST(round(CAST({} AS DECIMAL(20,6)) * 1000) AS BIGINT)"
ROLE = "CASE o_orderkey % 5 WHEN 0 THEN 'demandeur' WHEN 1 THEN 'intime' WHEN 2 THEN 'defendeur' WHEN 3 THEN 'appelant' END"
RULING = "CASE (o_orderkey // 5) % 4 WHEN 0 THEN 'confirmatif' WHEN 1 THEN 'modificatif' WHEN 2 THEN 'infirmatif' ELSE 'original' END"
COURT = "'المحكمة الابتدائية ب' || ['تونس', 'سوسة', 'صفاقس', 'بنزرت', 'قابس'][CAST(c_nationkey % 5 AS INT) + 1]"
FORMATTED = "replace(format('{{:,}}', {0} // 1000), ',', '.') || ',' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0') || ' دينار'"
JUDGED = "orders JOIN customer ON o_custkey = c_custkey"
TOTALS = f"SELECT l_orderkey, CAST(sum({MILLIMES.format('l_extendedprice')}) AS BIGINT) AS millimes, count(*) AS items FROM lineitem GROUP BY l_orderkey"


def metrics_sql(source: str, keys: str) -> str:
    """Corruption metrics of source(keys, t), t without blanks, by runs of equal characters."""
    return f"""
c AS (SELECT {keys}, t, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM {source} WHERE t <> ''),
b AS (SELECT {keys}, ch, i, CASE WHEN ch = lag(ch) OVER (PARTITION BY {keys} ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT {keys}, sum(fresh) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
r AS (SELECT {keys}, run, count(*) AS n FROM g GROUP BY ALL),
rep AS (SELECT {keys}, sum(CASE WHEN n >= 4 THEN n ELSE 0 END) AS n_repeated FROM r GROUP BY ALL),
tok AS (SELECT {keys}, t, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS tokens FROM {source}),
m AS (SELECT tok.*, length(t) AS n_chars, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated, CAST(len(tokens) AS BIGINT) AS n_tokens,
  CAST(len(list_filter(tokens, lambda x: len(list_filter(range(1, length(x) - 1), lambda i: x[i] = x[i + 1] AND x[i + 1] = x[i + 2])) > 0)) AS BIGINT) AS n_bad_tokens,
  CAST(0 AS BIGINT) AS n_doubles FROM tok LEFT JOIN rep USING ({keys}))"""


FLAG = "(n_chars > 0 AND (n_repeated >= 0.08 * n_chars OR (n_tokens > 0 AND n_bad_tokens >= 0.2 * n_tokens)))"
COMPACT = "regexp_replace(coalesce(text, ''), '\\s+', '', 'g')"

# ---- cleaning and text predicates


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.texts(spark, sf_dir, "documents").select("doc_id", T.corruption_metrics(T.compact(T.nfkc(F.col("text")))).alias("m"))


@query(f"WITH s AS (SELECT doc_id, {COMPACT} AS t FROM documents), {metrics_sql('s', 'doc_id')} SELECT doc_id, n_chars, n_repeated, n_tokens, n_bad_tokens, n_doubles FROM m")
def corruption_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("doc_id", "m.*")


@query(f"WITH s AS (SELECT doc_id, {COMPACT} AS t FROM documents), {metrics_sql('s', 'doc_id')} SELECT doc_id, {FLAG} AS corrupted FROM m")
def corruption_flag(spark, sf_dir):
    return _metrics(spark, sf_dir).select("doc_id", T.is_corrupted(F.col("m")).alias("corrupted"))


PAGE = 600


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.texts(spark, sf_dir, "documents")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / PAGE).cast("int") - 1, F.lit(0)))
    return rows.select("doc_id", "text", F.explode(numbers).alias("k")).select("doc_id", (F.col("k") + 1).alias("page"), F.substring(F.col("text"), F.col("k") * PAGE + 1, F.lit(PAGE)).alias("text"))


PAGES_SQL = f"""p AS (SELECT doc_id, k + 1 AS page, substring(text, CAST(k * {PAGE} + 1 AS BIGINT), {PAGE}) AS text
  FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / {PAGE}.0) AS BIGINT), 1))) AS k FROM documents)),
s AS (SELECT doc_id, page, {COMPACT} AS t, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS char_count FROM p), {metrics_sql('s', 'doc_id, page')},
ty AS (SELECT doc_id, CAST(page AS INT) AS page, char_count, {FLAG} AS corrupted, CASE WHEN char_count < 20 OR {FLAG} THEN 'scanned' ELSE 'text' END AS type FROM m JOIN s USING (doc_id, page))"""


@query(f"WITH {PAGES_SQL} SELECT * FROM ty")
def page_type(spark, sf_dir):
    return docs.page_types(_pages(spark, sf_dir))


@query(f"""WITH {PAGES_SQL} SELECT doc_id, count(type) AS pages, CASE WHEN coalesce(bool_or(type = 'scanned'), true) THEN 'scanned' ELSE 'text' END AS pdf_type,
  CASE WHEN coalesce(bool_and(type = 'scanned'), true) THEN 'scanned' ELSE 'mixed_or_text' END AS pdf_type_detailed
FROM (SELECT doc_id FROM documents UNION ALL SELECT 1000000 + item_id FROM benchmark) LEFT JOIN ty USING (doc_id) GROUP BY doc_id""")
def document_type(spark, sf_dir):
    # Benchmark items stand for documents without pages.
    pageless = D.table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000).alias("doc_id"))
    every = D.table(spark, sf_dir, "documents").select("doc_id").unionByName(pageless)
    return docs.document_types(docs.page_types(_pages(spark, sf_dir)), every)


@query(f"""WITH s AS (SELECT doc_id, {COMPACT} AS t FROM documents), {metrics_sql('s', 'doc_id')}
SELECT doc_id, CASE WHEN blank OR {FLAG} THEN 'ocr' ELSE 'native' END AS extraction_method, CASE WHEN NOT blank AND NOT {FLAG} THEN length(text) WHEN unread THEN 1 ELSE 7 + length(CAST(doc_id AS VARCHAR)) END AS n_chars,
  CASE WHEN (blank OR {FLAG}) AND unread THEN 'empty_text' END AS error
FROM (SELECT m.*, text, lang = 'fr' AS blank, source < 'm' AS unread FROM m JOIN (SELECT doc_id, text, lang, coalesce(source, '') AS source FROM documents) USING (doc_id))""")
def native_or_ocr(spark, sf_dir):
    # French documents have a blank native layer; OCR finds nothing in sources of the first half of the alphabet.
    native = F.when(F.col("lang") == "fr", F.lit(" \n")).otherwise(F.col("text"))
    recognised = F.when(F.coalesce("source", F.lit("")) < "m", F.lit(" ")).otherwise(F.concat(F.lit("ocr of "), F.col("doc_id").cast("string")))
    rows = D.texts(spark, sf_dir, "documents").select("doc_id", native.alias("text"), recognised.alias("ocr_text"))
    return docs.route(rows).select("doc_id", "extraction_method", F.length("usable_text").cast("long").alias("n_chars"), "error")


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def clean_whitespace(spark, sf_dir):
    noisy = F.regexp_replace(F.regexp_replace("text", " ", " \t "), "\n", "  \n")
    return D.texts(spark, sf_dir, "documents").select("doc_id", T.clean_whitespace(noisy).alias("text"))


@query("SELECT p_partkey, p_name AS no_tatweel, p_name AS no_marks FROM part")
def arabic_marks(spark, sf_dir):
    drawn, marked = F.replace("p_name", F.lit(" "), F.lit("ـ ")), F.replace("p_name", F.lit(" "), F.lit("ًّ "))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.remove_tatweel(drawn).alias("no_tatweel"), T.strip_diacritics(marked).alias("no_marks"))


@query("SELECT p_partkey AS doc_id, CAST(page AS INT) AS page, CASE page WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE p_brand END AS text FROM part, range(1, 4) t(page)")
def page_split(spark, sf_dir):
    pages = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array("p_name", "p_type", "p_brand")).alias("k", "text"))
    joined = docs.join_pages(pages.select("doc_id", (F.col("k") + 1).alias("page"), "text"))
    return docs.split_pages(joined)


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_type AS text FROM part")
def page_markers(spark, sf_dir):
    text = F.concat(F.lit("--- Page 1 ---\n"), F.col("p_name"), F.lit("\n--- Page  2 ---\n"), F.col("p_type"))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.clean_text(text).alias("text"))


@query("SELECT p_partkey, CASE WHEN a + l = 0 THEN 'unknown' WHEN a > 0.7 * (a + l) THEN 'ar' WHEN a < 0.3 * (a + l) THEN 'fr' ELSE 'mixed' END AS lang FROM (SELECT p_partkey, p_size AS a, length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS l FROM part)")
def segment_language(spark, sf_dir):
    text = F.concat(F.repeat(F.lit("ا"), F.col("p_size")), F.lit(" "), F.col("p_name"))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.segment_language(text).alias("lang"))


@query("SELECT lang, count(*) AS n_lines FROM (SELECT CASE WHEN regexp_matches(line, '[A-Za-zÀ-ÿ]') THEN 'fr' ELSE 'unknown' END AS lang FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents) WHERE line <> '') GROUP BY lang")
def line_language(spark, sf_dir):
    lines = D.texts(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(T.strip(F.col("line")).alias("line"))
    return lines.filter("line <> ''").groupBy(T.segment_language(F.col("line")).alias("lang")).agg(F.count("*").alias("n_lines"))


@query("SELECT p_partkey, 'عملا بالفصول ' || p_size || ' و' || (p_size + 1) || ' و' || (p_size + 7) || ' منه' AS text FROM part")
def article_list_repair(spark, sf_dir):
    n = lambda k: (F.col("p_size") + k).cast("string")
    text = F.concat(F.lit("عملا بالفيول "), n(0), F.lit("\n ي"), n(1), F.lit("\n ى "), n(7), F.lit(" منه"))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.repair_article_lists(F.replace(text, F.lit("بالفيول"), F.lit("ب الفيول"))).alias("text")).withColumn("text", F.replace("text", F.lit("ب الفصول"), F.lit("بالفصول")))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!؟؛]\\s+|\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS n_sentences FROM documents")
def sentence_count(spark, sf_dir):
    return D.texts(spark, sf_dir, "documents").select("doc_id", T.count_sentences(F.col("text")).cast("long").alias("n_sentences"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 3997) || '...' WHEN text <> '' THEN text END AS message FROM documents")
def error_truncate(spark, sf_dir):
    return D.texts(spark, sf_dir, "documents").select("doc_id", T.truncate_error(F.col("text")).alias("message"))


@query("SELECT o_orderkey, CASE WHEN b > 1048576 THEN ((b * 10 + 524288) // 1048576) // 10 || '.' || ((b * 10 + 524288) // 1048576) % 10 || ' MB' ELSE CAST((b + 512) // 1024 AS VARCHAR) || ' KB' END AS size FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) * 9 AS b FROM orders)")
def readable_size(spark, sf_dir):
    n = F.round("o_totalprice").cast("long") * 9
    return D.table(spark, sf_dir, "orders").select("o_orderkey", T.readable_size(n).alias("size"))


# ---- amounts


@query(f"SELECT o_orderkey, {MILLIMES.format('o_totalprice')} AS millimes FROM orders")
def amount_parse(spark, sf_dir):
    text = D.written(D.millimes(F.col("o_totalprice")), F.col("o_orderkey") % 4)
    return D.table(spark, sf_dir, "orders").select("o_orderkey", A.parse_millimes(F.concat(text, F.lit(" د"))).alias("millimes"))


@query(f"SELECT o_orderkey, {FORMATTED.format('m')} AS amount FROM (SELECT o_orderkey, {MILLIMES.format('o_totalprice')} AS m FROM orders)")
def amount_format(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select("o_orderkey", A.format_millimes(D.millimes(F.col("o_totalprice"))).alias("amount"))


@query(f"""SELECT l_orderkey AS doc_id, 'قسط رقم الدين' AS label, {MILLIMES.format('l_extendedprice')} AS millimes, true AS is_fixed, false AS is_variable FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 'الفائض الجاري بداية من تاريخ الحلول إلى تمام الوفاء', 0, false, true FROM lineitem WHERE l_returnflag = 'R'""")
def amount_items(spark, sf_dir):
    items = A.classify_items(A.numbered_items(A.amount_list(F.col("text"))["items"]))
    # An outer generator: Spark puts a filter before an inner one, which would compute the items again.
    rows = D.judgments(spark, sf_dir).select("doc_id", F.explode_outer(items).alias("i")).filter("i is not null")
    return rows.select("doc_id", "i.label", F.coalesce("i.millimes", F.lit(0)).alias("millimes"), "i.is_fixed", "i.is_variable")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments with their operative part, role and type as columns of their own."""
    text = F.col("text")
    rows = D.judgments(spark, sf_dir).withColumn("operative", X.operative_part(text)).withColumn("role", X.bank_role(text))
    return rows.withColumn("kind", X.judgment_type(text, F.col("operative")))


def _awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each judgment awards the bank, without judgments that award nothing."""
    award = record.applicable_amounts(F.col("text"), F.col("kind"), F.col("role"))
    rows = _facts(spark, sf_dir).select("doc_id", "role", X.tribunal(F.col("text")).alias("court"), F.inline_outer(F.array(award)))
    return rows.filter("millimes is not null")


@query(f"""SELECT o_orderkey AS doc_id, millimes, items, {FORMATTED.format('millimes')} AS total
FROM orders JOIN ({TOTALS}) ON o_orderkey = l_orderkey WHERE (o_orderkey // 5) % 4 <> 2 AND o_orderkey % 5 <> 4""")
def judgment_total(spark, sf_dir):
    return _awards(spark, sf_dir).select("doc_id", "millimes", F.size("fixed").cast("long").alias("items"), "total")


@query(f"""SELECT {COURT} AS court, {ROLE} AS role, count(*) AS n, CAST(sum(millimes) AS BIGINT) AS millimes
FROM {JUDGED} JOIN ({TOTALS}) ON o_orderkey = l_orderkey WHERE (o_orderkey // 5) % 4 <> 2 AND o_orderkey % 5 <> 4 GROUP BY ALL""")
def totals_by_court_and_role(spark, sf_dir):
    return _awards(spark, sf_dir).groupBy("court", "role").agg(F.count("*").alias("n"), F.sum("millimes").alias("millimes"))


GAP = "(o_custkey % 90) * 10 + 10"


def _distant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An amount before any mention of the bank, one at a distance that o_custkey sets, one a bit farther."""
    far = F.repeat(F.lit("x"), (F.col("o_custkey") % 90 * 10 + 10).cast("int"))
    amount = D.written(D.millimes(F.col("o_totalprice")) + 1_000_000, F.lit(0))
    text = F.concat(F.lit("9.999,999 "), F.lit(L.BANK_NAME), far, F.lit(" "), amount, F.lit(" ثم 8.888,888"))
    return D.dealt(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@query(f"SELECT o_orderkey AS doc_id, {FORMATTED.format('m')} AS amount FROM (SELECT o_orderkey, {MILLIMES.format('o_totalprice')} + 1000000 AS m FROM orders WHERE {GAP} + {len(L.BANK_NAME) + 1} <= 750)")
def nearest_amount(spark, sf_dir):
    # An outer generator: Spark puts a filter on a plain column before the rows are dealt out, where few tasks would compute it too.
    nearest = F.explode_outer(F.array(record.nearest_bank_amount(F.col("text"))))
    return _distant(spark, sf_dir).select("doc_id", nearest.alias("amount")).filter("amount is not null")


@query(f"""WITH a AS (SELECT o_orderkey AS doc_id, 10 AS bank, 10 + {len(L.BANK_NAME)} + {GAP} + 1 AS s, {FORMATTED.format('m')} AS v FROM (SELECT *, {MILLIMES.format('o_totalprice')} + 1000000 AS m FROM orders)),
b AS (SELECT doc_id, bank, s, replace(v, ' دينار', '') AS v FROM a UNION ALL SELECT doc_id, bank, s + length(v) - 6 + 4, '8.888,888' FROM a)
SELECT doc_id, v AS amount, s - bank AS distance FROM b WHERE s - bank <= 750""")
def preceding_mention(spark, sf_dir):
    # Texts are rendered once; what both sides of the join need are the spans alone.
    spans = F.array(*(T.spans(F.col("text"), p) for p in (record.AMOUNT_PATTERN, f"(?U){L.BANK}")))
    rows = _distant(spark, sf_dir).select("doc_id", F.posexplode(spans).alias("side", "found")).select("doc_id", "side", F.explode("found").alias("x"))
    rows = materialise(rows.select("doc_id", "side", "x.*"), "mentions")
    met = record.nearest_preceding(rows.filter("side = 0"), rows.filter("side = 1"), "doc_id", L.AMOUNT_REACH)
    return met.select("doc_id", F.col("l_value").alias("amount"), (F.col("l_start") - F.col("r_start")).cast("long").alias("distance"))


# ---- facts


@query("SELECT o_orderkey AS doc_id, o_orderkey || '/' || year(o_orderdate) AS number FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey")
def case_number(spark, sf_dir):
    return D.judgments(spark, sf_dir).select("doc_id", X.case_number(F.col("text")).alias("number"))


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%d/%m/%Y') AS date FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey")
def decision_date(spark, sf_dir):
    return D.judgments(spark, sf_dir).select("doc_id", X.decision_date(F.col("text")).alias("date"))


@query(f"SELECT o_orderkey AS doc_id, {COURT} AS court FROM {JUDGED} JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey")
def tribunal(spark, sf_dir):
    return D.judgments(spark, sf_dir).select("doc_id", X.tribunal(F.col("text")).alias("court"))


LISTED = f"{JUDGED} JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey"


@query(f"SELECT o_orderkey AS doc_id, {RULING} AS kind FROM {LISTED}")
def judgment_type(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", "kind")


@query(f"SELECT o_orderkey AS doc_id, {ROLE} AS role FROM {LISTED}")
def bank_role(spark, sf_dir):
    return D.judgments(spark, sf_dir).select("doc_id", X.bank_role(F.col("text")).alias("role"))


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 AND (o_orderkey // 5) % 4 = 3 THEN 'Favorable' END AS decision FROM {LISTED}")
def bank_decision(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", X.bank_decision(F.col("role"), F.col("operative"), F.col("text")).alias("decision"))


@query(f"SELECT o_orderkey AS doc_id, concat('ولهذه الأسباب', chr(10), 'قضت المحكمة ', ['بإقرار الحكم الابتدائي', 'بتعديل الحكم الابتدائي', 'بنقض الحكم الابتدائي', 'بأداء المبالغ المذكورة'][CAST((o_orderkey // 5) % 4 AS INT) + 1], chr(10), 'عن الطور الحالي') AS operative FROM {LISTED}")
def operative_part(spark, sf_dir):
    return D.judgments(spark, sf_dir).select("doc_id", X.operative_part(F.col("text")).alias("operative"))


CITED = """SELECT l_orderkey AS doc_id, string_agg('الفصل ' || n || CASE WHEN c THEN ' من عقد القرض' ELSE '' END, '|' ORDER BY f) AS refs
FROM (SELECT l_orderkey, l_partkey % 300 + 1 AS n, min(l_linenumber * 10000000 + l_partkey) AS f, bool_or(l_partkey % 7 = 0) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1"""


@query(CITED)
def legal_references(spark, sf_dir):
    return D.judgments(spark, sf_dir).select("doc_id", F.array_join(X.legal_references(F.col("text")), "|").alias("refs"))


@query(f"SELECT doc_id, refs, 'الفصل 999|' || refs AS all_refs FROM ({CITED})")
def final_references(spark, sf_dir):
    # An article farther before the ruling than its grounds reach, and one behind it, which are no grounds of it.
    text = F.concat(F.lit("الفصل 999 . "), F.repeat(F.lit("مقدمة "), L.GROUNDS_REACH // 6), F.col("text"), F.lit("\nالفصل 998 ."))
    rows = D.judgments(spark, sf_dir).select("doc_id", F.array_join(X.final_references(text), "|").alias("refs"), F.array_join(X.legal_references(text), "|").alias("all_refs"))
    return rows.select("doc_id", "refs", F.replace("all_refs", F.lit("|الفصل 998"), F.lit("")).alias("all_refs"))


@query("SELECT c_custkey, 'شركة ' || c_name AS company FROM customer WHERE c_custkey % 3 <> 0")
def defendant_company(spark, sf_dir):
    text = F.concat(F.lit("المدعى عليها: شركة "), F.when(F.col("c_custkey") % 3 == 0, F.lit("ذ.ذ")).otherwise(F.col("c_name")), F.lit(" في شخص ممثلها القانوني\n"))
    # Without a company of its own, a masked row's section holds no other one.
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("المدعى عليها: س.س في شخص")).otherwise(text)
    return D.table(spark, sf_dir, "customer").select("c_custkey", X.defendant(text).alias("company")).filter("company is not null")


@query(f"SELECT o_orderkey AS doc_id, (o_orderkey % 3 = 1) AS advance FROM {LISTED}")
def procedure_advance(spark, sf_dir):
    note = F.when(F.col("doc_id") % 3 == 1, F.lit(" تسبقة مبلغ قدره خمسمائة دينار (500,000)")).otherwise(F.lit(" مبلغ قدره خمسمائة دينار"))
    return D.judgments(spark, sf_dir).select("doc_id", T.has(F.concat("text", note), L.PROCEDURE_ADVANCE).alias("advance"))


# ---- records


@query("SELECT c_custkey, length(replace(replace(c_mktsegment, ' ', ''), '.', '')) <= 4 OR c_custkey % 5 = 0 AS masked FROM (SELECT c_custkey, substring(c_mktsegment, 1, 1 + CAST(c_custkey % 7 AS INT)) AS c_mktsegment FROM customer)")
def party_masking(spark, sf_dir):
    name = F.substring(F.col("c_mktsegment"), F.lit(1), (F.col("c_custkey") % 7 + 1).cast("int"))
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("***"), name)).otherwise(F.concat(name, F.lit(" .")))
    return D.table(spark, sf_dir, "customer").select("c_custkey", T.is_masked_party(name).alias("masked"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 5 THEN o_orderstatus END AS value FROM orders")
def null_tokens(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.concat(F.lit(" "), "o_orderpriority", F.lit("\n"))).when(k == 1, F.lit(" Inconnu ")).when(k == 2, F.lit("N/A")).when(k == 3, F.lit("  ")).when(k == 4, F.lit("non mentionnee")).otherwise(F.col("o_orderstatus"))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", T.nullable(raw).alias("value"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Favorable' WHEN 1 THEN 'Defavorable' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN 'intime' END AS role FROM orders")
def enum_gate(spark, sf_dir):
    k = F.col("o_orderkey")
    decision = D.pick(("Favorable", "Defavorable", "favorable", "Nulle"), k % 4)
    return D.table(spark, sf_dir, "orders").select("o_orderkey", T.gate(decision, L.DECISIONS).alias("decision"), T.gate(D.pick(("intime", "tiers", ""), k % 3), L.ROLES).alias("role"))


@query("""SELECT o_orderkey AS doc_id, ok AS parsed, CASE WHEN ok THEN 'T' || (o_orderkey % 9) END AS tribunal, CASE WHEN ok THEN (o_orderkey + 100) || '/2019' END AS numero_dossier,
  CASE WHEN ok AND o_orderkey % 2 = 0 THEN 'original' END AS type_jugement, CASE WHEN ok THEN lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || '/01/2020' END AS date_decision,
  CASE WHEN ok AND o_orderkey % 4 <> 0 THEN '1,000' END AS montant, CAST(NULL AS VARCHAR) AS demandeur, CASE WHEN ok THEN 'Societe ' || o_orderkey END AS defendeur, CASE WHEN ok THEN 'a|b' END AS refs
FROM (SELECT *, o_orderkey % 6 IN (0, 1, 2, 5) AS ok FROM orders)""")
def model_reply(spark, sf_dir):
    rows = D.replies(spark, sf_dir).withColumn("r", record.parse_model_reply(F.col("raw"))).withColumn("n", record.normalize_record(F.col("r")))
    return rows.select("doc_id", F.col("r").isNotNull().alias("parsed"), "n.tribunal", "n.numero_dossier", "n.type_jugement", "n.date_decision", "n.montant", "n.parties.demandeur", "n.parties.defendeur", F.array_join("n.references_juridiques", "|").alias("refs"))


EXTRACTED = f"""SELECT o_orderkey AS doc_id, {COURT} AS tribunal,
  o_orderkey || '/' || year(o_orderdate) AS numero_dossier, strftime(o_orderdate, '%d/%m/%Y') AS date_decision, {RULING} AS type_jugement, {ROLE} AS role_banque,
  CASE WHEN o_orderkey % 5 = 0 THEN '{L.BANK_NAME}' END AS demandeur, CASE WHEN o_orderkey % 5 = 2 THEN '{L.BANK_NAME}' END AS defendeur,
  CASE WHEN (o_orderkey // 5) % 4 <> 2 AND o_orderkey % 5 <> 4 THEN {FORMATTED.format('millimes')} END AS total,
  CASE WHEN o_orderkey % 5 = 0 AND (o_orderkey // 5) % 4 = 3 THEN 'Favorable' END AS decision, refs
FROM {JUDGED} JOIN ({TOTALS}) ON o_orderkey = l_orderkey JOIN ({CITED}) ON o_orderkey = doc_id"""


@query(EXTRACTED)
def extraction(spark, sf_dir):
    e = F.col("extraction")
    rows = record.strengthen(D.judgments(spark, sf_dir))
    fields = ["tribunal", "numero_dossier", "date_decision", "type_jugement", "role_banque"]
    applied = F.when(e["montants_fixes"].isNotNull(), e["montant"])
    return rows.select("doc_id", *(e[k].alias(k) for k in fields), e["parties"]["demandeur"].alias("demandeur"), e["parties"]["defendeur"].alias("defendeur"), applied.alias("total"), e["decision"].alias("decision"), F.array_join(e["references_juridiques"], "|").alias("refs"))


@query(f"SELECT doc_id, CASE WHEN ok THEN 'T' || (doc_id % 9) ELSE tribunal END AS tribunal, refs, CASE WHEN ok AND doc_id % 2 = 0 THEN 'original' WHEN ok THEN type_jugement ELSE type_jugement END AS kind FROM (SELECT *, doc_id % 6 IN (0, 1, 2, 5) AS ok FROM ({EXTRACTED}))")
def reply_merged_with_text(spark, sf_dir):
    rows = D.judgments(spark, sf_dir).join(D.replies(spark, sf_dir), "doc_id")
    rows = rows.withColumn("reply", record.normalize_record(record.parse_model_reply(F.col("raw"))))
    e = F.col("extraction")
    return record.strengthen(rows, record="reply").select("doc_id", e["tribunal"].alias("tribunal"), F.array_join(e["references_juridiques"], "|").alias("refs"), e["type_jugement"].alias("kind"))


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS notes, CASE WHEN (o_orderkey // 5) % 4 <> 2 AND o_orderkey % 5 <> 4 THEN 'نوع' ELSE 'يمثل' END AS begins, true AS both FROM {LISTED}""")
def advance_note(spark, sf_dir):
    # A judgment that names no award has the amount behind the bank's name, so every one has an explanation to add the note to.
    more = F.concat(F.lit(f" {L.BANK_NAME} مبلغ 1.234,567 د"), F.when(F.col("doc_id") % 3 == 1, F.lit(" تسبقة مبلغ قدره خمسمائة دينار (500,000)")).otherwise(""))
    rows = record.strengthen(D.judgments(spark, sf_dir).select("doc_id", F.concat("text", more).alias("text")))
    said, same = F.col("extraction.explication_montant"), F.col("extraction.explication_montant").eqNullSafe(F.col("extraction.montant_justification"))
    notes = ((F.length(said) - F.length(F.replace(said, F.lit(L.ADVANCE_NOTE), F.lit("")))) / len(L.ADVANCE_NOTE)).cast("int")
    return rows.select("doc_id", notes.alias("notes"), F.split(said, " ")[0].alias("begins"), same.alias("both"))


@query(f"SELECT doc_id, total AS montant FROM ({EXTRACTED}) WHERE decision = 'Favorable' AND total IS NOT NULL AND refs LIKE '%|%'")
def favourable_judgments(spark, sf_dir):
    # What a user of the records filters by first.
    e = F.col("extraction")
    rows = record.decided(D.judgments(spark, sf_dir), "Favorable")
    return rows.filter(e["montants_fixes"].isNotNull() & (F.size(e["references_juridiques"]) > 1)).select("doc_id", e["montant"].alias("montant"))


SAID = (
    ("o_orderkey % 2 = 0", L.SUMMARY_BANKRUPTCY[0], f"'{L.SUMMARY_BANKRUPTCY[1]}'"),
    ("o_orderkey % 3 = 0", L.SUMMARY_2019[0], f"'{L.SUMMARY_2019[1]}'"),
    ("o_orderkey % 5 < 2", L.BANK_NAME, f"'ورد بالحكم أن ديون الشركة تشمل مديونية لفائدة {L.BANK_NAME}' || coalesce(' قدرها ' || amount, '') || '.'"),
    ("o_orderkey % 7 = 0", L.SUMMARY_SOCIAL_FUND[0], f"'{L.SUMMARY_SOCIAL_FUND[1]}'"),
    ("o_orderkey % 11 < 4", " ".join(L.SUMMARY_TRUSTEE[0]), f"'{L.SUMMARY_TRUSTEE[1]}'"),
    ("o_orderkey % 13 < 5", L.SUMMARY_ADVANCE[0], f"'{L.SUMMARY_ADVANCE[1]}'"),
)
FROM_COURT = "CASE WHEN court IS NOT NULL OR day IS NOT NULL THEN 'صدر الحكم' || coalesce(' عن ' || court, '') || coalesce(' بتاريخ ' || day, '') || '.' END"


@query(f"""SELECT o_orderkey AS doc_id, nullif(concat_ws(' ', {FROM_COURT}, {', '.join(f"CASE WHEN {when} THEN {what} END" for when, _, what in SAID)}), '') AS resume
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN {COURT} END AS court, CASE WHEN o_custkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day,
  CASE WHEN o_custkey % 5 > 1 THEN o_orderpriority END AS amount FROM {JUDGED})""")
def fallback_summary(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").join(D.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat_ws("؛ ", F.lit("نص"), *(F.when(F.expr(when), F.lit(word)) for when, word, _ in SAID))
    court = F.concat(F.lit("المحكمة الابتدائية ب"), D.pick(D.CITIES, F.col("c_nationkey") % 5))
    k = F.col("o_custkey")
    resume = record.summary(text, F.when(k % 2 == 0, court), F.when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")), F.when(k % 5 > 1, F.col("o_orderpriority")))
    return rows.select(F.col("o_orderkey").alias("doc_id"), resume.alias("resume"))


# A text too long for a model: head, mention, middle, mention, tail, list, ruling. Its parts have known lengths.
HEAD, MIDDLE, TAIL = "رأس ", "وسط ", "ذيل "
LISTED_AT, RULING_LINE = "المبالغ المالية التالية:", "قضت المحكمة بأداء المبلغ عدد "


@query(f"""WITH t AS (SELECT o_orderkey AS doc_id, repeat('{HEAD}', 500) AS head, repeat('{MIDDLE}', CAST(300 + o_custkey % 200 AS INT)) AS middle, repeat('{TAIL}', 400) AS tail,
  chr(10) || '1) قسط (' || o_orderkey || ' د)' || chr(10) AS items, '{L.REASONS_HEADING}' || chr(10) || '{RULING_LINE}' || o_orderkey AS ruling FROM orders),
p AS (SELECT *, head || '{L.BANK_NAME}' || ' ' || middle || '{L.BANK_NAME}' || ' ' || tail || '{LISTED_AT}' || items || 'وبعد' || chr(10) || ruling AS source, length(head) AS b1,
  length(head) + {len(L.BANK_NAME) + 1} + length(middle) AS b2 FROM t),
x AS (SELECT doc_id, '[EXTRAIT: {L.EXCERPTS[0][0]}]' || chr(10) || ruling || chr(10) || chr(10) || '[EXTRAIT: {L.EXCERPTS[1][0]}]' || chr(10) || rtrim(substring(source, 1, 1100))
  || chr(10) || chr(10) || '[EXTRAIT: {L.EXCERPTS[2][0]}]' || chr(10) AS lead, trim(substring(source, b1 - 119, {120 + len(L.BANK_NAME) + 430})) AS near,
  CASE WHEN b2 - b1 > 1400 THEN chr(10) || chr(10) || '[EXTRAIT: {L.EXCERPTS[3][0]}]' || chr(10) ELSE '' END AS label, CASE WHEN b2 - b1 > 1400 THEN trim(substring(source, b2 - 119, {120 + len(L.BANK_NAME) + 430})) ELSE '' END AS far,
  chr(10) || chr(10) || '[EXTRAIT: {L.EXCERPTS[4][0]}]' || chr(10) || ltrim(right(split_part(source, '{LISTED_AT}', 1), 300)) || chr(10) || rtrim(items, chr(10)) AS amounts FROM p)
SELECT doc_id, lead || {{near}} || label || {{far}} || amounts AS excerpts FROM x""".format(
    **{k: f"CASE WHEN length({k}) <= 400 THEN {k} ELSE rtrim(substring({k}, 1, (400 - {len(L.SHORTENED)}) // 2)) || '{L.SHORTENED}' || ltrim(right({k}, 400 - {len(L.SHORTENED)} - (400 - {len(L.SHORTENED)}) // 2)) END" for k in ("near", "far")}
))
def model_excerpts(spark, sf_dir):
    k, bank = F.col("o_orderkey").cast("string"), F.concat(F.lit(L.BANK_NAME), F.lit(" "))
    text = F.concat(
        F.repeat(F.lit(HEAD), 500), bank, F.repeat(F.lit(MIDDLE), (F.col("o_custkey") % 200 + 300).cast("int")), bank, F.repeat(F.lit(TAIL), 400),
        F.lit(LISTED_AT), F.lit("\n1) قسط ("), k, F.lit(" د)\nوبعد\n"), F.lit(L.REASONS_HEADING), F.lit(f"\n{RULING_LINE}"), k,
    )
    return D.dealt(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), docs.excerpts(text, 4500).alias("excerpts"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 404 WHEN 1 THEN 422 WHEN 2 THEN 422 WHEN 3 THEN 504 WHEN 4 THEN 503 WHEN 5 THEN 502 ELSE 500 END AS http,
 CASE o_orderkey % 8 WHEN 1 THEN 422 WHEN 2 THEN 422 WHEN 3 THEN 504 WHEN 4 THEN 503 ELSE 502 END AS client, o_orderkey % 2 = 0 AS overflow FROM orders""")
def service_errors(spark, sf_dir):
    k = F.col("o_orderkey") % 8
    name = D.pick(("FileNotFoundError", "ValueError", "RuntimeError", "APITimeoutError", "APIConnectionError", "APIError", "KeyError", "OSError"), k)
    message = D.pick(("Context size has been EXCEEDED", "bad request"), F.col("o_orderkey") % 2)
    e = docs.service_error(name)
    return D.table(spark, sf_dir, "orders").select("o_orderkey", e["http"].alias("http"), e["client"].alias("client"), docs.is_context_overflow(message).alias("overflow"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing_name' WHEN o_orderkey % 7 = 1 OR o_orderkey % 7 = 2 THEN 'not_pdf' WHEN o_orderkey % 7 = 3 THEN 'empty_file' WHEN o_orderkey % 7 = 4 THEN 'too_large' WHEN o_orderkey % 7 = 5 THEN 'missing_client' END AS error FROM orders""")
def upload_checks(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    name = F.when(k == 0, F.lit(" ")).when(k == 1, F.lit("a.txt")).otherwise(F.lit("a.PDF"))
    mime = F.when(k == 2, F.lit("text/plain")).otherwise(F.lit("application/pdf"))
    size = F.when(k == 3, 0).when(k == 4, docs.MAX_UPLOAD_BYTES + 1).otherwise(docs.MAX_UPLOAD_BYTES)
    client = F.when(k == 5, F.lit(" \t")).otherwise(F.lit("c"))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", docs.upload_error(name, mime, size, client).alias("error"))


# ---- registry

STATUS = "['Valide', 'En cours', 'Anomalie', 'valide', 'Invalide', 'pending', ''][CAST(o_orderkey % 7 AS INT) + 1]"
NORMAL = "CASE o_orderkey % 7 WHEN 1 THEN 'En cours' WHEN 2 THEN 'Anomalie' WHEN 5 THEN 'Anomalie' WHEN 6 THEN 'Anomalie' ELSE 'Valide' END"


@query(f"SELECT o_orderkey AS id, {NORMAL} AS status FROM orders")
def status_normalize(spark, sf_dir):
    return D.registry(spark, sf_dir).select("id", T.normalize_status(F.col("status")).alias("status"))


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'Valide') AS valide, count(*) FILTER (s = 'En cours') AS en_cours, count(*) FILTER (s = 'Anomalie') AS anomalie FROM (SELECT {NORMAL} AS s FROM orders)")
def registry_stats(spark, sf_dir):
    return registry.stats(D.registry(spark, sf_dir))


@query("SELECT o_orderkey AS id, upper(c_name) AS client, CAST(o_orderdate AS TIMESTAMP) AS date FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def registry_recent(spark, sf_dir):
    return registry.recent(D.registry(spark, sf_dir)).select("id", "client", "date")


@query(f"SELECT o_orderkey AS id, {NORMAL} AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE (contains(lower(c_mktsegment) || '_' || o_orderkey || '.pdf', 'building_1') OR contains(lower(c_name), 'building_1')) AND {NORMAL} = 'Anomalie'")
def registry_search(spark, sf_dir):
    return registry.search(D.registry(spark, sf_dir), "BUILDING_1", "Anomalie").select("id", T.normalize_status(F.col("status")).alias("status"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001')")
def dossier_search(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("responsible"))
    return registry.search(rows, "00001", columns=("name", "responsible")).select("id", "name")


@query(f"SELECT o_orderkey AS id FROM orders WHERE {NORMAL} = 'Anomalie'")
def retry_eligible(spark, sf_dir):
    return registry.retry_eligible(D.registry(spark, sf_dir)).select("id")


@query("""WITH e AS (SELECT year(o_orderdate) AS y, max(o_orderkey % 500) AS m FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT o_orderkey AS id, 'D-' || year(o_orderdate) || '-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS ref
FROM (SELECT o_orderkey, o_orderdate, coalesce(m, 0) + row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS n FROM orders LEFT JOIN e ON year(o_orderdate) = y WHERE o_orderkey % 4 <> 0)""")
def ref_allocate(spark, sf_dir):
    rows = D.registry(spark, sf_dir)
    new = rows.filter("id % 4 <> 0").select("id", F.year("date").alias("year"))
    return registry.allocate_refs(new, rows.filter("id % 4 = 0").select("ref"), "year", "id").select("id", "ref")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0")
def backfill_candidates(spark, sf_dir):
    return D.registry(spark, sf_dir).filter(registry.needs_backfill(F.col("extraction_result"))).select("id")


@query("""SELECT o_orderkey AS id, 'court ' || c_nationkey AS tribunal, CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0 THEN o_orderkey || '/' || year(o_orderdate) END AS numero_dossier,
 CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 THEN c_name END AS defendeur, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS explication_montant
FROM orders JOIN customer ON o_custkey = c_custkey""")
def backfill(spark, sf_dir):
    return registry.backfill(D.registry(spark, sf_dir)).select("id", "tribunal", "numero_dossier", "defendeur", "explication_montant")


@query("""SELECT o_orderkey AS id, CASE WHEN 1 + (o_orderkey % 4 <> 0)::INT + (o_orderkey % 5 <> 0)::INT + (o_orderkey % 7 = 0)::INT + CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END >= 3 AND o_orderkey % 2 = 0 THEN 'Valide' ELSE 'Anomalie' END AS outcome FROM orders""")
def sufficiency(spark, sf_dir):
    status = F.when(F.col("id") % 2 == 0, "success").otherwise("error")
    return D.registry(spark, sf_dir).select("id", registry.outcome(status, F.col("extraction_result")).alias("outcome"))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'En cours' ELSE {STATUS} END AS status, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE upper(c_name) END AS client FROM orders JOIN customer ON o_custkey = c_custkey")
def registry_update(spark, sf_dir):
    rows = D.registry(spark, sf_dir)
    changes = rows.filter("id % 10 = 0").select("id", F.lit("En cours").alias("status"), F.lit(None).cast("string").alias("client"))
    return registry.update_by_id(rows, changes, ["status", "client"]).select("id", "status", "client")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 0")
def registry_delete(spark, sf_dir):
    rows = D.registry(spark, sf_dir)
    return registry.delete_ids(rows, rows.filter("id % 9 = 0").select("id")).select("id")


@query(f"SELECT o_orderkey AS id, {NORMAL} AS status, 'court ' || c_nationkey AS tribunal FROM orders JOIN customer ON o_custkey = c_custkey")
def registry_listing(spark, sf_dir):
    return registry.listing(D.registry(spark, sf_dir)).select("id", "status", "tribunal")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'court ' || c_nationkey WHEN o_orderkey % 3 <> 0 THEN 'court ' || c_nationkey END AS tribunal,
 CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 = 0 THEN 'a,  , b' ELSE '-' END AS refs FROM orders JOIN customer ON o_custkey = c_custkey""")
def display_record(spark, sf_dir):
    rows = D.registry(spark, sf_dir).withColumn("extraction_result", F.when(F.col("id") % 2 == 0, F.col("extraction_result")))
    shown = rows.select("id", registry.display_record().alias("r"))
    return shown.select("id", "r.tribunal", T.display_list(F.col("r.references_juridiques")).alias("refs"))


@query("""SELECT o_orderkey AS id, k AS position, ['Tribunal', 'Numero du dossier', 'Date de decision', 'Demandeur', 'Defendeur', 'Banque', 'Entreprise', 'Montant', 'References juridiques', 'Decision', 'Justification', 'Resume'][k + 1] AS label,
 coalesce(CASE k WHEN 0 THEN 'court ' || c_nationkey WHEN 1 THEN CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey || '/' || year(o_orderdate) END WHEN 4 THEN CASE WHEN o_orderkey % 7 = 0 THEN c_name END
 WHEN 7 THEN CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) END WHEN 8 THEN CASE WHEN o_orderkey % 6 = 0 THEN '- a' || chr(10) || '-  ' || chr(10) || '- b' END END, 'null') AS value
FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT CAST(range AS INT) AS k FROM range(12))""")
def report_rows(spark, sf_dir):
    return registry.report_rows(D.registry(spark, sf_dir))


# ---- OCR reconciliation

LINES_SQL = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_num FROM lineitem),
w AS (SELECT l_orderkey AS doc_id, psm, line_num, l_partkey,
  CASE WHEN psm = 'psm11' AND l_partkey % 3 = 0 THEN 'المحكمة' ELSE 'p' || l_partkey END || ' s' || l_suppkey || ' q' || CAST(l_quantity AS INT) AS text
  FROM li, (VALUES ('psm11'), ('psm6')) v(psm) WHERE NOT (psm = 'psm11' AND l_partkey % 10 = 0)),
l AS (SELECT doc_id, psm, row_number() OVER (PARTITION BY doc_id, psm ORDER BY line_num) AS line, text FROM w),
rd AS (SELECT doc_id, psm, 3 * count(*) AS words, avg(CAST(l_partkey % 40 + 60 AS DOUBLE)) AS confidence FROM w GROUP BY ALL),
f AS (SELECT *, max(words) OVER (PARTITION BY doc_id) AS most FROM rd),
cl AS (SELECT *, max(confidence) OVER (PARTITION BY doc_id) AS best FROM f WHERE words >= 0.85 * most),
ch AS (SELECT doc_id, psm, words, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, confidence DESC, psm) AS n FROM cl WHERE confidence >= best - 2.0) WHERE n = 1)"""


@query(f"WITH {LINES_SQL} SELECT doc_id, psm, line, text FROM l")
def ocr_lines(spark, sf_dir):
    return ocr.lines(D.words(spark, sf_dir)).select("doc_id", "psm", "line", "text")


@query(f"WITH {LINES_SQL} SELECT doc_id, psm, words, round(confidence, 6) AS confidence FROM rd")
def ocr_confidence(spark, sf_dir):
    return ocr.readings(D.words(spark, sf_dir)).select("doc_id", "psm", "words", F.round("confidence", 6).alias("confidence"))


@query("SELECT CAST(sum(3) AS BIGINT) AS n, round(sum(3 * (l_partkey % 40 + 60)) / 100.0, 3) AS share FROM lineitem, (VALUES ('psm11'), ('psm6')) v(psm) WHERE NOT (psm = 'psm11' AND l_partkey % 10 = 0)")
def ocr_visible_words(spark, sf_dir):
    return ocr.visible_words(D.words(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("share"))


@query(f"WITH {LINES_SQL} SELECT doc_id, CAST(sum(words) AS BIGINT) AS words, round(sum(words * confidence) / sum(words), 6) AS confidence FROM rd GROUP BY doc_id")
def ocr_weighted_confidence(spark, sf_dir):
    return ocr.weighted_confidence(ocr.readings(D.words(spark, sf_dir))).select("doc_id", "words", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {LINES_SQL} SELECT doc_id, psm, words FROM ch")
def ocr_candidate_choice(spark, sf_dir):
    return ocr.choose_reading(ocr.readings(D.words(spark, sf_dir))).select("doc_id", "psm", "words")


@query(f"""WITH {LINES_SQL}, x AS (SELECT l.*, regexp_replace(l.text, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key, ch.psm AS own FROM l JOIN ch USING (doc_id)),
k AS (SELECT DISTINCT doc_id, key FROM x WHERE psm = own),
n AS (SELECT *, max((contains(text, 'المحكمة'))::INT) OVER (PARTITION BY doc_id, psm ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM x WHERE psm <> own),
a AS (SELECT doc_id, text, line, row_number() OVER (PARTITION BY doc_id, key ORDER BY psm, line) AS r FROM n WHERE near = 1 AND (contains(text, 'المحكمة') OR NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = n.doc_id AND k.key = n.key))),
u AS (SELECT doc_id, text, line, true AS supplementary FROM a WHERE r = 1 UNION ALL SELECT doc_id, text, line, false FROM x WHERE psm = own)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY supplementary DESC, line) - 1 AS position, text, supplementary FROM u""")
def ocr_merge(spark, sf_dir):
    merged = ocr.merged_lines(D.words(spark, sf_dir))
    return merged.select("doc_id", F.col("position").cast("long").alias("position"), "text", "supplementary")


@query("""SELECT l_orderkey AS doc_id, min(l_linenumber) AS first, max(l_linenumber) AS last FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 4 <> 0)) GROUP BY l_orderkey, g""")
def ink_runs(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").filter("l_partkey % 4 <> 0").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"))
    return ocr.islands(rows, "doc_id", "row").select("doc_id", "first", "last")


# ---- rules that the queries above leave out


@query("SELECT p_partkey, p_name || ' والمحكمة قضت ودفاع' || repeat('ا', p_size) || ' و ا' AS text FROM part")
def arabic_rejoin(spark, sf_dir):
    text = F.concat(F.lit("\u200f"), F.col("p_name"), F.lit(" و أ \n لمحكمة قضت\u202c و\nدفاع"), F.repeat(F.lit("ا"), F.col("p_size")), F.lit(" و ا"))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.rejoin_ocr_arabic(text).alias("text"))


@query("SELECT o_orderkey, o_orderkey % 4 < 2 AS marked FROM orders")
def justification_prefix(spark, sf_dir):
    text = F.concat(D.pick((" \nولهذه الأسباب", "قضت  المحكمة", "حيث قضت المحكمة", "الأسباب"), F.col("o_orderkey") % 4), F.lit(" "), F.col("o_orderpriority"))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", X.starts_with_marker(text).alias("marked"))


@query("SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 3) AS force_ocr FROM orders")
def upload_flags(spark, sf_dir):
    said = D.pick(("1", " TRUE ", "yes", "On", "0", "false", "2", ""), F.col("o_orderkey") % 8)
    return D.table(spark, sf_dir, "orders").select("o_orderkey", docs.is_truthy(said).alias("force_ocr"))


@query("SELECT id, CASE WHEN o_orderkey IS NULL THEN 404 ELSE 200 END AS http, lower(c_mktsegment) || '_' || o_orderkey || '.pdf' AS file_name, CAST(length(CAST(o_orderkey AS VARCHAR)) AS INT) AS n_bytes FROM (SELECT l_orderkey + l_linenumber AS id FROM lineitem GROUP BY 1) LEFT JOIN (orders JOIN customer ON o_custkey = c_custkey) ON id = o_orderkey")
def registry_files(spark, sf_dir):
    wanted = D.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("id")).distinct()
    found = registry.files_of(D.registry(spark, sf_dir), wanted)
    return found.select("id", "http", "file_name", F.octet_length("file_data").alias("n_bytes"))


@query("SELECT count(*) FILTER (o_orderkey % 3 = 0) AS backfilled FROM orders")
def backfill_count(spark, sf_dir):
    return registry.backfilled(D.registry(spark, sf_dir))


@query("SELECT o_orderkey AS id, is_new, row_number() OVER (ORDER BY is_new DESC, o_orderdate DESC, o_orderkey DESC) AS place FROM (SELECT o_orderkey, o_orderdate, false AS is_new FROM orders UNION ALL SELECT o_orderkey, o_orderdate, true FROM orders WHERE o_orderpriority = '1-URGENT')")
def registry_prepend(spark, sf_dir):
    rows = D.registry(spark, sf_dir).select("id", "date")
    urgent = D.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("date"))
    listed = registry.prepend(rows, urgent).select("id", "is_new", (~F.col("is_new")).alias("old"), (-F.unix_micros("date")).alias("age"), (-F.col("id")).alias("last"))
    return running_total(listed, ["old", "age", "last"], into="place").select("id", "is_new", (F.col("place") + 1).alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS shown FROM orders")
def date_display(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", T.display_date(day).alias("shown"))


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN {MILLIMES.format('o_totalprice')} ELSE {MILLIMES.format('o_totalprice')} + (o_custkey + 1000) * 1000000 + 1000 END AS millimes, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS items FROM orders""")
def interest_recovery(spark, sf_dir):
    # The list names delayed interest without an amount; the grounds state one, an earlier and smaller one before it.
    grounds = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("فائض التأخير قدره 1.000.000 وفائض التأخير الاتفاقي قدره "), D.written((F.col("o_custkey") + 1000) * 1_000_000 + 1000, F.lit(1)), F.lit(" د\n"))
    )
    text = F.concat(
        F.lit(L.BANK_NAME), F.lit("\n"), grounds, F.lit("المبالغ المالية التالية:\n1) أصل الدين ("), D.written(D.millimes(F.col("o_totalprice")), F.lit(0)),
        F.lit(" د)\n2) فائض التأخير الجاري إلى تمام الوفاء\nوبعد الاطلاع"),
    )
    awards = record.applicable_amounts(text, F.lit("original"), F.lit("demandeur"))
    rows = D.dealt(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), awards.alias("a"))
    return rows.select("doc_id", F.col("a.millimes").alias("millimes"), F.size("a.fixed").alias("items"))


@query(f"SELECT o_orderkey AS doc_id, {COURT} AS tribunal, o_orderkey || '/' || year(o_orderdate) AS numero_dossier FROM {LISTED}")
def record_json(spark, sf_dir):
    rows = record.strengthen(D.judgments(spark, sf_dir)).select("doc_id", F.to_json("extraction").alias("json"))
    return rows.select("doc_id", F.get_json_object("json", "$.tribunal").alias("tribunal"), F.get_json_object("json", "$.numero_dossier").alias("numero_dossier"))
