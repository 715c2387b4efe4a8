"""Judgments, OCR words and a registry, rendered in Spark from orders, customers and line items.

Each extracted fact is a source column, so an oracle reads the column and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.operators.tables import scratch_path

CITIES = ("تونس", "سوسة", "صفاقس", "بنزرت", "قابس")
MONTH_NAMES = ("جانفي", "فيفري", "مارس", "أفريل", "ماي", "جوان", "جويلية", "أوت", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر")
RULING_WORDS = ("بإقرار الحكم الابتدائي", "بتعديل الحكم الابتدائي", "بنقض الحكم الابتدائي", "بأداء المبالغ المذكورة")
FILLER = "وبعد الاطلاع على ما يفيد استدعاء الخصوم وعلى سائر الوثائق المظروفة بالملف وبعد المفاوضة القانونية صرح بما يلي علنا بالجلسة العمومية المنعقدة "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Tasks for work whose cost is in its expressions: at least one a core, as many as shuffles have."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for heavy expressions: a file that makes fewer splits than there are cores is dealt out first."""
    df = table(spark, sf_dir, name)
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(tasks(spark))


#: Rows of a table that a task of heavy expressions takes.
ROWS_A_TASK = 50_000


def tasks_of(spark: SparkSession, df: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """Tasks for a table's rows: `tasks`, or more where a task would have more than so many rows. Parquet's footers tell their number."""
    return max(tasks(spark), -(-df.count() // rows))


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows for heavy expressions, dealt out evenly: its files make no more busy tasks than they have row groups."""
    df = table(spark, sf_dir, name)
    return df.repartition(tasks_of(spark, df))


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def millimes(x: Column) -> Column:
    """A double in whole thousandths: of its six decimals, rounded half up. Where its double is clearly nearest to one whole number, that is the one."""
    whole = F.rint(x * 1000)
    exact = F.round(x.cast("decimal(20,6)") * 1000).cast("long")
    return F.when((F.abs(x * 1000 - whole) < 0.4) & (F.abs(x) < 1e9), whole.cast("long")).otherwise(exact)


def written(m: Column, style: Column) -> Column:
    """Millimes in one of four styles, all of which name three digits of millimes."""
    three = lambda x: F.substring((x + 1000).cast("string"), 2, 3)
    grouped = F.when((m >= 0) & (m < 1_000_000), F.floor(m / 1000).cast("string"))
    grouped = grouped.when((m >= 0) & (m < 1_000_000_000), F.concat(F.floor(m / 1_000_000).cast("string"), F.lit(","), three(F.floor(m / 1000) % 1000)))
    grouped = grouped.otherwise(F.format_number(F.floor(m / 1000), 0))
    last = F.when(m >= 0, three(m % 1000)).otherwise(F.lpad((m % 1000).cast("string"), 3, "0"))
    dotted = F.replace(grouped, F.lit(","), F.lit("."))
    dots = F.concat(dotted, F.lit("."), last)
    return (
        F.when(style == 0, F.concat(dotted, F.lit(","), last))
        .when(style == 1, dots)
        .when(style == 2, F.concat(grouped, F.lit(","), last))
        .otherwise(F.translate(dots, L.WESTERN_DIGITS, L.ARABIC_DIGITS))
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a judgment for each order.

    Bank's role by o_orderkey % 5 (none at 4), ruling by (o_orderkey div 5) % 4, decoy markers
    by o_orderkey % 3, one interest item without amount where a line is returned.
    """
    # Rendering is cheap to move and dear to run: a number of tasks that grows with the rows, which Spark doesn't merge by size.
    # Both sides are dealt out by order before they are grouped and joined, so that a line item moves once.
    lines = table(spark, sf_dir, "lineitem")
    dealt = tasks_of(spark, lines, 4 * ROWS_A_TASK)
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag").repartition(dealt, "l_orderkey").withColumn("m", millimes(F.col("l_extendedprice")))
    # What a line item says is written before items are grouped: Spark compiles no function of an array's elements.
    item = F.concat(F.col("l_linenumber").cast("string"), F.lit(") قسط رقم الدين ("), written(F.col("m"), F.col("l_orderkey") % 4), F.lit(" د)"))
    cited = F.concat(F.lit("الفصل "), (F.col("l_partkey") % 300 + 1).cast("string"), F.when(F.col("l_partkey") % 7 == 0, F.lit(" من عقد القرض")).otherwise(""), F.lit(" و"))
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", item.alias("item"), cited.alias("cited"))
    lines = lines.select("l_orderkey", line.alias("line"), (F.col("l_returnflag") == "R").alias("returned"))
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.max("returned").alias("returned"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    orders = orders.repartition(dealt, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    key, role, ruling = F.col("o_orderkey"), F.col("o_orderkey") % 5, F.floor(F.col("o_orderkey") / 5) % 4
    items, cited = F.array_join("lines.item", "\n"), F.array_join("lines.cited", " ")
    interest = F.when(F.col("returned"), F.lit("\n99) الفائض الجاري بداية من تاريخ الحلول إلى تمام الوفاء")).otherwise("")
    bank = F.lit(L.BANK_NAME)
    party = (
        F.when(role == 0, F.concat(F.lit("المدعي: "), bank))
        .when(role == 1, F.concat(F.lit("المستأنف ضده: "), bank))
        .when(role == 2, F.concat(F.lit("المطلوب: "), bank))
        .when(role == 3, F.concat(F.lit("تعقيب مرفوع من "), bank))
        .otherwise("الأطراف محجوبة")
    )
    date = F.concat(F.day("o_orderdate").cast("string"), F.lit(" "), pick(MONTH_NAMES, F.month("o_orderdate") - 1), F.lit(" "), F.year("o_orderdate").cast("string"))
    text = F.concat(
        F.lit("المحكمة الابتدائية ب"), pick(CITIES, F.col("c_nationkey") % 5), F.lit("\nقضية عدد: "), key.cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"),
        F.lit("\nبتاريخ "), date, F.lit("\n"), party, F.lit("\n"), F.lit(FILLER), F.lit("\n"),
        F.repeat(F.lit("ولهذه الأسباب طلب نائبه الحكم لصالح منوبه\n"), (key % 3).cast("int")),
        F.lit("عملا بأحكام "), cited, F.lit(" غيرها.\n"), F.lit("المبالغ المالية التالية:\n"), items, interest,
        F.lit("\nوبعد الاطلاع على الأوراق\nولهذه الأسباب\nقضت المحكمة "), pick(RULING_WORDS, ruling), F.lit("\n"), key.cast("string"), F.lit("\nعن الطور الحالي. ./\nوحرر في تاريخه"),
    )
    return orders.select(key.alias("doc_id"), text.alias("text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words of two readings: a document for each order, a line of three words for each line item.

    The second reading misses a line where l_partkey % 10 = 0, and reads an anchor before every third.
    """
    # Line numbers repeat within an order, so lines are numbered anew; an order has a handful of them.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # A line item makes eight words: it is dealt out before, by a number of tasks that grows with the rows and that Spark doesn't
    # merge by size, so that words move no more and a task's words are sorted in its memory.
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = items.repartition(tasks_of(spark, items, 2 * ROWS_A_TASK), "l_orderkey")
    line = items.select("l_orderkey", F.row_number().over(order).alias("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity")
    readings = line.withColumn("psm", F.explode(F.array(F.lit("psm11"), F.lit("psm6"))))
    second = F.col("psm") == "psm11"
    readings = readings.filter(~(second & (F.col("l_partkey") % 10 == 0)))
    lead = F.when(second & (F.col("l_partkey") % 3 == 0), F.lit("المحكمة")).otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    parts = F.array(lead, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")), F.lit(" "))
    every = readings.select("l_orderkey", "l_linenumber", "l_partkey", "psm", F.posexplode(parts).alias("k", "text"))
    return every.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "psm", (F.col("l_linenumber") * 10 + F.col("k")).cast("int").alias("idx"),
        F.lit(1).alias("block_num"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("par_num"), F.col("l_linenumber").cast("int").alias("line_num"), "text",
        F.when(F.col("k") == 3, -1.0).otherwise((F.col("l_partkey") % 40 + 60).cast("double")).alias("conf"),
    )


STATUS_POOL = ("Valide", "En cours", "Anomalie", "valide", "Invalide", "pending", "")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry row for each order; every third has a record whose flat columns are still null or empty."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    pending = key % 3 == 0
    court = F.concat(F.lit("court "), F.col("c_nationkey").cast("string"))
    number = F.concat(key.cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"))
    blank = lambda x: F.when(pending & (key % 2 == 0), F.lit("")).when(pending, F.lit(None)).otherwise(x)
    from docketry.operators import schema as S

    values = {
        "tribunal": court, "numero_dossier": F.when(key % 4 != 0, number), "montant": F.when(key % 5 != 0, F.col("o_totalprice").cast("decimal(20,2)").cast("string")),
        "references_juridiques": F.when(key % 6 == 0, F.array(F.lit("a"), F.lit(" "), F.lit("b"))), "parties": F.struct(F.lit(None).cast("string").alias("demandeur"), F.when(key % 7 == 0, F.col("c_name")).alias("defendeur")),
        "montant_justification": F.col("o_orderpriority"),
    }
    record = F.struct(*(values.get(k, F.lit(None)).cast(v).alias(k) for k, v in S.FIELDS.items()))
    null = F.lit(None).cast("string")
    return rows.select(
        key.alias("id"), F.concat(F.lit("D-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad((key % 500).cast("string"), 4, "0")).alias("ref"),
        F.upper("c_name").alias("client"), F.col("o_orderdate").cast("timestamp").alias("date"), pick(STATUS_POOL, key % 7).alias("status"),
        F.concat(F.lower("c_mktsegment"), F.lit("_"), key.cast("string"), F.lit(".pdf")).alias("file_name"), key.cast("string").cast("binary").alias("file_data"), record.alias("extraction_result"),
        blank(court).alias("tribunal"), blank(number).alias("numero_dossier"), null.alias("date_decision"), null.alias("demandeur"), null.alias("defendeur"), blank(F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("montant"),
        null.alias("explication_montant"), F.lit(None).cast("array<string>").alias("references_juridiques"), blank(null).alias("decision"), null.alias("decision_justification"), null.alias("resume"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): a model's reply for each order, clean, fenced, wrapped in prose, cut short, empty or with odd values."""
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    body = F.concat(F.lit('{"tribunal": "T'), (key % 9).cast("string"), F.lit('", "numero_dossier": "'), (key + 100).cast("string"), F.lit(".2019\", \"type_jugement\": \""), F.when(key % 2 == 0, "original").otherwise("autre"),
        F.lit('", "date_decision": "2020/1/'), (key % 28 + 1).cast("string"), F.lit('", "montant": "'), F.when(key % 4 == 0, "Inconnu").otherwise("1,000"), F.lit('", "parties": {"demandeur": "س.س", "defendeur": "Societe '), key.cast("string"), F.lit('"}, "references_juridiques": ["a", "", "null", " b "]}'))
    raw = (
        F.when(key % 6 == 0, body).when(key % 6 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(key % 6 == 2, F.concat(F.lit("Voici: "), body, F.lit(" fin")))
        .when(key % 6 == 3, F.substring(body, 1, 60)).when(key % 6 == 4, F.lit("aucun objet")).otherwise(F.concat(F.lit(" "), body))
    )
    return rows.select(key.alias("doc_id"), raw.alias("raw"))


def arrived(spark: SparkSession, label: str, chunks: list[DataFrame]) -> str:
    """A folder of files as a stream would find them: each chunk's file written after the one before."""
    path = scratch_path(spark, label)
    for chunk in chunks:
        chunk.coalesce(1).write.mode("append").parquet(path)
    return path


def retry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one to three attempts for each order (see streaming.states).

    Attempt n begins n hours into the order's day; its result follows within 900 s, beyond the limit
    for a third, or never where (o_orderkey + n) % 5 = 0. A sixth of the first attempts lacks its
    start, every fourth order's events come twice, and events arrive up to an hour late.
    """
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.col("o_orderdate").cast("timestamp").alias("day"), F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("n"))
    n = F.col("n")
    start = F.timestamp_micros(F.unix_micros("day") + n * 3_600_000_000)
    end = F.timestamp_micros(F.unix_micros("day") + n * 3_600_000_000 + (k * 37 + n * 101) % 900 * 1_000_000 + 1)
    failed = (k + n) % 3 == 0
    none = F.lit(None)
    begun = F.when((k % 6 != 0) | (n != 1), F.struct(F.lit("start").alias("kind"), start.alias("ts"), none.cast("string").alias("service"), none.cast("boolean").alias("sufficient"), none.cast("string").alias("method"), none.cast("string").alias("error")))
    ended = F.when((k + n) % 5 != 0, F.struct(
        F.lit("result").alias("kind"), end.alias("ts"), F.when(failed, "error").otherwise("success").alias("service"), (k % 2 == 0).alias("sufficient"),
        F.when(~failed, "native").alias("method"), F.when(failed, F.concat(F.lit("error "), k.cast("string"))).alias("error"),
    ))
    copies = F.when(k % 4 == 0, F.array(F.lit(0), F.lit(20))).otherwise(F.array(F.lit(0)))
    rows = rows.select(k.alias("id"), n.alias("attempt"), F.explode(F.array_compact(F.array(ended, begun))).alias("e"), copies.alias("copies")).select("*", F.explode("copies").alias("again"))
    late = (F.col("id") * 13 % 40 + F.col("again")) * 60_000_000
    return rows.select("id", "attempt", "e.kind", "e.ts", F.timestamp_micros(F.unix_micros("e.ts") + late).alias("received"), "e.service", "e.sufficient", "e.method", "e.error")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(upload_id, client, content, received, chunk): a file for each order; every third is sent again in a later chunk, every ninth then has other content."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, again = F.col("o_orderkey"), F.col("again")
    rows = rows.withColumn("again", F.explode(F.when(key % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    content = F.concat(F.lit("file of "), key.cast("string"), F.when((again == 1) & (key % 9 == 0), F.lit(" revised")).otherwise(""))
    return rows.select(
        key.alias("upload_id"), F.upper("c_name").alias("client"), content.alias("content"), F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + again * 86_400_000_000).alias("received"),
        F.year("o_orderdate").alias("year"), (key % 3 + again).cast("int").alias("chunk"),
    )
