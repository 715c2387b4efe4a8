"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.pii import KINDS, of_kind, personal_data, span_list

    found = personal_data(read_table(spark, sf_dir, "documents"))
    base = F.concat(*(of_kind(k) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.concat(base, "added")).alias("spans"),
        (F.size(base) + F.size("added")).cast("long").alias("n_spans"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.decontam import contamination

    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.exact_dedup import exact_duplicates

    found = exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.simhash_dedup import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.chat import rotate_perspectives

    return rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.lm_score import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.lang_id import held_out, identify_languages

    found = identify_languages(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.warc import warc_round_trip

    return warc_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.token_counts import length_histogram, suffix_sums

    return suffix_sums(length_histogram(read_table(spark, sf_dir, "documents")))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.merkle import folded, proof_digest, tampered_text, verified_manifest

    found = verified_manifest(read_table(spark, sf_dir, "documents"), tampered_text(F.col("doc_id"), F.col("text")))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.col("seen"), F.col("steps")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.sharding import hilbert_shards

    found = hilbert_shards(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def _merkle_sql() -> str:
    """Levels of the trees and of the tree over their tops, one after the other; 8^8 rows a language at most."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"
    digest = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
    )
    ctes = [
        f"c AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, {lower}) ELSE text END AS found FROM documents)",
        f"t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (SELECT doc_id, lang, {digest('text')} AS leaf, {digest('found')} AS seen FROM c))",
        "n0 AS (SELECT lang AS g, i, leaf AS h FROM t)",
    ]

    def climb(name: str, side: str, depth: int) -> None:
        over = "OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {})"
        for k in range(depth):
            before, behind = over.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), over.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            ctes.append(f"{side}{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) > 1 AS up, coalesce(string_agg(h, '') {before}, '') AS l, coalesce(string_agg(h, '') {behind}, '') AS r FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN bool_or(up) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {side}{k} GROUP BY g, i // 8)")

    def fold(source: str, side: str, depth: int, tree: str, at: str) -> str:
        for k in range(depth):
            own = f"{side}{k}"
            source = (
                f"(SELECT f.* REPLACE (CASE WHEN up THEN sha256(l || now || r) ELSE now END AS now, CASE WHEN up THEN proof || l || r ELSE proof END AS proof) "
                f"FROM {source} f JOIN {own} s ON s.g IS NOT DISTINCT FROM f.{tree} AND s.i = f.{at} // {8**k})"
            )
        return source

    climb("n", "s", 8)
    ctes.append("m0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM n8)")
    ctes.append("names AS (SELECT g AS lang, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j, h AS subroot FROM n8)")
    climb("m", "u", 3)
    start = "(SELECT t.*, 0 AS one, j, subroot, seen AS now, '' AS proof FROM t JOIN names ON names.lang IS NOT DISTINCT FROM t.lang)"
    whole = fold(fold(start, "s", 8, "lang", "i"), "u", 3, "one", "j")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, m3.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = m3.h AS verified FROM {whole}, m3"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_decontamination": op2_decontamination,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_language_id": op8_language_id,
        "op9_warc": op9_warc,
        "op10_token_counts": op10_token_counts,
        "op11_phrase_mining": op11_phrase_mining,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_hilbert_sharding": op13_hilbert_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(x, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
        "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""",
        "op6_chat_formatting": """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS i FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, perspective, i, i // 64 AS part, role = perspective AS own, replace(replace(text, '<\\', '<\\\\'), '<|', '<\\|') || '<|end|>' || chr(10) AS body,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
      ELSE '<|user:' || replace(replace(replace(replace(role, '|\\', '|\\\\'), '|>', '|\\>'), '<\\', '<\\\\'), '<|', '<\\|') || '|>' END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM r),
g AS (SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(count(*) FILTER (own) AS BIGINT) AS n_assistant,
    string_agg(head || body, '' ORDER BY i) AS rendered,
    coalesce(string_agg(CASE WHEN own THEN CAST(a AS BIGINT) || ':' || CAST(a + length(body) AS BIGINT) END, ',' ORDER BY i), '') AS mask,
    CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars FROM o GROUP BY ALL)
SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part_offset FROM g""",
        "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS best FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM m""",
        "op11_phrase_mining": """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.k, f.g, f.a, cut, x.a AS l, y.a AS r, 1000 * f.a * t.n // (x.a * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) f JOIN f x ON x.lang = f.lang AND x.g = f.g[1:f.cut] JOIN f y ON y.lang = f.lang AND y.g = f.g[f.cut + 1:f.k] JOIN t ON t.lang = f.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM c),
inner_g AS (SELECT DISTINCT lang, g[i:i + m - 1] AS g, a FROM (SELECT lang, g, a, k, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS m) WHERE m < k)),
x AS (SELECT lang, g, max(a) AS longer FROM inner_g GROUP BY ALL),
s AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN x USING (lang, g) WHERE o = 1 AND (longer IS NULL OR 100 * longer < 100 * b.a)),
k AS (SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000""",
        "op12_merkle_manifest": _merkle_sql(),
    }
