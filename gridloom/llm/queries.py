"""Queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, chat, exact_dedup, html_text, jaccard_join, language, mixing, packing, periodic_runs, quality, suffix_dedup, tokens, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokens.byte_bpe(vocabulary()))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(_table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.chat_report(turns.unionByName(probe))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_tree.token_report(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(periodic_runs.with_tails(_table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict:
    every = (op1_jaccard_join, op2_quality, op3_mixing, op4_packing, op5_suffix_dedup, op6_toxicity, op7_html, op8_language, op9_chat, op10_exact_dedup, op11_bpe, op12_runs, op13_whitening)
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON r.id = u.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM u GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""

OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    replace(replace(text, '\', '\\'), '<|', '<\|') AS safe, replace(replace(role, '\', '\\'), '<|', '<\|') AS safe_role FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN before = role THEN length('<|next|>') ELSE length(safe_role) + length('<|turn|><|text|><|end|>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

OP10_SQL = r"""
WITH flat AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS flat FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(flat) AS text_sha256
FROM flat WINDOW w AS (PARTITION BY flat)"""

#: One earliest-deadline-first run over all slots.
OP3_SQL = f"""
WITH RECURSIVE total AS (SELECT greatest({mixing.BUCKETS}, (count(*) + {mixing.BUCKET_DOCS - 1}) // {mixing.BUCKET_DOCS}) AS buckets FROM documents),
numbered AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS s_null,
    row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % buckets, doc_id) - 1 AS r FROM documents, total),
sizes AS (SELECT s, s_null, count(*) AS n, (count(*) + {mixing.BLOCK_DOCS - 1}) // {mixing.BLOCK_DOCS} AS blocks FROM numbered GROUP BY ALL),
weighed AS (SELECT *, greatest(1, CAST(round(pow(n, {mixing.TEMPER}) / sum(pow(n, {mixing.TEMPER})) OVER () * 1e12) AS BIGINT)) AS w FROM sizes),
listed AS (
  SELECT list(w ORDER BY s, s_null) AS ws, CAST(sum(w) AS BIGINT) AS total, list(s ORDER BY s, s_null) AS ss, list(s_null ORDER BY s, s_null) AS nulls,
    max(ceil(blocks * (SELECT sum(w) FROM weighed) / w)) AS slots FROM weighed),
steps AS (
  SELECT 0 AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS served, CAST(0 AS BIGINT) AS best FROM listed
  UNION ALL
  SELECT t + 1, list_transform(served, lambda x, j: CASE WHEN j = best THEN x + 1 ELSE x END), best FROM (
    SELECT t, served, list_min(list_transform(list_filter(list_transform(ws, lambda w, j: [((served[j] + 1) * total + w - 1) // w, j, served[j] * total - w * (t + 1)]),
      lambda c: c[3] < 0), lambda c: c[1] * 100000 + c[2])) % 100000 AS best
    FROM steps, listed WHERE t < slots)),
picks AS (SELECT ss[best] AS s, nulls[best] AS s_null, served[best] - 1 AS pick, t - 1 AS slot FROM steps, listed WHERE t > 0)
SELECT doc_id, n.s AS source, n.s_null AS source_null, r // {mixing.BLOCK_DOCS} AS block, pick // blocks AS epoch, slot, r % {mixing.BLOCK_DOCS} AS place
FROM numbered n JOIN sizes z ON n.s = z.s AND n.s_null = z.s_null
JOIN picks p ON p.s = n.s AND p.s_null = n.s_null AND p.pick % blocks = r // {mixing.BLOCK_DOCS}
WHERE slot <= (SELECT max(slot) FROM picks p JOIN sizes z ON p.s = z.s AND p.s_null = z.s_null AND p.pick = z.blocks - 1)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op3_mixing": OP3_SQL, "op9_chat": OP9_SQL, "op10_exact_dedup": OP10_SQL}
