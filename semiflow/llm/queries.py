"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semiflow.llm import ann, chat, decontaminate, langid, license_scan, mixing, neardup, pii, toxicity, warc
from semiflow.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), said.alias("text")) for i, r in enumerate(("user", "assistant"))])))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.formatted(turns.withColumn("parts", chat.text_part(F.col("text")))))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archived(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (op1_mixing, op2_pii, op3_neardup, op4_langid, op5_toxicity, op6_chat, op7_ann, op8_decontamination, op9_warc, op10_licenses)
}

SQL_1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '?' || coalesce(text, ''))), 1, 8) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(n) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS whole_size,
         sum(source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS UNBOUNDED PRECEDING) - source_size AS before_size,
         sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM w
), f AS (
  SELECT *, 4 * source_size * left_w <= (3 * whole_size - 4 * before_size) * w AS is_full FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN source_size * 2.0::DOUBLE
              ELSE CAST(w AS DOUBLE) * CAST(3 * whole_size - sum(CASE WHEN is_full THEN 4 * source_size ELSE 0 END) OVER () AS DOUBLE)
                   / CAST(2 * sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM f
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 1) ELSE 0 END AS base_copies FROM t
), g2 AS (
  SELECT *, target - base_copies * source_size AS goal FROM g
), u AS (
  SELECT source, h, sum(n) AS n FROM d GROUP BY source, h
), c AS (
  SELECT u.source, u.h, u.n, g2.goal, sum(u.n) OVER (PARTITION BY u.source ORDER BY u.h ROWS UNBOUNDED PRECEDING) AS upto
  FROM u JOIN g2 ON u.source IS NOT DISTINCT FROM g2.source
), b AS (
  SELECT source, min(h) AS h FROM c WHERE upto > goal GROUP BY source
), e AS (
  SELECT c.source, c.h + CASE WHEN c.upto - c.goal < c.goal - (c.upto - c.n) THEN 1 ELSE 0 END AS threshold
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.h = b.h
), k AS (
  SELECT d.doc_id, d.n, g2.source_size, g2.target,
         CAST(g2.base_copies + CASE WHEN e.threshold IS NULL OR d.h < e.threshold THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM d JOIN g2 ON d.source IS NOT DISTINCT FROM g2.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, n AS size, source_size, target, copies * n AS taken, copies FROM k
"""


def escaped_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL_6 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN starts_with(role, '>') THEN '\\' ELSE '' END || {escaped_sql('role')} || CASE WHEN ends_with(role, '<') THEN '\\' ELSE '' END AS er, {escaped_sql('text')} AS et FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, et), '') AS loss,
         sum(2 + length(er) + 3 + length(et) + 5) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS n_expanded
FROM g
"""

ORACLE_SQL = {"op1_mixing": SQL_1, "op6_chat": SQL_6}
