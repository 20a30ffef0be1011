"""The corpus queries, each its operator over a whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import conversation_repair, decontamination, embedding_dedup, licenses, mixture, paragraph_dedup, periodic_runs, quality_ranking, quality_rules, secrets, simhash, token_counts, warc_zip
from strandline.llm.common import table


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found", "text_hash")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.in_training_order(mixture.mix_sources(table(spark, sf_dir, "documents"))).drop("occurrences")
    return mixed.withColumn("position", F.round("position", 9))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(conversations), conversations)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed_by = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return periodic_runs.summarise_runs(table(spark, sf_dir, "documents"), changed_by)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_paragraphs, op2_secrets, op3_decontamination, op4_licenses, op5_mixture, op6_token_counts, op7_quality, op8_warc, op9_simhash, op10_quality_rules, op11_embeddings, op12_conversation_repair, op13_periodic_runs)}


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT no_source, sk, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY no_source, sk) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM w),
t AS (SELECT no_source, sk, source_size, place, least(cap::DOUBLE, max((total - caps_before)::DOUBLE / weights_left::DOUBLE) OVER () * weight::DOUBLE) AS target FROM l),
o AS (SELECT d.*, source_size, place, target,
  coalesce(sum(size) OVER (PARTITION BY no_source, sk ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d JOIN t USING (no_source, sk)),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole FROM o),
g AS (SELECT *, least(greatest(floor(target + 0.5)::BIGINT - whole * source_size - off, 0), size) AS last_words FROM f),
p AS (SELECT *, CASE WHEN whole > 0 THEN size ELSE last_words END AS words, CASE (place - 1) % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS from_w,
  CASE (place - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS to_w FROM g),
q AS (SELECT *, least((off::DOUBLE + words::DOUBLE / 2) / nullif(target, 0), 1.0::DOUBLE) AS share FROM p)
SELECT doc_id, size, source_size, target, (whole * size + last_words)::BIGINT AS taken, (CASE WHEN size > 0 THEN whole ELSE 0 END + CASE WHEN last_words > 0 THEN 1 ELSE 0 END)::INTEGER AS passes,
  round(CASE WHEN words > 0 THEN CASE WHEN from_w = to_w THEN share ELSE (sqrt(from_w * from_w + 2 * (to_w - from_w) * ((from_w + to_w) / 2) * share) - from_w) / (to_w - from_w) END END, 9) AS position FROM q
"""

OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN f USING (h)
"""

OP12_SQL = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters FROM conversations),
keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN letters]), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 20 AS kind FROM raw),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, left(role, 1) AS initial FROM damaged),
judged AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
marked AS (SELECT conv_id, i, initial, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
ins(st, went, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II'), (2, 2, 10, 'II'), (3, 3, 10, 'II')),
act(was, wanted, now, c, e) AS (VALUES (0, '', 0, 2, 'D'), (1, '', 1, 2, 'D'), (2, '', 2, 2, 'D'), (3, '', 3, 2, 'D'), (0, '', 2, 1, 'R'), (1, '', 2, 1, 'R'), (2, '', 3, 1, 'R'), (3, '', 2, 1, 'R'), (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (3, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K')),
lo(conv_id, i, st, cost, audit) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '' FROM marked
  UNION ALL SELECT conv_id, i, st, min(cost), arg_min(audit, (cost, audit)) FROM (
    SELECT l.conv_id, m.i, act.now AS st, l.cost + ins.c + act.c + CASE WHEN act.e = 'D' THEN 0 ELSE m.extra END AS cost, l.audit || ins.a || act.e AS audit
    FROM lo l JOIN ins ON ins.st = l.st JOIN act ON act.was = ins.went JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i + 1
    WHERE (act.e = 'D' OR NOT m.must_go) AND (act.e <> 'K' OR act.wanted = m.initial)) GROUP BY conv_id, i, st),
best AS (SELECT l.conv_id, min(l.cost + ins.c) AS cost, arg_min(l.audit || ins.a, (l.cost + ins.c, l.audit || ins.a)) AS audit
  FROM lo l JOIN ins ON ins.st = l.st AND ins.went IN (0, 3) JOIN (SELECT conv_id, max(i) AS n FROM marked GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM l.conv_id AND z.n = l.i GROUP BY l.conv_id),
steps AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS j, audit FROM best),
edits AS (SELECT conv_id, j, audit[j] AS e, len(replace(audit[1:j], 'I', '')) AS i, len(replace(audit[1:j], 'D', '')) AS o FROM steps),
rows_of AS (SELECT d.conv_id, d.j, d.e, d.o, p.role, p.text, p.initial FROM edits d LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i AND d.e <> 'I' WHERE d.e <> 'D'),
named AS (SELECT *, o - max(CASE WHEN o = 1 AND e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS turn_of FROM rows_of),
digest AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN turn_of % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM named GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN digest ON digest.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """The others learn, hash or align in ways beyond SQL; the tests hold them against brute force."""
    return {"op5_mixture": OP5_SQL, "op8_warc": OP8_SQL, "op12_conversation_repair": OP12_SQL}
