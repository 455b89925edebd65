"""The audit of five filters over all documents."""

from pyspark.sql import functions as F

from keepwell.llm.base import query, table
from keepwell.llm.filter_audit import coalitions, failures, masks, steps

LETTERS = "ABCDE"
CONDITIONS = {
    "A": "size(words) < 50",
    "B": "100 * size(array_distinct(words)) < 65 * size(words)",
    "C": "100 * upper > 5 * chars",
    "D": "text rlike '[#$%&*|]'",
}

_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, mask, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT substr('ABCDE', i, 1) AS letter, (1 << (i - 1))::INT AS bit FROM range(1, 6) r(i)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
stepped AS (
  SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(k)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own != 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before != 0 AND mask & own != 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own != 0 AND good = 1 THEN n ELSE 0 END) AS lost_good,
    sum(CASE WHEN mask & before = 0 AND mask & own != 0 AND toxic = 1 THEN n ELSE 0 END) AS lost_toxic
  FROM masks, stepped GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, lost_good::BIGINT AS good_lost, lost_toxic::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted"""


@query("op11_filter_audit", _SQL)
def filter_audit(spark, sf):
    """One row per source, order of the five filters and step."""
    marks = table(spark, sf, "labels").select(
        F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    failed = failures(table(spark, sf, "documents"), "doc_id", "text", "source", CONDITIONS)
    values = coalitions(masks(failed, marks, 1 << LETTERS.index("E")), len(LETTERS))
    return steps(values, LETTERS).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})
