"""Query op6: every page written to archives and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.llm.base import query, table
from keepwell.llm.warc_chunks import round_trip

LEAST = 1000

SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= {LEAST} THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to, CASE WHEN page_id = keep THEN true END AS intact FROM k"""


@query("op6_warc_chunks", SQL)
def op6_warc_chunks(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("long")
    return round_trip(spark, pages, LEAST).select(
        number("record_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"), "intact")
