"""Query op3: copies among all documents, by a stream with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.llm.base import query
from keepwell.llm.stream_dedup import dedup

SQL = """WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""


@query("op3_stream_dedup", SQL)
def op3_stream_dedup(spark, sf):
    found = dedup(spark, f"{sf}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
