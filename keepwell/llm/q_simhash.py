"""Query op5: SimHash groups of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.llm.base import query, table
from keepwell.llm.pivot_simhash import near_duplicates

SHINGLE, DISTANCE = 3, 3


@query("op5_pivot_simhash")
def op5_pivot_simhash(spark, sf):
    found = near_duplicates(table(spark, sf, "documents"), "doc_id", "text", SHINGLE, DISTANCE)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
