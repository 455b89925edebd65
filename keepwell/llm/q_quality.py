"""Query op7: quality scores of all documents, learned without the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepwell.llm.base import crc_fold, query, table
from keepwell.llm.rule_quality import Fit, Rules, fit, score

CUT = 0.3


def trained(docs: DataFrame, labels: DataFrame) -> Rules:
    known = labels.where(crc_fold(F.col("doc_id")) != 0).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    return fit(docs, "doc_id", "text", known, Fit())


@query("op7_rule_quality")
def op7_rule_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = trained(docs, table(spark, sf, "labels"))
    return score(docs, "text", rules, CUT).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
