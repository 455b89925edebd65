"""Query op4: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keepwell.llm.base import query, table
from keepwell.llm.deobfuscate import KINDS, find_identifiers


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op4_deobfuscate")
def op4_deobfuscate(spark, sf):
    found = find_identifiers(table(spark, sf, "documents").select("doc_id", "text"), "text")
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
