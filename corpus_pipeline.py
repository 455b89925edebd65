"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``.

Defined cases: null texts count as empty; a document whose lines all repeat earlier
ones stays with an empty text until the near-duplicate stage keeps one empty document;
documents without an identifier are never dropped as copies; repeated rows with one
identifier share their fate; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keepwell.llm.base import table, without
from keepwell.llm.line_join import dedup_lines
from keepwell.llm.pivot_simhash import near_duplicates
from keepwell.llm.q_decontaminate import WINDOW
from keepwell.llm.q_packing import packed
from keepwell.llm.q_quality import CUT, trained
from keepwell.llm.q_simhash import DISTANCE, SHINGLE
from keepwell.llm.rule_quality import score
from keepwell.llm.wu_manber import decontaminate
from keepwell.session import settle

#: SQL expresses neither the classifier's fit nor the packing; tests hold ``run`` against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labels, does not reject."""
    rules = trained(docs, table(spark, sf_dir, "labels"))
    return score(docs, "text", rules, CUT).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line."""
    out = dedup_lines(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest identifier."""
    groups = near_duplicates(docs, "doc_id", "text", SHINGLE, DISTANCE)
    gone = settle(groups.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    return without(docs, "doc_id", gone)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), "item_id", "text", window=WINDOW)
    return found.where("n_hit = 0").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences."""
    return packed(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
