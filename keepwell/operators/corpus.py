"""The retrieval corpus: playbook sections, customer cases, their vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from keepwell.functions import render
from keepwell.functions.text import stripped
from keepwell.operators.ranking import hex_number
from keepwell.session import settle


def sections(texts: DataFrame, key: str, column: str, tag: str = render.SECTION_TAG,
             separator: str = " ") -> DataFrame:
    """(key, section_no, section): the text split at the tag, empty parts left out.

    Each part gets its tag back. Numbers count the kept parts from 1.
    """
    parts = F.filter(
        F.transform(F.split(F.col(column), _literal(tag), -1), stripped), lambda p: p != "")
    prefix = f"{tag}{separator}" if tag.strip() else ""
    return texts.select(key, F.posexplode(parts).alias("_at", "_part")).select(
        key, (F.col("_at") + 1).alias("section_no"), F.concat(F.lit(prefix), "_part").alias("section"))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E" if text.strip() else text


def cases(customers: DataFrame, latest: DataFrame, key: str = "customerID", limit: int | None = None,
          order: str | None = None) -> DataFrame:
    """(key, text) of churned customers with their last logged intervention.

    ``latest`` is (key, intervention_type, outcome), one row per customer. Every
    case is told unless a ``limit`` asks for the first few by ``order``.
    """
    churned = customers.where(F.col("Churn") == 1)
    if limit is not None:
        churned = churned.orderBy(order or key).limit(limit)
    return churned.join(latest, key, "left").select(key, render.case_text().alias("text"))


def corpus(section_rows: DataFrame, case_rows: DataFrame) -> DataFrame:
    """(doc_id, kind, text) of both kinds."""
    return section_rows.select(
        F.concat_ws("-", F.lit("section"), *[F.col(c).cast("string") for c in section_rows.columns[:-1]]).alias("doc_id"),
        F.lit("section").alias("kind"), F.col(section_rows.columns[-1]).alias("text"),
    ).unionByName(case_rows.select(
        F.concat_ws("-", F.lit("case"), F.col(case_rows.columns[0]).cast("string")).alias("doc_id"),
        F.lit("case").alias("kind"), "text"))


def fit_embedding(texts: DataFrame, column: str = "text", dimensions: int = 512) -> PipelineModel:
    """Term weights hashed to a fixed length; fitted on the corpus, reused for queries."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]).fit(texts)


def embed(texts: DataFrame, embedding: PipelineModel) -> DataFrame:
    return embedding.transform(texts).withColumn("vector", vector_to_array("_unit")).drop(
        "_words", "_counts", "_weights", "_unit")


def term_weights(texts: DataFrame, key: str, column: str = "text", dimensions: int = 512) -> DataFrame:
    """(key, bucket, weight): term weights of every text, hashed to ``dimensions`` buckets, of length 1.

    The same weighting as ``fit_embedding`` as rows: how often a bucket's words stand
    in the text, times log((n + 1) / (texts with the bucket + 1)). Words are counted
    before the shuffle, and a text has at most ``dimensions`` rows. Texts without words
    or without a key have no rows; keys are unique.
    """
    named = texts.where(F.col(key).isNotNull())
    word = F.explode(F.split(F.lower(column), r"[^\p{L}\p{N}]+")).alias("word")
    bucket = (hex_number(F.substring(F.md5("word"), 1, 8)) % dimensions).alias("bucket")
    counts = settle(named.select(key, word).where("word != ''").groupBy(key, bucket).agg(F.count("*").alias("n")), "term-counts")
    total = named.agg(F.count("*").alias("n")).scalar()
    idf = counts.groupBy("bucket").agg(F.log((total + 1) / (F.count("*") + 1)).alias("idf"))  # one row per bucket
    raw = counts.join(F.broadcast(idf), "bucket").select(key, "bucket", (F.col("n") * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "bucket", F.coalesce(F.try_divide("raw", length), F.lit(0.0)).alias("weight"))
