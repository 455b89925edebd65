"""Query op2: all documents packed into sequences of at most 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from keepwell.llm.base import query, table
from keepwell.llm.vector_packing import Limits, pack_texts

LIMITS = Limits(tokens=2048, segments=64, loss=2048)


def packed(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return pack_texts(docs, "doc_id", "text", path, end_id=1, limits=LIMITS)


@query("op2_vector_packing")
def op2_vector_packing(spark, sf):
    return packed(table(spark, sf, "documents"))
