"""Two public tokenizers aligned over all documents."""

import public_tokenizers
from pyspark.sql import functions as F

from keepwell.llm.base import query, table
from keepwell.llm.token_alignment import alignment

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@query("op12_token_alignment")
def token_alignment(spark, sf):
    """Tokens, groups and links per document, and how common its linked id pairs are."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment(table(spark, sf, "documents"), "doc_id", "text", *map(public_tokenizers.path, FILES),
                     keep={"groups_sha256": digest})
