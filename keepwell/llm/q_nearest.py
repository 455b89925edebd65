"""The twenty nearest vectors of every twentieth row, against all rows."""

from pyspark.sql import functions as F

from keepwell.llm.base import query, table
from keepwell.llm.multi_index import nearest

NEAREST, EVERY = 20, 20


@query("op13_multi_index")
def multi_index(spark, sf):
    found = nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", NEAREST, F.col("id") % EVERY == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
