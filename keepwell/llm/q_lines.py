"""Query op8: lines of all documents that repeat an earlier line, nearly or exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.llm.base import query, table
from keepwell.llm.line_join import identified, removed_by_document, removed_of, repeated_ids

SQL = """WITH l AS (SELECT doc_id, i, list_distinct(list_filter(string_split_regex(s[i + 1], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
k AS (SELECT doc_id, i, list_sort(w) AS w FROM l WHERE len(w) > 0),
u AS (SELECT w, min((doc_id, i)) AS f, row_number() OVER () AS id FROM k GROUP BY w),
x AS (SELECT id, f, len(w) AS n, unnest(w) AS t FROM u),
df AS (SELECT t, count(*) AS c FROM x GROUP BY t),
p AS (SELECT id, f, n, t, row_number() OVER (PARTITION BY id ORDER BY c, t) AS r FROM x JOIN df USING (t)),
q AS (SELECT * FROM p WHERE r <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM q a JOIN q b ON a.t = b.t AND b.f < a.f AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT c.a AS id FROM c JOIN u x ON x.id = c.a JOIN u y ON y.id = c.b
  WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (len(x.w) + len(y.w))),
gone AS (SELECT k.doc_id, k.i FROM k JOIN u ON u.w = k.w LEFT JOIN m ON m.id = u.id WHERE m.id IS NOT NULL OR (k.doc_id, k.i) <> u.f),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(i::VARCHAR, ',' ORDER BY i) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
  coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


@query("op8_line_join", SQL)
def op8_line_join(spark, sf):
    docs = table(spark, sf, "documents")
    own = identified(docs, "doc_id", "text", repeated_ids(docs, "doc_id"))
    gone = removed_by_document(removed_of(own, "text"))
    sizes = own.select("doc_id", "__doc", "__copy", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return sizes.join(gone, (F.col("__doc") == F.col("doc")) & (F.col("__copy") == F.col("copy")), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
