"""Statistics and compiled rules against plain Python; accuracy on rows that were not learned from."""

import math
import re
import zlib

from pyspark.sql import functions as F

from conftest import SF
from keepwell.llm.queries import QUERIES
from keepwell.llm.rule_quality import NAMES, Fit, Rules, fit, score, statistics, with_statistics

DATA = SF.replace("0.001", "0.01")


def test_statistics(spark):
    texts = ["", None, " \n", "To To To x", "É!! ABC?? 12.", "a | b &&& c,\nd.", "x " * 50_000 + "y", "a a\na  a"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r.i: r for r in frame.select("i", *[c.alias(n) for n, c in statistics(F.col("t")).items()]).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        n, m = max(len(t), 1), max(len(words), 1)
        wanted = dict(chars=len(t), words=len(words), word_length=(len(t) - len(words)) / m, distinct=len(set(words)) / m,
                      upper=sum(c.isupper() for c in t) / n, digits=sum(c in "0123456789" for c in t) / n,
                      symbols=sum(not c.isalnum() and not c.isspace() and c not in ".,;:!?'\"()-" for c in t) / n,
                      calls=sum(c in "!?" for c in t) / m, stops=sum(c in ".," for c in t) / m, lines=t.count("\n") / m)
        for name, value in wanted.items():
            assert math.isclose(rows[i][name], value, abs_tol=1e-12), (i, name)
    assert set(NAMES) == set(statistics(F.lit("")))
    assert rows[3].repeated == 1 / 4 and rows[6].repeated > 0.4 and rows[7].repeated == 1 / 4


def test_compiled_rules(spark):
    rules = Rules(-0.5, [(((0, True, 3.0),), 2.0), (((0, False, 10.0), (7, True, 0.1)), -1.5)])
    frame = spark.createDataFrame([("ab",), ("abcdef",), ("&&&& &",), ("&" * 30,)], "text string")
    got = [r.score for r in score(frame, "text", rules).collect()]
    odds = [-0.5, 1.5, 0.0, 1.5]
    assert all(math.isclose(g, 1 / (1 + math.exp(-o))) for g, o in zip(got, odds))
    assert len(rules.describe()) == 2


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_rule_quality"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(rows) == docs.count()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in rows]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    held = [(rows[i], q) for i, q in labels if rows[i].held_out]
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95
    good, bad = [r.score for r, q in held if q], [r.score for r, q in held if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_few_labels_and_odd_rows(spark):
    rows = [(1, "fine words here", "x"), (1, "fine words here", "x"), (2, None, "x"), (3, "", "x"), (None, "&&&&", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    label = lambda pairs: spark.createDataFrame(pairs, "key long, label int")
    none = score(docs, "text", fit(docs, "doc_id", "text", label([])))
    assert {r.score for r in none.collect()} == {0.5} and none.columns == ["doc_id", "text", "score", "predicted"]
    one = score(docs, "text", fit(docs, "doc_id", "text", label([(1, 1), (1, 0), (2, 1), (9, None)])))
    assert all(abs(r.score - 2.5 / 3) < 1e-9 for r in one.collect())
    both = fit(docs, "doc_id", "text", label([(1, 1), (2, 0), (3, 0)]), Fit(trees=3))
    assert score(docs, "text", both).count() == 5
    assert score(docs.limit(0), "text", both).count() == 0
    assert with_statistics(docs, "text").count() == 5
