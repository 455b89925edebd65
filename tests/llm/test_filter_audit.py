"""The filter audit against a walk through every order, row by row."""

import itertools
import re

from pyspark.sql import functions as F

from keepwell.llm.filter_audit import coalitions, failures, masks, steps
from keepwell.llm.q_audit import CONDITIONS, LETTERS

SCHEMA = "doc_id long, source string, text string, mask string, n int, words string"
LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, "a", LONG), (2, "a", LONG), (3, None, LONG), (3, None, LONG), (None, "a", LONG), (4, "", "x y"),
    (5, "b", None), (6, "b", ""), (7, "b", "SHOUT " * 70), (8, "a", "AB # " + LONG), (9, "b", "\x0b\t \n"),
    (10, "c", "w " * 3000 + "é$"), (11, "c", "w\xa0w w"), (None, None, None), (0, "c", "SHOUT " * 70), (5, "b", None),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (7, None, 1), (8, 1, 1), (99, 1, 1), (None, 1, 1), (6, 1, 0)]


def brute(docs, labels):
    def fails(doc, text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        return {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in docs),
        }

    rows = [((s or ""), fails(d, t or ""),
             d is not None and any(k == d and q == 1 for k, q, _ in labels),
             d is not None and any(k == d and x == 1 for k, _, x in labels)) for d, s, t in docs]
    out = {}
    for part in {r[0] for r in rows}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                mine = [r for r in rows if r[0] == part]
                total[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def audit(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "z", 1, "z") for d in docs], SCHEMA)  # columns that clash with inner ones
    marks = spark.createDataFrame(labels, "key long, quality int, toxic int").select(
        "key", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    failed = failures(docs, "doc_id", "text", "source", CONDITIONS)
    return steps(coalitions(masks(failed, marks, 16), 5), LETTERS)


def test_every_order_as_walked(spark):
    expected = brute(DOCS, LABELS)
    rows = audit(spark, DOCS, LABELS).collect()
    assert len(rows) == len(expected) == 4 * 600
    for r in rows:
        assert expected[r.part, r.filter_order, r.step] == [
            r.kept, r.removed, r.redundant, r.unique_fails, r.lost_good, r.lost_toxic, r.shapley]


def test_empty_tables(spark):
    assert audit(spark, [], LABELS).collect() == []
    assert audit(spark, DOCS[:1], []).count() == 600


def test_potentials_are_those_of_the_definition(spark):
    """P(S) = sum over T in S of value(T) (|T|-1)! (|S|-|T|)! / |S|!, times m!."""
    from math import factorial as f

    counts = [(m, (m * 7 + 3) % 11) for m in range(8)]
    table = spark.createDataFrame([("p", m, n) for m, n in counts], "part string, mask int, n long")
    row = coalitions(table, 3).first()
    value = [sum(n for m, n in counts if m & s) for s in range(8)]
    assert row.removed == value and row.rows == sum(n for _, n in counts)
    size = lambda s: bin(s).count("1")
    for s in range(1, 8):
        inner = sum(value[t] * f(size(t) - 1) * f(size(s) - size(t)) for t in range(1, 8) if t & s == t)
        assert row.potential[s] * f(size(s)) == inner * f(3)
    assert sum(row.potential[7] - row.potential[7 - b] for b in (1, 2, 4)) == value[7] * f(3)


def test_no_row_is_shuffled_with_its_text(spark):
    failed = failures(spark.createDataFrame([(*d, "z", 1, "z") for d in DOCS], SCHEMA), "doc_id", "text", "source", CONDITIONS)
    assert failed.columns == ["key", "part", "digest", "mask"]
