"""Removed lines against comparison of all pairs."""

import random
import re

from pyspark.sql import functions as F

from keepwell.llm.line_join import Threshold, dedup_lines, digests, first_lines, identified, line_table, removed_lines, single_lines
from keepwell.session import settle


def slow(docs, t=Threshold()):
    """docs: list of (id, text); the set of removed (id, line number)."""
    lines = sorted((i, n, frozenset(re.split(r"[\x20\x09-\x0D]+", x)) - {""})
                   for i, text in docs if text is not None for n, x in enumerate(text.split("\n")))
    lines = [x for x in lines if x[2]]
    return {(i, n) for a, (i, n, s) in enumerate(lines)
            if any(t.den * len(s & r) >= t.num * len(s | r) for j, m, r in lines[:a] if (j, m) != (i, n))}


def corpus(rng, n_docs):
    vocabulary = ["the", "of", "a"] + [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(300)]
    draw = lambda: vocabulary[min(int(rng.expovariate(0.03)), len(vocabulary) - 1)]
    bases = [[draw() for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 400]))] for _ in range(25)]
    docs = []
    for i in range(n_docs):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(line) // 6))):
                at = rng.randrange(len(line))
                line[at:at + rng.randint(0, 1)] = [draw()] * rng.randint(0, 2)
                if not line:
                    line = [""]
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        docs.append((i * 7 % 1009, "\n".join(lines)))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, digest string, n int").repartition(4)


def test_equals_all_pairs(spark):
    for seed in (1, 2):
        docs = corpus(random.Random(seed), 150)
        got = {(r.doc, r.line) for r in removed_lines(frame(spark, docs), "doc_id", "text").collect()}
        assert got == slow(docs)


def test_texts_rows_and_columns_stay(spark):
    docs = corpus(random.Random(9), 40) + [(2000, None), (2001, ""), (2002, "\n \n"), (2003, "one line"), (2004, "one  line\n\nend of it"),
                                           (2005, "q" * 100_000 + "\n" + "z " * 50_000)]
    gone = slow(docs)
    out = dedup_lines(frame(spark, docs), "doc_id", "text")
    assert out.columns == ["doc_id", "text", "digest", "n"]
    assert {r.doc_id: r.text for r in out.collect()} == {
        i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}
    assert dedup_lines(frame(spark, docs).limit(0), "doc_id", "text").collect() == []


def test_repeated_and_null_identifiers(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "x y z")]
    out = sorted(str(r.text) for r in dedup_lines(frame(spark, rows), "doc_id", "text").collect())
    assert out == ["", "a b c", "a b c", "x y z"] or out == ["", "", "a b c", "a b c"]


def test_rows_that_share_an_identifier_or_have_none_lose_their_own_lines_only(spark):
    rows = [(1, "a b c\nfirst of one"), (None, "a b c\nu v w"), (None, "x y z\nk l m"), (None, "p q r"), (7, "a b c"), (7, "d e f"), (7, None)]
    out = sorted((r.doc_id or 0, r.text or "-") for r in dedup_lines(frame(spark, rows), "doc_id", "text").collect())
    assert out == [(0, "p q r"), (0, "u v w"), (0, "x y z\nk l m"), (1, "a b c\nfirst of one"), (7, "-"), (7, "-"), (7, "d e f")]
    words = lambda i, n: " ".join(f"v{i}x{k}" for k in range(n))  # near copies, found by leaders and by the probe
    rows = [(None, f"{words(i, 20)}\nonly {words(100 + i, 9)}") for i in range(8)] + [(3, words(i, 20) + " more") for i in range(4)]
    got = {r.text for r in dedup_lines(frame(spark, rows), "doc_id", "text").collect()}
    assert got == {f"only {words(100 + i, 9)}" if i < 4 else f"{words(i, 20)}\nonly {words(100 + i, 9)}" for i in range(8)} | {words(i, 20) + " more" for i in range(4)}


def test_words_are_made_once_and_not_of_copies(spark):
    docs = corpus(random.Random(5), 60) + [(3000 + i, "one hot line of copies\n \nand another") for i in range(30)]
    own = identified(frame(spark, docs), "doc_id", "text", None)
    seen = digests(own, "text")
    firsts, copies = first_lines(seen, settle)
    alone, several = single_lines(own, "text", firsts)
    single = alone.unionByName(several)
    lines = [(i, n, x) for i, t in docs for n, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for i, n, x in sorted(lines):
        first.setdefault(x, (i, n))
    assert {(r.content, (r.doc, r.line)) for r in single.collect()} == set(first.items()) and single.count() == len(first)
    assert {(r.doc, r.line) for r in copies.collect()} == {(i, n) for i, n, _ in lines} - set(first.values())
    plan = line_table(seen, F.array(F.lit(0)), Threshold())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1  # a condition on the words was moved below them, which made them twice
