"""Fingerprints, links and components against comparison of all pairs."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from conftest import SF
from keepwell.llm.components import components
from keepwell.llm.pivot_simhash import fingerprint, links, near_duplicates, pivot_table
from keepwell.llm.queries import QUERIES


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    """prints: list of (id, fp)."""
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for i, f in prints:
        r = find(f)
        low[r] = min(low.get(r, i), i)
    return {i: low[find(f)] for i, f in prints}


def test_fingerprint(monkeypatch):
    import keepwell.llm.pivot_simhash as module

    texts = ["", None, "One", "one TWO", "a b c", "É b\tc d\n e", "x " * 500, "The Ä ß " * 30 + "end"]
    assert [fingerprint(t) for t in texts] == [slow_print(t) for t in texts]
    whole = module._word_slices
    monkeypatch.setattr(module, "_word_slices", lambda t: whole(t, 5))
    assert [fingerprint(t) for t in texts] == [slow_print(t) for t in texts]


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def test_links_connect_all_near_pairs(spark):
    rng = random.Random(3)
    prints = [0, (1 << 64) - 1]
    for _ in range(60):  # families around random centres, one of them large
        centre = rng.getrandbits(64)
        for _ in range(300 if len(prints) < 100 else rng.randint(1, 8)):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(signed(f),) for f in prints], "fp long").repartition(5)
    expected = slow_components([(f, f) for f in prints])
    for unit in (2000, 7):
        rooted = {r.node: r.root for r in components(links(frame, unit=unit)).collect()}
        groups = {}
        for f in prints:
            groups.setdefault(rooted.get(signed(f), signed(f)), set()).add(f)
        wanted = {}
        for f, c in expected.items():
            wanted.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    row = pivot_table(frame).first()
    assert len(row.near) == 64 and len(row.far) == 16 and {c - row.origin for c in row.near} <= {-1, 1}


def test_query_equals_comparison_of_all_pairs(spark):
    got = {r.doc_id: r for r in QUERIES["op5_pivot_simhash"](spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [(i, slow_print(t)) for i, t in docs]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints}
    assert {i: r.component_id for i, r in got.items()} == slow_components(prints)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (0, "", "x"), (5, "a b c d", "x"), (5, "a b c d", "x"), (7, "A b  c d", "x"), (None, "a b c d", "x"), (9, "z " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicates(docs, "doc_id", "text").collect())
    assert got == [("0", 0), ("1", 0), ("5", 5), ("5", 5), ("7", 5), ("9", 9), ("None", 5)]
    assert near_duplicates(docs.limit(0), "doc_id", "text").collect() == []


def test_components_of_a_long_path(spark):
    path = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in components(path).collect()} == {0}
    assert components(path.limit(0)).collect() == []


def test_wide_shingles_over_slices_of_few_words(monkeypatch):
    import keepwell.llm.pivot_simhash as module

    text = " ".join(f"w{i}" for i in range(30))
    whole, expected = module._word_slices, fingerprint(text, 6)
    for size in (1, 4, 9, 12):
        monkeypatch.setattr(module, "_word_slices", lambda t: whole(t, size))
        assert fingerprint(text, 6) == expected
