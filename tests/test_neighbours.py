"""Exact nearest neighbours by both routes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.operators import neighbours
from keepwell.operators.sampling import balanced, oversample


def table(spark, matrix, prefix=""):
    rows = [(f"{prefix}{i:04d}", [float(v) for v in r]) for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, "id string, vector array<double>")


def brute(q, c, k):
    out = {}
    for i, row in enumerate(q):
        d = np.round(((c - row) ** 2).sum(1), 6)
        best = sorted(range(len(c)), key=lambda j: (d[j], j))[:k]
        out[f"{i:04d}"] = [(f"{j:04d}", d[j]) for j in best]
    return out


def data(kind):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(300, 6))
    if kind == "clusters":
        corpus += rng.integers(0, 4, size=(300, 1)) * 20.0
    if kind == "copies":  # a third of the corpus is one vector
        corpus[:100] = corpus[7]
    return corpus[rng.permutation(300)[:60]] + rng.normal(size=(60, 6)) * 0.1, corpus


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
@pytest.mark.parametrize("route", [{}, {"max_bytes": 0, "tile_rows": 17}, {"max_bytes": 0, "tile_rows": 1000}])
def test_both_routes_are_exact(spark, kind, route):
    q, c = data(kind)
    found = neighbours.nearest(table(spark, q), table(spark, c), 7, **route).orderBy("query_id", "position").collect()
    for key, expected in brute(q, c, 7).items():
        mine = [(r.neighbour_id, r.distance) for r in found if r.query_id == key]
        assert [m[0] for m in mine] == [e[0] for e in expected]
        assert [m[1] for m in mine] == pytest.approx([e[1] for e in expected])


@pytest.mark.parametrize("route", [{}, {"max_bytes": 0, "tile_rows": 2}])
def test_small_and_empty_corpora(spark, route):
    q, c = data("spread")
    assert neighbours.nearest(table(spark, q), table(spark, c[:3]), 10, **route).count() == 60 * 3
    none = table(spark, c[:1]).where("false")
    assert neighbours.nearest(table(spark, q), none, 10, **route).count() == 0
    assert neighbours.nearest(none, table(spark, c), 10, **route).count() == 0


def test_tiles_skip_cells_that_are_too_far(spark):
    _, c = data("clusters")
    left = neighbours.nearest(table(spark, c[:5]), table(spark, c), 3, max_bytes=0, tile_rows=20)
    assert left.count() == 15


def test_caps_come_after_the_cut(spark):
    hits = spark.createDataFrame([("q", f"s{i}", float(i), i + 1) for i in range(3)] + [
        ("q", f"c{i}", 3.0 + i, 4 + i) for i in range(7)],
        "query_id string, neighbour_id string, distance double, position int")
    kinds = hits.select("neighbour_id", F.when(F.col("neighbour_id").startswith("s"), "section").otherwise("case").alias("kind"))
    kept = neighbours.cap_by_kind(hits, kinds, {"section": 1, "case": 5}).collect()
    assert sorted(r.neighbour_id for r in kept) == ["c0", "c1", "c2", "c3", "c4", "s0"]


@pytest.mark.parametrize("rare", [1, 4, 30, 50])
def test_classes_are_equal_after_oversampling(spark, rare):
    rng = np.random.default_rng(2)
    rows = [(f"r{i:03d}", int(i < rare), [float(v) for v in rng.normal(size=3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, y int, features array<double>")
    if rare == 1:  # no neighbour, nothing to interpolate
        assert oversample(df, "y", "k").count() == 0
        return
    counts = {r.y: r["count"] for r in balanced(df, "y", "k").groupBy("y").count().collect()}
    assert counts[0] == counts[1] == max(rare, 100 - rare)
    by_id = {r[0]: np.array(r[2]) for r in rows}
    seen = {}
    for r in oversample(df, "y", "k").collect():
        a, b, x = by_id[r.base_id], by_id[r.neighbour_id], np.array(r.features)
        step = (x - a) @ (b - a) / ((b - a) @ (b - a))
        assert 0 <= step < 1 and np.allclose(x, a + step * (b - a))
        seen[r.base_id] = seen.get(r.base_id, 0) + 1
    if seen:
        assert max(seen.values()) - min([*seen.values(), *([0] if len(seen) < rare else [])]) <= 1


def test_oversampled_rows_weigh_one(spark):
    rows = [(f"r{i}", int(i < 3), [float(i), 1.0], 2.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, y int, features array<double>, w double")
    out = balanced(df, "y", "k", weight="w").collect()
    assert {r.w for r in out if r.k.startswith("new:")} == {1.0} and {r.w for r in out if r.k.startswith("r")} == {2.0}


def test_few_queries_scan_the_corpus_once(spark):
    from keepwell.operators.neighbours import nearest, nearest_to_few

    rng = np.random.default_rng(8)
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(rng.integers(0, 5, (300, 4)).astype(float).tolist())] + [(999, None)],
                                   "id long, vector array<double>").repartition(6)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(2, 1, (5, 4)).tolist())], "id long, vector array<double>")
    few = nearest_to_few(queries, corpus, 7)
    plan = few._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, few.collect()))
    assert rows == sorted(map(tuple, nearest(queries, corpus, 7).collect())) and len(rows) == 35
    assert rows == sorted(map(tuple, nearest_to_few(queries, corpus, 7, max_bytes=100).collect()))
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and "MapInPandas" in plan and "Join" not in plan
    assert nearest_to_few(queries.limit(0), corpus, 3).count() == 0 and nearest_to_few(queries, corpus.limit(0), 3).count() == 0


@pytest.mark.parametrize("route", [{}, {"max_bytes": 0, "tile_rows": 17}, {"max_bytes": 0, "tile_rows": 1000}])
def test_narrow_vectors_with_copies_and_ties(spark, route):
    rng = np.random.default_rng(6)
    c = np.concatenate([rng.integers(0, 5, (150, 3)) / 4.0, np.full((90, 3), 0.25), rng.normal(size=(60, 3)) * 1e-4, rng.normal(size=(60, 3))])
    c = c[rng.permutation(len(c))]
    q = np.concatenate([c[:60], c[:20] + 0.01, np.full((20, 3), 9.0)])
    found = neighbours.nearest(table(spark, q), table(spark, c), 7, **route).orderBy("query_id", "position").collect()
    expected = brute(q, c, 7)
    assert len(found) == 7 * len(q)
    for at, r in enumerate(found):
        assert r.position == at % 7 + 1
        name, distance = expected[r.query_id][at % 7]
        assert (r.neighbour_id, r.distance) == (name, pytest.approx(distance))


def test_a_narrow_query_meets_few_vectors_however_many_there_are():
    rng = np.random.default_rng(7)
    for c in (rng.normal(size=(40_000, 3)), np.stack([rng.integers(0, 80, 40_000) / 80, rng.random(40_000) * 10, rng.integers(0, 2, 40_000)], 1).astype(float)):
        blocks = neighbours.Blocks(c, 6)
        q = c[:200]
        rows, cols, exact = blocks.search(q)
        for mine, theirs in zip((rows, cols, exact), neighbours.top_k(q, c, 6)):
            assert mine.tolist() == theirs.tolist()
        assert blocks.compared < len(q) * len(c) / 20
