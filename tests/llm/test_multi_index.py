"""The inverted multi-index against exhaustive search."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from keepwell.llm import multi_index as M
from keepwell.llm.q_nearest import multi_index

SCHEMA = "vec_id long, embedding array<float>, vector int, h1 string, ids int, shard int"


def exhaustive(rows, n, every):
    """{query: [(id, score)]} by comparing each query with all rows, products added up in order."""
    out = {}
    for q, x in rows:
        if q % every:
            continue
        scored = []
        for i, y in rows:
            if i != q:
                s = 0.0
                for a, b in zip(x, y):
                    s += a * b
                scored.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:n]]
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r[1])):
        assert r[1] == len(out.setdefault(r[0], [])) + 1
        out[r[0]].append((r[2], r[3]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 1, "z", 2, 3) for i, v in rows], SCHEMA)


def unit(count, dims, seed):
    x = np.random.default_rng(seed).normal(size=(count, dims)).astype(np.float32)
    return [[float(v) for v in row] for row in x]


def test_visiting_everything_is_exhaustive_search_with_copies_and_ties(spark):
    vectors = unit(150, 6, 1)
    rows = [(i, vectors[i % 90]) for i in range(150)]  # copies
    rows += [(200 + i, vectors[0]) for i in range(120)]  # one very common vector, queries among it
    rows += [(400, [0.0, 2.0, 0, 0, 0, 0]), (401, [0.0, 0, 2.0, 0, 0, 0]), (-20, [0.0, 1.0, 1.0, 0, 0, 0])]  # ties
    expected = exhaustive(rows, 20, 10)
    for shard in (8, 64, 4096):
        got = found_by(M.nearest(frame(spark, rows), "vec_id", "embedding", 20, F.col("id") % 10 == 0, visit=10 ** 6, shard_rows=shard))
        assert got == expected


def test_rows_that_take_no_part(spark):
    good = [(i, v) for i, v in enumerate(unit(40, 5, 2))]
    odd = [(50, None), (60, [0.0] * 5), (70, [1.0, None, 0, 0, 0]), (80, [float("nan"), 1, 1, 1, 1]), (90, [float("inf"), 0, 0, 0, 0]),
           (100, [1.0, 2.0]), (None, [1.0, 1, 1, 1, 1]), (110, [])]
    smaller = [(0, [-9.0, 0, 0, 0, 0])]  # the same identifier, a smaller vector
    got = found_by(M.nearest(frame(spark, good + odd + smaller), "vec_id", "embedding", 5, F.col("id") % 10 == 0, visit=10 ** 6))
    assert got == exhaustive(good, 5, 10)


def test_small_and_empty_tables(spark):
    run = lambda rows: found_by(M.nearest(frame(spark, rows), "vec_id", "embedding", 20, F.col("id") % 20 == 0))
    assert run([]) == {} and run([(0, None)]) == {} and run([(0, [1.0, 2.0])]) == {} and run([(1, [1.0]), (2, [1.0])]) == {}
    few = [(i, v) for i, v in enumerate(unit(9, 3, 3))]
    assert run(few) == exhaustive(few, 20, 20)
    same = [(i, [1.0, 0.5]) for i in range(60)]
    assert run(same) == exhaustive(same, 20, 20)


def test_traversal_takes_every_pair_once_by_falling_sum():
    rng = np.random.default_rng(4)
    books = M.Codebooks(rng.normal(size=(7, 3)), rng.normal(size=(7, 4)))
    query = rng.normal(size=7)
    a, b = books.closeness(query)
    order = list(books.traverse(query))
    sums = [a[c // 7] + b[c % 7] for c in order]
    assert sorted(order) == list(range(49)) and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:]))


def test_large_cells_are_dealt_over_shards():
    sizes = np.array([0, 3, 50, 2, 9, 1, 30, 0, 4])
    first, parts = M._shards(sizes, 10)
    assert parts.tolist() == [1, 1, 5, 1, 1, 1, 3, 1, 1]
    shards = [set(range(f, f + p)) for f, p in zip(first, parts)]
    large = [shards[2], shards[6]]
    assert not large[0] & large[1] and all(not (s & l) for s, p in zip(shards, parts) if p == 1 for l in large)
    assert max(sum(sizes[i] for i in range(9) if parts[i] == 1 and first[i] == s) for s in set(first[parts == 1])) < 20


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_and_scores_of_the_query(spark, sf):
    t = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    ids, x = np.asarray(t["vec_id"]), np.stack(t["embedding"]).astype(np.float64)
    hits = total = 0
    got = found_by(multi_index(spark, sf))
    assert sorted(got) == ids[ids % 20 == 0].tolist()
    place = {int(v): i for i, v in enumerate(ids)}
    for q, listed in got.items():
        scores = x @ x[place[q]]
        scores[place[q]] = -np.inf
        true = set(ids[np.argsort(-scores, kind="stable")[:20]].tolist())
        hits, total = hits + len(true & {i for i, _ in listed}), total + 20
        assert len(listed) == 20 and q not in dict(listed)
        assert all(abs(s - scores[place[i]]) < 1e-12 for i, s in listed)
        assert [i for i, _ in listed] == [i for i, _ in sorted(listed, key=lambda r: (-r[1], r[0]))]
    assert hits / total >= 0.9
