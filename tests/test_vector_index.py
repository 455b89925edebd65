"""The stored vector index against a full comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.operators import vector_index as I
from test_neighbours import brute, data, table


def hits(found, key):
    return [(r.neighbour_id, r.distance) for r in sorted(found, key=lambda r: r.position) if r.query_id == key]


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_search_is_exact_over_all_batches(spark, tmp_path, kind):
    q, c = data(kind)
    root, all_rows = str(tmp_path / "index"), table(spark, c)
    first = all_rows.where("id < '0200'")
    I.build(first, root, cells=12)
    found = I.search(table(spark, q), root, 7).collect()
    for key, expected in brute(q, c[:200], 7).items():
        assert hits(found, key) == [(i, pytest.approx(d)) for i, d in expected]
    assert I.append(all_rows.where("id >= '0200' and id < '0250'"), root) == 1
    assert I.append(all_rows.where("id >= '0250'"), root) == 2
    for options in ({}, {"max_bytes": 0}):
        found = I.search(table(spark, q), root, 7, **options).collect()
        for key, expected in brute(q, c, 7).items():
            assert hits(found, key) == [(i, pytest.approx(d)) for i, d in expected]


def test_a_batch_that_was_not_finished_is_not_read(spark, tmp_path):
    q, c = data("spread")
    root = str(tmp_path / "index")
    I.build(table(spark, c[:100]), root, cells=5)
    I.append(table(spark, c[100:]), root)
    (tmp_path / "index" / "cells" / "batch=1" / "_SUCCESS").unlink()  # the writer stopped before the end
    found = I.search(table(spark, q[:9]), root, 4).collect()
    for key, expected in brute(q[:9], c[:100], 4).items():
        assert hits(found, key) == [(i, pytest.approx(d)) for i, d in expected]


def test_few_cells_are_opened_and_few_vectors_fetched(spark, tmp_path):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(30, 8)) * 50
    c = np.repeat(middle, 40, axis=0) + rng.normal(size=(1200, 8))
    root = str(tmp_path / "index")
    I.build(table(spark, c), root, cells=30)
    index = I.open_index(spark, root)
    asked = middle[:2] + 0.1
    found = I.candidates(index, asked, 5)
    assert found.select("cell").distinct().count() <= 4 and 10 <= found.count() <= 40
    near, _ = index.bounds(asked)
    plan = I._near_codes(index.entries, index, asked, near <= index.limits(asked, 5)[:, None], index.limits(asked, 5), 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.split("\n") if "FileScan" in line)
    assert "cell#" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "vector" not in scan.split("ReadSchema: ")[1] and "LessThanOrEqual(twin,5)" in scan


def test_codes_bound_the_distances():
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(200, 9)), rng.normal(size=(4, 9))
    x[0] = centres[0]
    cell = rng.integers(0, 4, 200)
    cell[0] = 0
    code, step, error = I.encode(x, centres, cell)
    q = rng.normal(size=9)
    told = np.sqrt(((q - (centres[cell] + code * step[:, None])) ** 2).sum(1))
    true = np.sqrt(((q - x) ** 2).sum(1))
    assert (np.abs(true - told) <= error + 1e-12).all() and error.max() < 0.1 and error[0] == 0


def test_copies_do_not_multiply_candidates(spark, tmp_path):
    c = np.vstack([np.zeros((500, 4)), np.eye(4) * 9])
    root = str(tmp_path / "index")
    I.build(table(spark, c), root, cells=3)
    index = I.open_index(spark, root)
    assert I.candidates(index, np.full((1, 4), 0.5), 6).count() <= 12
    found = I.search(table(spark, np.full((1, 4), 0.5)), root, 6).collect()
    assert [r.neighbour_id for r in sorted(found, key=lambda r: r.position)] == [f"{i:04d}" for i in range(6)]


def test_odd_rows_and_empty_index(spark, tmp_path):
    schema = "id string, vector array<double>"
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 2.0]), (None, [0.0, 0.0]), ("c", None), ("d", [1.0])], schema)
    root = str(tmp_path / "index")
    I.build(rows, root)
    asked = spark.createDataFrame([("q", [1.0, 2.0]), ("r", None), ("s", [1.0])], schema)
    found = I.search(asked, root, 5).collect()
    assert [(r.query_id, r.neighbour_id, r.distance, r.position) for r in found] == [("q", "a", 0.0, 1), ("q", "b", 1.0, 2)]
    assert I.search(asked.limit(0), root, 5).count() == 0
    I.append(rows.where("id = 'a'"), root)
    assert [r.neighbour_id for r in I.search(asked, root, 5).orderBy("position").collect()] == ["a", "a", "b"]
    empty = str(tmp_path / "empty")
    I.build(rows.limit(0), empty)
    assert I.search(asked, empty, 3).count() == 0
