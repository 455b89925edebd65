"""Sliced ranks, totals and quantiles against plain numpy, hot values included."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keepwell.operators.ranking import exact_quantiles, hash_segments, running_totals
from keepwell.operators.sampling import stratified_folds, stratified_split
from keepwell.session import settle


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value of one group."""
    rng = np.random.default_rng(1)
    rows = [("a", 5.0)] * 400 + [("a", float(v)) for v in rng.normal(5, 3, 500)] + [
        ("b", float(v)) for v in rng.integers(0, 4, 300)] + [("c", 1.0)]
    return rows, spark.createDataFrame(rows, "feature string, value double")


@pytest.mark.parametrize("margin", [0.0, 0.001, 0.1])
def test_quantiles_equal_numpy(spark, skewed, margin):
    rows, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    found = {(r.feature, r.prob): r.quantile for r in exact_quantiles(df, "feature", probs, margin).collect()}
    for group in "abc":
        values = [v for g, v in rows if g == group]
        for p in probs:
            assert found[group, p] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("slices", [1, 3, 17, 120])
@pytest.mark.parametrize("grouped", [True, False])
def test_running_totals_equal_cumsum(spark, skewed, slices, grouped):
    rows, df = skewed
    group = ["feature"] if grouped else []
    counts = settle(df.groupBy(*group, "value").agg(F.count("*").alias("n")))
    found = running_totals(counts, group, "value", ["n"], slices).collect()
    for name in "abc" if grouped else [None]:
        values, n = np.unique([v for g, v in rows if name in (g, None)], return_counts=True)
        mine = sorted((r.value, r.cum_n, r.all_n) for r in found if name is None or r.feature == name)
        assert [m[:2] for m in mine] == list(zip(values, np.cumsum(n)))
        assert {m[2] for m in mine} == {n.sum()}


@pytest.mark.parametrize("n, share", [(1, 0.2), (2, 0.5), (10, 0.2), (101, 0.2), (1000, 0.0), (1000, 1.0)])
def test_split_is_a_partition_with_exact_shares(spark, n, share):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    found = stratified_split(df, "y", "k", share).collect()
    assert len(found) == n
    for y in {r.y for r in found}:
        rows = [r for r in found if r.y == y]
        assert sum(r.split == "test" for r in rows) == int(np.ceil(share * len(rows)))


def test_folds_are_even_per_class_and_repeatable(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") < 100).cast("int").alias("y"))
    first = stratified_folds(df, "y", "k", 3).repartition(7).collect()
    again = {r.k: r.fold for r in stratified_folds(df.repartition(5), "y", "k", 3).collect()}
    assert {r.k: r.fold for r in first} == again
    for y, n in ((0, 400), (1, 100)):
        sizes = [sum(r.fold == f for r in first if r.y == y) for f in range(3)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


@settings(max_examples=8, deadline=None)
@given(cut=st.integers(0, 60), digits=st.integers(1, 4))
def test_segments_hold_exactly_the_asked_rows(spark, cut, digits):
    df = spark.range(50).select("id")
    placed = hash_segments(df, [], "id", "s", lambda n: [F.lit(cut)], "segment", digits)
    assert placed.where("segment = 0").count() == min(cut, 50)
    assert placed.count() == 50


@pytest.mark.parametrize("slices", [1, 3, 40])
@pytest.mark.parametrize("kind", ["string", "struct", "double"])
def test_running_totals_of_any_type_with_null_groups(spark, slices, kind):
    rows = [(None if i % 4 == 0 else "g", i) for i in range(80)]
    value = {"string": F.lpad(F.col("i").cast("string"), 4, "0"), "double": F.col("i").cast("double"),
             "struct": F.struct(F.lit("f").alias("file"), F.col("i").alias("row"))}[kind]
    df = settle(spark.createDataFrame(rows, "g string, i int").select("g", "i", value.alias("v"), F.lit(1).alias("one")))
    found = running_totals(df, ["g"], "v", ["one"], slices).collect()
    assert len(found) == 80
    for name in (None, "g"):
        mine = sorted((r.i, r.cum_one, r.all_one) for r in found if r.g == name)
        assert [m[1] for m in mine] == list(range(1, len(mine) + 1)) and {m[2] for m in mine} == {len(mine)}


@pytest.mark.parametrize("slice_rows", [1, 7, 50, 10 ** 6])
def test_large_brackets_are_narrowed_again(spark, slice_rows):
    rng = np.random.default_rng(4)
    features = {"spread": rng.normal(size=900), "ties": np.repeat([1.0, 2.0, 2.5], 300), "one": np.full(50, 3.5), "few": np.array([5.0, 1.0]),
                "tail": np.concatenate([np.zeros(800), rng.normal(size=100) * 1e9])}
    df = spark.createDataFrame([(k, float(v)) for k, x in features.items() for v in x], "feature string, value double")
    probs = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    for margin in (0.001, 0.6):  # the wide one leaves everything between two cuts
        found = {(r.feature, r.prob): r.quantile for r in exact_quantiles(df, "feature", probs, margin, slice_rows=slice_rows).collect()}
        for name, x in features.items():
            for p in probs:
                assert found[name, p] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)


def test_stored_sketches_merge_and_bracket(spark):
    from keepwell.operators import drift

    rng = np.random.default_rng(5)
    base = [(float(v), float(w) if i % 9 else None) for i, (v, w) in enumerate(zip(rng.normal(size=4000), rng.integers(0, 5, 4000)))]
    rows = spark.createDataFrame(base, "a double, b double").repartition(4).cache()
    target = spark.createDataFrame([(v + 0.3, 9.0) for v, _ in base[:900]], "a double, b double")
    parts = drift.feature_sketches(rows.where("a < 0"), ["a", "b"]).unionByName(drift.feature_sketches(rows.where("a >= 0"), ["a", "b"]))
    merged = drift.merged_sketches(parts)
    assert {r.feature: r.n for r in merged.collect()} == {"a": 4000, "b": sum(w is not None for _, w in base)}
    stored = drift.baseline_bins(rows, ["a", "b"], sketches=merged)
    expected = {r.feature: r.psi for r in drift.stability_index(rows, target, ["a", "b"]).collect()}
    got = {r.feature: r.psi for r in drift.stability_against(stored, target, ["a", "b"]).collect()}
    assert got == pytest.approx(expected) and expected["a"] > 0.01 and expected["b"] > 0.5
    empty = drift.stability_against(stored, target.limit(0), ["a", "b"])
    assert {r.psi for r in empty.collect()} == {0.0}


def test_a_stored_baseline_is_not_scanned(spark, tmp_path):
    from keepwell.operators import drift

    for name in ("base", "target"):
        spark.range(500).selectExpr("double(id % 37) as a").write.parquet(str(tmp_path / name))
    drift.baseline_bins(spark.read.parquet(str(tmp_path / "base")), ["a"]).write.parquet(str(tmp_path / "stored"))
    index = drift.stability_against(spark.read.parquet(str(tmp_path / "stored")), spark.read.parquet(str(tmp_path / "target")), ["a"])
    folders = {f.split("/")[-2] for f in index.inputFiles()}
    assert folders == {"stored", "target"} and index.first().psi == pytest.approx(0.0)


def test_rows_without_a_label_are_a_stratum_of_their_own(spark):
    rows = [(i, None if i % 4 == 0 else i % 2, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y int, _note string")
    found = stratified_split(df, "y", "k", 0.2)
    assert found.columns == ["k", "y", "_note", "split"]
    sizes = {(r.y, r.split): r["count"] for r in found.groupBy("y", "split").count().collect()}
    assert sizes == {(None, "test"): 10, (None, "train"): 40, (0, "test"): 10, (0, "train"): 40, (1, "test"): 20, (1, "train"): 80}
    folds = stratified_folds(df, "y", "k", 5).groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [10] * 10 + [20] * 5
    unlabelled = stratified_split(df.where("y is null"), "y", "k", 0.2)
    assert unlabelled.where("split = 'test'").count() == 10
