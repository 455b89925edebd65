"""Models, tuning and tree attribution on a small separable table."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepwell.operators import explain, training
from keepwell.operators.outcomes import class_weights


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=240) * 0.3 > 0.6).astype(int)
    return spark.createDataFrame(
        [(f"c{i:03d}", int(y[i]), [float(v) for v in x[i]]) for i in range(240)],
        "customerID string, Churn int, features array<double>").cache()


SMALL = training.BoostedParams(trees=4, depth=3, rate=0.3)


@pytest.fixture(scope="module")
def boosted(rows):
    return training.fit_boosted(rows, SMALL)


def test_scores_are_probabilities_of_every_row(rows, boosted):
    out = training.scored(boosted, rows)
    assert out.columns == [*rows.columns, "churn_score"]
    scores = [r.churn_score for r in out.collect()]
    assert len(scores) == 240 and all(0 <= s <= 1 for s in scores)
    assert training.evaluate(boosted, "m", rows).first().roc_auc > 0.9


def test_boosted_contributions_add_up_to_the_margin(rows, boosted):
    explained, base = explain.tree_contributions(rows, boosted, ["a", "b", "c"])
    for r in training.scored(boosted, explained).collect():
        margin = base + sum(c.value for c in r.contributions)
        assert 1 / (1 + math.exp(-2 * margin)) == pytest.approx(r.churn_score, abs=1e-9)
        assert [c.feature for c in r.contributions] == ["a", "b", "c"]
    assert {r[0] for r in explained.select(explain.top_drivers(F.col("contributions"), 1)[0]).distinct().collect()} <= {"a", "b", "c"}


def test_forest_contributions_add_up_to_the_probability(rows):
    forest = training.fit_forest(rows, trees=5, depth=4)
    explained, base = explain.tree_contributions(rows, forest, ["a", "b", "c"])
    for r in training.scored(forest, explained).collect():
        assert base + sum(c.value for c in r.contributions) == pytest.approx(r.churn_score, abs=1e-9)


def coalition_value(trees, root, x, known):
    """The tree's answer if only some features are known, by walking it."""
    if trees.leaf[root]:
        return trees.value[root]
    left, right = trees.left[root], trees.right[root]
    if trees.feature[root] in known:
        return coalition_value(trees, left if x[trees.feature[root]] <= trees.threshold[root] else right, x, known)
    both = trees.cover[left] + trees.cover[right]
    return sum(trees.cover[c] / both * coalition_value(trees, c, x, known) for c in (left, right))


def by_enumeration(trees, x):
    """Shapley values by their definition, over all coalitions."""
    d, out = len(x), np.zeros(len(x))
    for root, weight in zip(trees.roots, trees.weights):
        values = {s: coalition_value(trees, root, x, s) for n in range(d + 1) for s in itertools.combinations(range(d), n)}
        for s, v in values.items():
            for i in set(range(d)) - set(s):
                share = math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                out[i] += weight * share * (values[tuple(sorted((*s, i)))] - v)
    return out


def random_tree(rng, tree, depth, features):
    """Nodes of one tree whose covers add up; features come back on the same way."""
    nodes = []

    def grow(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == depth or cover < 2 or rng.random() < 0.15:
            nodes[at] = (tree, at, -1, -1, -1, 0.0, float(rng.normal()), cover)
        else:
            part = int(rng.integers(1, cover))
            left, right = grow(level + 1, part), grow(level + 1, cover - part)
            nodes[at] = (tree, at, left, right, int(rng.integers(features)), float(rng.normal()), 0.0, cover)
        return at

    grow(0, 1000)
    return nodes


@pytest.mark.parametrize("features", [1, 3, 8])
def test_tree_contributions_are_shapley_values(features):
    rng = np.random.default_rng(features)
    nodes = [n for t in range(3) for n in random_tree(rng, t, 7, features)]
    trees = explain.TreeTable(pd.DataFrame(nodes, columns=["tree", "id", "left", "right", "feature", "threshold", "value", "cover"]), [1.0, 0.3, -2.0])
    x = rng.normal(size=(600, features))
    found = trees.contributions(x)
    answers = [sum(w * coalition_value(trees, r, row, range(features)) for r, w in zip(trees.roots, trees.weights)) for row in x]
    assert np.allclose(trees.base + found.sum(axis=1), answers, atol=1e-10)
    for row, values in list(zip(x, found))[:4]:
        assert np.allclose(values, by_enumeration(trees, row), atol=1e-10)
    assert np.allclose(found[:5], trees.contributions(x[:5]), atol=1e-12)  # few rows go without the table of patterns
    trees.ROWS = 64
    assert np.allclose(found, trees.contributions(x), atol=1e-12)


def test_fitted_trees_equal_enumeration(rows, boosted):
    forest = training.fit_forest(rows, trees=3, depth=4)
    x = np.array([r.features for r in rows.limit(3).collect()])
    for model in (boosted, forest):
        trees = explain.tree_table(rows.sparkSession, model)
        assert np.allclose(trees.contributions(x), [by_enumeration(trees, row) for row in x], atol=1e-10)
        inner = ~trees.leaf
        assert np.allclose(trees.cover[trees.left[inner]] + trees.cover[trees.right[inner]], trees.cover[inner])


def test_row_weights_change_the_model(rows, boosted):
    heavy = rows.withColumn("weight", F.when(F.col("Churn") == 1, 50.0).otherwise(1.0))
    model = training.fit_boosted(heavy, SMALL, weight="weight")
    mean = lambda m: training.scored(m, rows).agg(F.avg("churn_score")).first()[0]
    assert mean(model) > mean(boosted)


def test_class_weights_balance(rows):
    found = {r.Churn: (r.n, r.weight) for r in class_weights(rows, "Churn").collect()}
    assert sum(n * w for n, w in found.values()) == pytest.approx(240)
    assert found[0][0] * found[0][1] == pytest.approx(found[1][0] * found[1][1])


def test_candidates_are_repeatable_and_in_range():
    drawn = training.drawn_params()
    assert drawn == training.drawn_params() and len(drawn) == 30
    for p in drawn:
        assert 100 <= p.trees <= 300 and 3 <= p.depth <= 8 and 0.01 <= p.rate <= 0.2
        assert 0.6 <= p.rows <= 1 and 0.5 <= p.columns <= 1 and 1 <= p.positive_weight <= 5


def test_search_prefers_the_better_candidate(rows):
    good, poor = SMALL, training.BoostedParams(trees=1, depth=1, rate=0.01, rows=0.1)
    best, results = training.tune(rows, "customerID", candidates=[poor, good], folds=2, parallelism=2)
    assert best == good and len(results) == 2 and all(0 <= q <= 1 for _, q in results)
