"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on labelled texts are taken apart: every path from a root to a node is a
rule, a conjunction of comparisons of statistics. A lasso-penalised logistic
regression over the rules keeps few of them; what is left compiles to one column
expression, so scoring is a projection with nothing to load and nothing to shuffle.

Fitting uses a bounded sample of the labelled rows (``Fit.rows``, the smallest hashes
of their keys); statistics are computed for those texts only. Scoring covers all rows
and whole texts.

Defined cases: null and empty texts have all statistics 0 and get the score the rules
give for that; without labels the score is 0.5, with labels of one kind it is their
smoothed rate; repeated labels of a key count as the largest; repeated rows score
alike; all input columns are kept, one named like a result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from keepwell.session import settle

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Fit:
    rows: int = 20_000
    trees: int = 24
    depth: int = 3
    penalty: float = 0.001
    support: float = 0.002
    seed: int = 7


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text. ``chars`` and ``words`` are counts, the others shares or means."""
    t = F.coalesce(text, F.lit(""))
    chars = F.char_length(t)
    listed = F.array_remove(F.split(t, SPACE), "")
    words = F.size(listed)
    per_char = lambda c: c / F.greatest(chars, F.lit(1))
    per_word = lambda c: c / F.greatest(words, F.lit(1))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "chars": chars.cast("double"),
        "words": words.cast("double"),
        "word_length": per_word(chars - words),
        "distinct": per_word(F.size(F.array_distinct(listed))),
        "repeated": per_word(count(r"(?<!\S)(\S++) \1(?!\S)")),
        "upper": per_char(count(r"\p{Lu}")),
        "digits": per_char(count(r"[0-9]")),
        "symbols": per_char(count(r"[^\p{L}\p{N}\s.,;:!?'\"()\-]")),
        "calls": per_word(count(r"[!?]")),
        "stops": per_word(count(r"[.,]")),
        "lines": per_word(count(r"\n")),
    }


def with_statistics(docs: DataFrame, text: str, name: str = "__stats", barrier: bool = False) -> DataFrame:
    """``docs`` with one column of all statistics, computed once per row.

    ``barrier`` adds a row number at the end: the optimizer then moves no filter on a
    score below this column, where every rule would compute the statistics anew.
    """
    found = statistics(F.col(text))
    last = [F.monotonically_increasing_id().cast("double")] if barrier else []
    return docs.withColumn(name, F.array(*[found[x] for x in NAMES], *last))


NAMES = ["chars", "words", "word_length", "distinct", "repeated", "upper", "digits", "symbols", "calls", "stops", "lines"]

Condition = tuple[int, bool, float]  # statistic, greater, bound


@dataclass
class Rules:
    """``intercept`` and weighted conjunctions; a text's log-odds are the sum of what holds."""

    intercept: float
    weighted: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        terms = [F.when(holds(rule, stats), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weighted]
        total = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{NAMES[i]} {'>' if greater else '<='} {bound:.4g}" for i, greater, bound in rule)
                for rule, w in sorted(self.weighted, key=lambda x: -abs(x[1]))]


def holds(rule: tuple[Condition, ...], stats: Column) -> Column:
    parts = [stats[i] > bound if greater else stats[i] <= bound for i, greater, bound in rule]
    return reduce(lambda a, b: a & b, parts)


def _simplified(conditions: list[Condition]) -> tuple[Condition, ...]:
    """The tightest bound per statistic and side, in order."""
    best: dict[tuple[int, bool], float] = {}
    for i, greater, bound in conditions:
        old = best.get((i, greater), bound)
        best[i, greater] = max(old, bound) if greater else min(old, bound)
    return tuple((i, greater, bound) for (i, greater), bound in sorted(best.items()))


def tree_rules(tree) -> list[tuple[Condition, ...]]:
    """All paths of one fitted tree, from the root to every other node."""
    out: list[tuple[Condition, ...]] = []

    def walk(node, above: list[Condition]) -> None:
        if above:
            out.append(_simplified(above))
        if node.subtreeDepth() > 0:
            split = node.split()
            i, bound = split.featureIndex(), split.threshold()
            walk(node.leftChild(), [*above, (i, False, bound)])
            walk(node.rightChild(), [*above, (i, True, bound)])

    walk(tree._call_java("rootNode"), [])
    return out


def training_rows(docs: DataFrame, key: str, text: str, labels: DataFrame, how: Fit) -> DataFrame:
    """label and __stats of at most ``how.rows`` labelled keys, chosen by the hash of the key."""
    known = (labels.where("label is not null").groupBy("key").agg(F.max("label").cast("double").alias("label"))
             .orderBy(F.xxhash64("key"), "key").limit(how.rows))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    rows = with_statistics(rows, "text").select("key", "label", "__stats").groupBy("key").agg(
        F.max("label").alias("label"), F.min("__stats").alias("__stats"))
    return settle(rows.repartition(1).sortWithinPartitions("key"), "training-rows")  # bounded by how.rows


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, how: Fit = Fit()) -> Rules:
    """Rules for the probability of label 1. ``labels``: key, label (0 or 1)."""
    rows = training_rows(docs, key, text, labels, how)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        rate = (ones + 0.5) / (n + 1)
        return Rules(math.log(rate / (1 - rate)))
    vectors = rows.select("label", array_to_vector("__stats").alias("features"), "__stats")
    forest = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, seed=how.seed, featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree)})
    share = rows.agg(F.count(F.lit(1)), *[F.avg(holds(rule, F.col("__stats")).cast("double")) for rule in rules]).first()[1:]
    rules = [rule for rule, s in zip(rules, share) if how.support <= s <= 1 - how.support]
    if not rules:
        return Rules(math.log(ones / (n - ones)))
    hold = F.array(*[holds(rule, F.col("__stats")).cast("double") for rule in rules])
    model = LogisticRegression(regParam=how.penalty, elasticNetParam=1.0, maxIter=100).fit(
        rows.select("label", array_to_vector(hold).alias("features")))
    weights = model.coefficients.toArray().tolist()
    return Rules(float(model.intercept), [(rule, w) for rule, w in zip(rules, weights) if abs(w) > 1e-6])


def score(docs: DataFrame, text: str, rules: Rules, cut: float = 0.3) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted."""
    scored = with_statistics(docs, text, barrier=True).withColumn("score", rules.score(F.col("__stats"))).drop("__stats")
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
