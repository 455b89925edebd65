"""The shape of plans: no cross products, no global windows, pruned and filtered scans."""

import re

import pytest

from conftest import SF
from keepwell.plans.catalogue import QUERIES

# streams have run when they return; their result is a plain table scan
NAMES = sorted(QUERIES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(QUERIES[name](spark, SF)) for name in NAMES}


def test_no_query_multiplies_tables(plans):
    bad = [n for n, p in plans.items() if re.search("CartesianProduct|BroadcastNestedLoopJoin", p)]
    assert bad == []


def test_no_query_orders_its_rows_in_one_task(plans):
    """One partition only receives merged aggregates, a few rows of a top-k, or a
    settled table whose size was checked."""
    bad = []
    for name, text in plans.items():
        lines = [x.strip(" :+-*()0123456789") for x in text.split("\n")]
        for i, line in enumerate(lines):
            if line.startswith("Exchange SinglePartition"):
                child = next(x for x in lines[i + 1:] if not re.match("Project|Filter|ColumnarToRow|Sort|Window", x))
                if not re.match("HashAggregate|ObjectHashAggregate|SortAggregate|LocalLimit", child) and "settled-" not in child:
                    bad.append((name, child[:200]))
    assert bad == []


def test_only_the_neighbour_search_runs_python(plans):
    python = {n for n, p in plans.items() if re.search("MapInPandas|PythonUDF|EvalPython|FlatMap", p)}
    assert python <= {"knn_l2", "knn_stored_index", "knn_type_caps", "question_section", "oversample", "retrain_weights_after_oversampling"}


def test_scans_read_only_needed_columns_and_push_filters(plans):
    needed = re.search(r"ReadSchema: (struct<[^>]*>)", plans["risk_kpis"]).group(1)
    assert "o_orderstatus" in needed and "o_totalprice" not in needed
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,error\)", plans["support_contacts"])
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type", plans["campaign_pivot"])


def test_splitting_does_not_shuffle_the_table(plans):
    assert "Exchange hashpartitioning" not in plans["stratified_split"]
    assert "Exchange hashpartitioning" not in plans["stratified_folds"]
