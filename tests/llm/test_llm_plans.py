"""The shape of the corpus queries' plans, as far as they show before they run."""

import re

import pytest

from conftest import SF
from keepwell.llm.queries import QUERIES

#: Queries whose plan ends in a table written before; those steps are audited by their own tests.
SHOWN = ["op1_url_reputation", "op4_deobfuscate", "op8_line_join", "op9_wu_manber", "op11_filter_audit", "op12_token_alignment", "op13_multi_index"]


@pytest.fixture(scope="module")
def plans(spark):
    return {n: QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in SHOWN}


def test_no_query_multiplies_tables(plans):
    assert [n for n, p in plans.items() if re.search("CartesianProduct|BroadcastNestedLoopJoin", p)] == []


def test_native_operators_run_no_python(plans):
    python = {n for n, p in plans.items() if re.search("MapIn|PythonUDF|EvalPython|FlatMap", p)}
    assert not python & {"op1_url_reputation", "op8_line_join", "op11_filter_audit"}


def test_the_audit_shuffles_no_text(plans):
    exchanged = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plans["op11_filter_audit"])
    assert exchanged and not [e for e in exchanged if re.search(r"\btext#", e)]
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plans["op11_filter_audit"]
