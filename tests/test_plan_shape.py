"""Physical plans: what is read, what is broadcast, what never appears."""

import pytest

from toolmill.operators import metrics, retrieve
from toolmill.plans import QUERIES, roles

FOLDER = "/root/testdata/sf0.001"
EAGER = ("r1_", "r2_", "r3_", "r4_", "s1_", "s2_", "s3_", "s4_", "s5_", "s6_", "s7_", "s8_", "s11_", "s12_", "s14_", "s15_")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON = ("a12_", "a13_", "a29_", "a32_", "j9_", "j10_", "w1_", "u1_matched", "t1_", "q5_", "q10_")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_no_cross_join_and_no_needless_python(name, spark):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    assert name.startswith(PYTHON) or ("Python" not in text and "InArrow" not in text), name


def test_attempts_read_only_their_columns(spark):
    text = plan(metrics.overall(roles.plain_attempts(spark, FOLDER)))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in plan(roles.final_tools(spark, FOLDER))


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(retrieve.top_k(roles.embeddings(spark, FOLDER), roles.queries(spark, FOLDER), 5))
    assert text.count("WindowGroupLimit") >= 4 and "Partial" in text  # at the nearest pivot, then over all


def test_pass_at_k_combines_before_the_shuffle(spark):
    text = plan(QUERIES["a6_pass_at_k"](spark, FOLDER))
    assert "partial_min" in text and "Python" not in text


def test_budgets_are_folded_inside_a_row(spark):
    text = plan(QUERIES["q2_schema_budgets"](spark, FOLDER))
    assert "Aggregate" not in text and text.count("Exchange") == text.count("REPARTITION_BY_NUM")  # small inputs are dealt to all cores
