"""What the plans of the operators must look like, whatever the size of the tables."""

import re

import pytest

from probity.llm import registry

SF = "/root/testdata/sf0.001"
NATIVE = {"op3_url_rules", "op4_bounded_ring"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_join_no_single_task_and_no_row_at_a_time_python(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)
    assert name not in NATIVE or not re.search("Python|Pandas|Arrow", text)
    assert "Exchange SinglePartition, ENSURE" not in text  # op6 asks for as few partitions as its queries fill
