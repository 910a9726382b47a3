"""What the plans must look like, whatever the size of the tables."""

import re

import pytest

from pyspark.sql import functions as F

from probity.plans import registry
from probity.sources import csv_tables

SF = "/root/testdata/sf0.001"
#: English sentences, JSON lines, and numbers written with ten significant digits have no native form; they run in Arrow batches.
PYTHON = {"sentence_split_english", "traj_parse", "score_table"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)
    assert name in PYTHON or not re.search("ArrowEval|MapInPandas|MapInArrow", text)


def test_scans_read_what_is_used_and_no_more(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(registry.QUERIES["audit_summary"](spark, SF))
    columns = {c for found in re.findall("ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", found)}
    assert columns == {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"}
    text = plan(registry.QUERIES["gaming_rubric_flattery"](spark, SF))
    assert "lang" not in text and "source" not in text


def test_an_audit_shuffles_scores_on_the_case_only(spark):
    text = plan(registry.QUERIES["audit_case_margins"](spark, SF))
    keys = set(re.findall(r"hashpartitioning\(([a-z_]+)#", text))
    assert keys <= {"l_orderkey", "case_id"}


def test_a_score_table_is_sorted_by_many_tasks_whatever_the_ordinals(spark):
    rows = spark.range(8000).select(*(F.lit("x").alias(c) for c in ("system_name", "variant_id", "variant_type", "notes")), F.col("id").cast("string").alias("case_id"), *(F.lit(1.0).alias(c) for c in ("score", "score_stddev", "sample_count")), (F.col("id") % 2).alias("ordinal"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = csv_tables.score_layout(rows).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 8000 and max(sizes) < 4000
