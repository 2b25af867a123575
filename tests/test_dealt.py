"""What one deal of programs is worth: nothing moves their lines again."""

from __future__ import annotations

import pytest

from gneiss.operators import program
from gneiss.plans import programs

@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """6,000 rows of lineitem in 2,000 orders."""
    d = str(tmp_path_factory.mktemp("dealt"))
    sql = "SELECT id DIV 3 AS l_orderkey, id % 7 AS l_partkey, id % 5 AS l_suppkey, CAST(id % 3 + 1 AS INT) AS l_linenumber, CAST(id % 40 AS DOUBLE) AS l_quantity, 1D AS l_extendedprice, substring('RAN', id % 3 + 1, 1) AS l_returnflag, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(6000)"
    spark.sql(sql).write.parquet(f"{d}/lineitem.parquet")
    return d


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_program_is_moved_once(spark, small):
    left, text = programs._masked(spark, small)
    for df in (left, program.paragraphs(text), program.statements(text)):
        assert _exchanges(df) == 1
    assert program.paragraphs(text).count() == 6000


def test_stored_relations_are_not_broadcast(spark, small):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stmts, found, fields = programs._found(spark, small)
        plan = found.join(fields, "program")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_rendered_lines_meet_what_is_joined_by_file_in_place(spark, small):
    _, loci, lines = programs._instances(spark, small)
    plan = lines.join(loci, "file")._jdf.queryExecution().executedPlan().toString()
    # the deal of the rows, and the loci
    assert plan.count("Exchange ") == 2
