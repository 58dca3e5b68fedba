import re

from veldt.plans import scoring_queries as Q
from veldt.sources import adapter as A

FOLDER = "/root/testdata/sf0.001"


def test_lines_are_dealt_out_by_the_key_that_the_join_needs(spark):
    """Not by supplier, year and key first and by the key again: few lines share the three, so all were shuffled twice."""
    plan = A.observations(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(s_suppkey#\d+L?, y#\d+, (l_partkey|l_orderkey|c_custkey)", plan)


def test_observations_are_made_once(spark):
    plan = Q.full_anchor_score(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "l_orderkey" not in plan
