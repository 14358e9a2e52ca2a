"""Lines meet a small table of names without being moved."""

import pytest

from cueloom.plans.entities import name_hits
from cueloom.plans.fixtures import Fixtures

pytestmark = pytest.mark.usefixtures("spark")


def test_lines_stay_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = name_hits(Fixtures(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
