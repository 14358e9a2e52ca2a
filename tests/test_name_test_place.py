"""The name test sees candidates that met a glossary name, not every word of every line."""

import __spark_entry__


def test_name_test_stays_behind_the_join(spark):
    d = __spark_entry__.queries()["e28_name_shaped"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "\\Q" in plan and "Join" in plan
    assert "\\Q" not in plan[plan.index("Join"):]
