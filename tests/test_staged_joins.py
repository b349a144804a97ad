"""Files of staged rows are small beside the rows, so their size must not lead to a broadcast."""

from millrace.plans import registered

QUERIES = registered().QUERIES


def test_evidence_is_not_broadcast(spark, sf):
    plan = QUERIES["extract_patterns"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
