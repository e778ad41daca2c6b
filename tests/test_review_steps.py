"""Reviews in order: sorted once, and applied to ids that come twice as to one after the other."""

from tidewatch.operators.transitions import review_steps


def test_steps_sort_changes_once_and_keep_repeated_ids(spark):
    findings = spark.createDataFrame([(1, "LOW"), (2, "HIGH"), (2, "HIGH"), (None, "LOW")], "finding_id long, severity string")
    made = [
        (1, "confirmed", "high", "a", None, 2), (1, "resolved", None, "b", "x", 1), (1, "resolved", "critical", "c", "x", 3),
        (2, "confirmed", "low", "d", "y", 1), (2, "resolved", None, "e", "y", 2), (None, "resolved", None, "f", "y", 1), (9, "resolved", None, "g", "y", 1),
    ]
    columns = "finding_id long, new_status string, new_severity string, reason string, analyst string, sequence int"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = review_steps(findings, spark.createDataFrame(made, columns))
        plan = steps._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in steps.select("finding_id", "reason", "old_severity", "severity", "reviewed_by").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows == [
        (1, "a", "LOW", "HIGH", "ANALYST"), (1, "b", "LOW", "LOW", "x"), (1, "c", "HIGH", "CRITICAL", "x"),
        (2, "d", "HIGH", "LOW", "y"), (2, "d", "LOW", "LOW", "y"), (2, "e", "LOW", "LOW", "y"), (2, "e", "LOW", "LOW", "y"),
    ]
    assert plan.count("Sort [") == 2, plan
