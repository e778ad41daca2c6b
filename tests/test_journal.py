"""Isolated steps: error rows, resuming, and what a broken-off run leaves."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidewatch.plans.journal import DONE, FAILED, Step, StepOutput, audit_completed, open_run, run_steps
from tidewatch.session import checkpoint_root


def _step(name, add, calls, fail=None):
    def run(findings):
        calls.append(name)
        if fail == "driver":
            raise ValueError("no feed")
        after = findings.withColumn("n", F.col("n") + add)
        if fail == "task":
            after = after.withColumn("n", F.when(F.col("n") > -100, F.raise_error(F.lit("secret value"))).cast("long"))
        return StepOutput({"made": after}, after, after)

    return Step(name, run)


@pytest.mark.parametrize("fail", ["driver", "task"])
def test_a_failing_step_is_alone_and_only_it_is_repeated(spark, fail):
    folder, calls = f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}", []
    start = spark.range(3).withColumn("n", F.lit(0).cast("long"))
    first = run_steps(spark, folder, start, [_step("a", 1, calls), _step("b", 10, calls, fail), _step("c", 100, calls)])
    assert calls == ["a", "b", "c"]
    assert [(r.step, r.status, r.n) for r in first.rows[1:]] == [("a", DONE, 3), ("b", FAILED, None), ("c", DONE, 3)]
    assert "secret" not in first.rows[2].error and first.rows[2].error.split(":")[0] in ("ValueError", "SparkRuntimeException")
    assert {r.n for r in first.findings.collect()} == {101}
    assert first.output("c", "made").count() == 3
    details = audit_completed(first, "2026-01-01 00:00:00").first().details
    assert '"a":"n=3"' in details and '"b":"error: ' in details

    other = spark.range(3).withColumn("n", F.lit(7).cast("long"))  # a resumed run goes on from its own findings
    again = run_steps(spark, folder, other, [_step("a", 1, calls), _step("b", 10, calls), _step("c", 100, calls)])
    assert calls == ["a", "b", "c", "b"]
    assert {r.n for r in again.findings.collect()} == {111}
    assert {(r.step, r.status) for r in again.results().collect()} == {("a", DONE), ("b", DONE), ("c", DONE)}
    assert run_steps(spark, folder, other, [_step("b", 10, calls)]).journal().count() == 5 and len(calls) == 4


def test_a_run_broken_off_goes_on_where_it_was(spark):
    folder, calls = f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}", []

    def killed(findings):
        raise KeyboardInterrupt

    start = spark.range(2).withColumn("n", F.lit(0).cast("long"))
    with pytest.raises(KeyboardInterrupt):
        run_steps(spark, folder, start, [_step("a", 1, calls), Step("b", killed)])
    assert [r.step for r in open_run(spark, folder).rows] == ["", "a"]
    run = run_steps(spark, folder, start, [_step("a", 1, calls), _step("b", 10, calls)])
    assert calls == ["a", "b"] and {r.n for r in run.findings.collect()} == {11}
