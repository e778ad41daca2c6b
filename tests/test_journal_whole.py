"""A run with a failed step is no whole run."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidewatch.plans.journal import Step, StepOutput, StepsFailed, run_steps
from tidewatch.plans.workflow import LedgerInputs
from tidewatch.session import checkpoint_root
from tidewatch.workload import ledger_queries


def _step(name, fail):
    def run(findings):
        if fail:
            raise ValueError("no feed")
        after = findings.withColumn("n", F.col("n") + 1)
        return StepOutput({}, after, after)

    return Step(name, run)


def test_whole_refuses_a_run_until_its_failed_step_is_made_up_for(spark):
    folder, start = f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}", spark.range(2).withColumn("n", F.lit(0).cast("long"))
    broken = run_steps(spark, folder, start, [_step("a", False), _step("b", True), _step("c", False)])
    with pytest.raises(StepsFailed, match="^b: ValueError: no feed$"):
        broken.whole()
    made_up = run_steps(spark, folder, start, [_step("a", False), _step("b", False), _step("c", False)])
    assert {r.n for r in made_up.whole().findings.collect()} == {3}


@pytest.mark.parametrize("query", ["workflow_findings", "workflow_second_run"])
def test_a_query_over_all_steps_fails_with_a_step(spark, monkeypatch, query):
    rows = spark.range(1, 4).withColumn("n", F.lit(0).cast("long"))
    monkeypatch.setattr(ledger_queries, "_inputs", lambda *a, **b: LedgerInputs(rows, rows, rows, rows))
    monkeypatch.setattr(ledger_queries.journal, "ledger_steps", lambda *a: [_step("risk_scores", False), _step("breach_correlation", True)])
    with pytest.raises(StepsFailed, match="breach_correlation: ValueError"):
        getattr(ledger_queries, query)(spark, "unused")
