"""The ledger run: risk, breach marking, vendor correlation, disclosure, escalation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators.correlation import correlate_vendors
from tidewatch.operators.disclosure import disclosure_plan, escalation_plan
from tidewatch.operators.findings import audit_run
from tidewatch.operators.risk import breach_counters, breach_evidence, mark_breached, risk_scores
from tidewatch.operators.transitions import overlay


@dataclass(frozen=True)
class LedgerInputs:
    """``domains`` carries contact_source; findings carry context_snippet_safe."""

    domains: DataFrame
    findings: DataFrame
    breaches: DataFrame
    host_vulns: DataFrame


@dataclass(frozen=True)
class LedgerRun:
    risk: DataFrame
    findings: DataFrame
    correlated: DataFrame
    disclosure_events: DataFrame
    escalation_events: DataFrame
    evidence: DataFrame


def run_ledger(inputs: LedgerInputs, settings: Settings, as_of: str, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> LedgerRun:
    """Chain the five steps, each on the state the one before left.

    ``cut`` may write a step's state to the shared folder and read it back, so
    that a long chain is neither planned nor recomputed from the start.
    """
    domains = cut(inputs.domains)
    risk = risk_scores(domains, inputs.findings, as_of)
    evidence = cut(breach_evidence(domains, inputs.breaches, inputs.host_vulns, as_of))
    marked = cut(mark_breached(inputs.findings, evidence, as_of))
    correlated = cut(correlate_vendors(domains, marked, as_of))
    state = marked.unionByName(correlated, allowMissingColumns=True)
    plan = disclosure_plan(state, domains, settings, as_of)
    disclosed = cut(overlay(state, plan.findings, "finding_id"))
    escalation = escalation_plan(disclosed, domains, settings, as_of)
    final = overlay(disclosed, escalation.findings, "finding_id")
    return LedgerRun(risk, final, correlated, plan.events, escalation.events, evidence)


def audit_ledger_run(counts: DataFrame, as_of: str) -> DataFrame:
    return audit_run(counts, "PHASE3_PIPELINE_COMPLETED", as_of, name="step", scope="ledger")


def step_counts(run: LedgerRun, domains: DataFrame) -> DataFrame:
    """``(step, metric, n)`` of one run."""

    def count(df: DataFrame, step: str, metric: str) -> DataFrame:
        n = df.agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.lit(step).alias("step"), F.lit(metric).alias("metric"), "n")

    breached = breach_counters(domains, run.evidence).select(
        F.lit("breach_correlation").alias("step"), F.lit("breached").alias("metric"), F.col("breached").cast("long").alias("n")
    )
    primary = run.disclosure_events.filter(F.col("recipient_type") == "PRIMARY")
    return (
        count(run.risk, "risk_scores", "updated")
        .unionByName(breached)
        .unionByName(count(run.correlated, "vendor_correlation", "correlated"))
        .unionByName(count(primary, "disclosure", "disclosed"))
        .unionByName(count(run.escalation_events, "escalation", "escalated"))
    )
