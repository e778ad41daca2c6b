"""Runs of isolated steps over the ledger, with a journal to resume from.

Each step reads the findings as the last finished step left them and writes what it
yields under the run's folder; then one journal row says how it ended. A step that
fails leaves the findings as they were, gets a row with its error, and the others
go on. Its findings are then not those of the whole run, which ``Run.whole`` tells.
Running the same run again repeats only the steps that have not finished, on
the findings as they stand. Nothing written before is replaced, so a run that was
broken off anywhere can be repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.errors.exceptions.captured import convert_exception
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators.correlation import correlate_vendors
from tidewatch.operators.disclosure import Plan, disclosure_plan, escalation_plan
from tidewatch.operators.findings import audit_run
from tidewatch.operators.risk import breach_evidence, mark_breached, risk_scores
from tidewatch.operators.transitions import overlay
from tidewatch.plans.workflow import LedgerInputs
from tidewatch.session import handover

JOURNAL = "sequence int, step string, status string, n long, findings_path string, output_path string, error string"
STARTED, DONE, FAILED = "STARTED", "DONE", "FAILED"


class StepsFailed(RuntimeError):
    """Steps of a run have failed, so that its findings lack what these would have changed."""


@dataclass(frozen=True)
class StepOutput:
    """What a step yields: tables by name, of which ``counted`` gives its number, and the findings after it (None: as before)."""

    tables: dict[str, DataFrame]
    counted: DataFrame
    findings: DataFrame | None = None


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], StepOutput]


@dataclass
class Run:
    """A run's folder and its journal rows so far (one for each attempt of a step)."""

    spark: SparkSession
    folder: str
    rows: list = field(default_factory=list)

    def _add(self, step: str, status: str, n: int | None, findings_path: str, output_path: str | None, error: str | None) -> None:
        row = (len(self.rows), step, status, n, findings_path, output_path, error)
        one = self.spark.createDataFrame([row], JOURNAL).coalesce(1)
        one.write.mode("overwrite").json(f"{self.folder}/journal/entry={row[0]}")
        self.rows.append(one.first())

    @property
    def findings(self) -> DataFrame:
        return self.spark.read.parquet(self.rows[-1].findings_path)

    def output(self, step: str, table: str) -> DataFrame:
        path = next(r.output_path for r in reversed(self.rows) if r.step == step and r.status == DONE)
        return self.spark.read.parquet(f"{path}/{table}")

    def journal(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in self.rows], JOURNAL)

    def whole(self) -> Run:
        """This run, if the last attempt of every step is done; otherwise ``StepsFailed``.

        ``findings`` of a run with a failed step look like any others. Who takes them for the
        result of all steps asks for ``run.whole().findings``.
        """
        last = {r.step: r for r in self.rows if r.status != STARTED}
        if failed := [r for r in last.values() if r.status == FAILED]:
            raise StepsFailed("; ".join(f"{r.step}: {r.error}" for r in failed))
        return self

    def results(self) -> DataFrame:
        """The last attempt of each step."""
        last = Window.partitionBy("step").orderBy(F.desc("sequence"))
        rows = self.journal().filter(F.col("status") != STARTED).withColumn("last", F.row_number().over(last))
        return rows.filter("last = 1").drop("last")


def open_run(spark: SparkSession, folder: str) -> Run:
    """The run in ``folder``, or a new one."""
    try:
        rows = spark.read.schema(JOURNAL).json(f"{folder.rstrip("/")}/journal").drop("entry").orderBy("sequence").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return Run(spark, folder.rstrip("/"), rows)


def _kind(error: Exception) -> str:
    """Which error it was. Spark's messages may quote values of the data, so only their condition is kept.

    Stages that fail at the same time come as one error of the JVM; the first of them is named.
    """
    name = type(error).__name__
    if isinstance(error, Py4JJavaError):
        java = error.java_exception
        each = [convert_exception(e) for e in (java.getCause(), *java.getSuppressed()) if e is not None]
        known = [e for e in each if isinstance(e, PySparkException) and e.getCondition()]
        return _kind(known[0]) if known else f"{name}: no condition"
    if isinstance(error, PySparkException):
        return f"{name}: {error.getCondition() or 'no condition'}"
    return f"{name}: {error}"


def run_steps(spark: SparkSession, folder: str, findings: DataFrame, steps: Sequence[Step]) -> Run:
    """Run the steps that the journal in ``folder`` does not have as done. ``findings`` is read by a new run only.

    A failed step raises nothing here: its error is in the journal, and ``Run.whole`` raises it.
    """
    run = open_run(spark, folder)
    if not run.rows:
        path = f"{run.folder}/start-{uuid.uuid4().hex}"
        findings.write.parquet(path)
        run._add("", STARTED, None, path, None, None)
    done = {r.step for r in run.rows if r.status == DONE}
    for step in steps:
        if step.name in done:
            continue
        before = run.rows[-1].findings_path
        out = f"{run.folder}/{step.name}-{uuid.uuid4().hex}"
        try:
            made = step.run(spark.read.parquet(before))
            counted = made.counted
            for name, table in made.tables.items():
                table.write.parquet(f"{out}/{name}")
                if table is made.counted:  # what is written is counted, not computed again
                    counted = spark.read.schema(table.schema).parquet(f"{out}/{name}")
            after = before
            if made.findings is not None:
                after = f"{out}/findings-after"
                made.findings.write.parquet(after)
            n = counted.count()
        except Exception as error:  # whatever a step does wrong is its own
            run._add(step.name, FAILED, None, before, None, _kind(error))
        else:
            run._add(step.name, DONE, n, after, out, None)
    return run


def ledger_steps(
    inputs: LedgerInputs, settings: Settings, as_of: str, cut: Callable[[DataFrame], DataFrame] = handover
) -> list[Step]:
    """Risk, breach marking, vendor correlation, disclosure and escalation, each on the findings as they stand.

    What several steps or several tables of a step read is computed once, by ``cut``: the
    domains, the evidence, the correlated findings, and a plan's notices and changed findings.
    """
    read: list[DataFrame] = []

    def domains() -> DataFrame:
        if not read:  # asked for by a step, so that a failure is that step's own and the next one tries again
            read.append(cut(inputs.domains))
        return read[0]

    def risk(findings: DataFrame) -> StepOutput:
        scores = risk_scores(domains(), findings, as_of)
        return StepOutput({"risk": scores}, scores)

    def breach(findings: DataFrame) -> StepOutput:
        evidence = cut(breach_evidence(domains(), inputs.breaches, inputs.host_vulns, as_of))
        return StepOutput({"evidence": evidence}, evidence, mark_breached(findings, evidence, as_of))

    def vendors(findings: DataFrame) -> StepOutput:
        new = cut(correlate_vendors(domains(), findings, as_of))
        return StepOutput({"correlated": new}, new, findings.unionByName(new, allowMissingColumns=True))

    def planned(findings: DataFrame, plan: Plan) -> StepOutput:
        tables = {"notices": plan.notices, "events": plan.events, "audit": plan.audit}
        return StepOutput(tables, plan.findings, overlay(findings, plan.findings, "finding_id"))

    return [
        Step("risk_scores", risk),
        Step("breach_correlation", breach),
        Step("vendor_correlation", vendors),
        Step("disclosure", lambda f: planned(f, disclosure_plan(f, domains(), settings, as_of, cut))),
        Step("escalation", lambda f: planned(f, escalation_plan(f, domains(), settings, as_of, cut))),
    ]


def audit_completed(run: Run, as_of: str) -> DataFrame:
    """The run's audit row: every step's number of rows, or its error."""
    told = F.coalesce(F.concat(F.lit("error: "), "error"), F.concat(F.lit("n="), F.col("n").cast("string")))
    return audit_run(run.results().select("step", told.alias("n")), "PHASE3_PIPELINE_COMPLETED", as_of, name="step", scope="ledger")
