"""A run computes what several of its steps and tables read once."""

import uuid

from pyspark.sql import functions as F

from tidewatch.plans.journal import DONE, ledger_steps, run_steps
from tidewatch.plans.workflow import LedgerInputs
from tidewatch.session import checkpoint_root
from tidewatch.workload.inputs import AS_OF, SETTINGS


def test_domains_and_evidence_are_computed_once_in_a_run(spark):
    asked, fed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def telling(counter):
        def told(value):
            counter.add(1)
            return value

        return F.udf(told, "string").asNondeterministic()

    domains = spark.range(1, 7).selectExpr(
        "id AS domain_id", "concat('d', id, '.in') AS domain", "'ACTIVE' AS status", "'OTHER' AS sector", "1 AS iocs_score",
        "CASE WHEN id < 4 THEN 'Joomla 4.1' END AS vendor_fingerprint", "concat('c@d', id, '.in') AS contact_email",
        "concat('10.0.0.', id) AS ip_address", "'stored' AS contact_source",
    )
    domains = domains.withColumn("domain", telling(asked)("domain"))
    findings = spark.range(1, 13).selectExpr(
        "CAST(id AS STRING) AS finding_id", "id % 6 + 1 AS domain_id", "concat('https://d', id % 6 + 1, '.in/p') AS url", "'/p' AS url_path",
        "'OTHER' AS entity_type", "'ENV_FILE_EXPOSED' AS finding_type", "CASE WHEN id % 2 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity",
        "'NEW' AS status", "CAST(0.7 AS DECIMAL(4,3)) AS heuristic_confidence", "CAST(0.7 AS DECIMAL(4,3)) AS final_confidence",
        "false AS dark_web_confirmed", "'' AS context_snippet_safe", f"TIMESTAMP '{AS_OF}' AS created_at",
        f"TIMESTAMP '{AS_OF}' AS disclosure_sla_due", "CAST(NULL AS TIMESTAMP) AS disclosed_at",
        "CAST(NULL AS TIMESTAMP) AS acknowledged_at", "0 AS escalation_level",
    )
    breaches = spark.createDataFrame([("d1.in", '{"a":["b"]}'), ("d2.in", '{"a":["b"]}')], "domain string, payload string")
    breaches = breaches.withColumn("payload", telling(fed)("payload"))
    vulns = spark.createDataFrame([("10.0.0.3", [1], ["V-1"], "o")], "ip string, open_ports array<int>, vulns array<string>, org string")

    steps = ledger_steps(LedgerInputs(domains, findings, breaches, vulns), SETTINGS, AS_OF)
    run = run_steps(spark, f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}", findings, steps)
    assert {(r.step, r.status, r.n) for r in run.rows[1:]} == {
        ("risk_scores", DONE, 6), ("breach_correlation", DONE, 3), ("vendor_correlation", DONE, 3), ("disclosure", DONE, 12), ("escalation", DONE, 6),
    }
    assert run.findings.count() == 15 and run.output("disclosure", "notices").count() == 6
    assert asked.value == 6 and fed.value == 2
