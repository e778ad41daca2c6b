"""A third of all rows on one key: hot joins are split, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import correlation, disclosure, predicates, risk
from tidewatch.plans import reports
from tidewatch.workload import inputs as I

SF, AS_OF = "/root/testdata/sf0.01", "2026-01-01 00:00:00"
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def hot(spark):
    """Ledger with a third of all findings on one domain, in several input files, at scaled-down thresholds."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    domains = I.domains(spark, SF)
    found = I.findings(spark, SF).repartition(16, "finding_id")
    found = found.withColumn("domain_id", F.when(F.col("finding_id") % 3 == 0, F.lit(11)).otherwise(F.col("domain_id")))
    yield domains, found
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    rows = df.count()
    df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_marking_splits_the_hot_domain(spark, hot):
    domains, found = hot
    evidence = domains.select("domain_id", F.lit("[note]").alias("breach_note"), F.lit(None).cast("string").alias("vuln_note"))
    rows, plan = executed(risk.mark_breached(found, evidence))
    assert rows == found.count() and "skew=true" in plan


def test_vendor_lookup_splits_the_hot_domain(spark, hot):
    domains, found = hot
    rows, plan = executed(correlation.with_domain_vendor(found, domains))
    assert rows == found.count() and "skew=true" in plan


def test_events_split_the_hot_domain_and_miss_nobody(spark, hot):
    domains, found = hot
    plan = disclosure.disclosure_plan(found, domains.withColumn("contact_source", F.lit("stored")), Settings("k", "national@team.example", "government@team.example"), AS_OF)
    queue = disclosure.disclosure_queue(found, AS_OF)
    primary = plan.events.filter("recipient_type = 'PRIMARY'")
    assert primary.select("finding_id").distinct().count() == queue.count()
    assert executed(primary)[0] == queue.count()


def test_search_keeps_every_hit(spark, hot):
    domains, found = hot
    got = predicates.search_findings(found, domains, "org11.").count()
    assert got == found.filter("domain_id = 11 OR url LIKE '%org11.%'").count() > 4000


def test_sector_counts_join_one_row_per_domain(spark, hot):
    domains, found = hot
    df = reports.findings_by_sector(found, domains)
    assert df.agg(F.sum("n_findings")).first()[0] == found.count()
