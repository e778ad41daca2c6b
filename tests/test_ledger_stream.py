"""Streaming against the ledger: open keys left out, reopened ids, repeated batches, epochs, and only own buckets read."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import findings as saving
from tidewatch.session import checkpoint_root
from tidewatch.streaming import ledger_state
from tidewatch.streaming.detect import batch_folder

AS_OF = "2026-01-01 00:00:00"
CANDIDATE = "domain_id long, url string, finding_type string, severity string, entity_type string, c string"


def _candidates(spark, keys, confidence="0.8"):
    rows = [(d, u, "GIT", "HIGH", "GIT_REPO", confidence) for d, u in keys]
    return spark.createDataFrame(rows, CANDIDATE).withColumn("confidence", F.col("c").cast("decimal(4,3)")).drop("c")


@pytest.fixture
def how(spark):
    ledger = spark.createDataFrame(
        [(1, "u1", "GIT", "NEW"), (2, "u2", "GIT", "RESOLVED"), (2, "u2", "GIT", "FALSE_POSITIVE"), (3, "u3", "GIT", "RESOLVED"), (3, "u3", "GIT", "NEW")],
        "domain_id long, url string, finding_type string, status string",
    )
    base = f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"
    return {"detect": lambda df: df, "ledger": ledger, "state": f"{base}/keys", "out": f"{base}/out", "as_of": AS_OF}


def _added(spark, how, batch_id):
    return {(r.domain_id, r.url): r.finding_id for r in spark.read.parquet(batch_folder(how["out"], batch_id)).collect()}


def test_batches_agree_with_saving_at_once_and_repeat_alike(spark, how):
    first = _candidates(spark, [(1, "u1"), (2, "u2"), (3, "u3"), (4, "u4"), (4, "u4")])
    ledger_state.append_batch(first, 0, **how)
    at_once, _ = saving.save_findings(first, how["ledger"], AS_OF)
    want = {(r.domain_id, r.url): r.finding_id for r in at_once.collect()}
    assert set(want) == {(2, "u2"), (4, "u4")} and _added(spark, how, 0) == want
    second = _candidates(spark, [(4, "u4"), (5, "u5")])
    ledger_state.append_batch(second, 1, **how)
    assert set(_added(spark, how, 1)) == {(5, "u5")}
    before = sorted(map(str, spark.read.parquet(how["state"]).collect()))
    for repeated, number in ((first, 0), (second, 1)):
        ledger_state.append_batch(repeated, number, **how)
    assert _added(spark, how, 0) == want and set(_added(spark, how, 1)) == {(5, "u5")}
    assert sorted(map(str, spark.read.parquet(how["state"]).collect())) == before


def test_closed_findings_come_back_with_new_ids_over_epochs(spark, how, monkeypatch):
    monkeypatch.setattr(ledger_state, "EPOCH", 2)
    ids = []
    for number in range(5):
        ledger_state.append_batch(_candidates(spark, [(7, "u7"), (1, "u1")]), number, **how)
        added = _added(spark, how, number)
        assert set(added) == ({(7, "u7")} if number % 2 == 0 else set())
        ids += added.values()
        if number % 2 == 1:
            ledger_state.record_closed(_candidates(spark, [(7, "u7")]), how["state"], number)
    assert len(set(ids)) == 3


def test_a_batch_reads_only_its_buckets(spark, how):
    ledger = spark.range(2000).selectExpr("id AS domain_id", "concat('u', id) AS url", "'GIT' AS finding_type", "'NEW' AS status")
    ledger_state.start_state(ledger, how["state"])
    one = _candidates(spark, [(77, "u77")]).select(ledger_state.bucket_of().alias("b")).first().b
    known = ledger_state.known_keys(spark, how["state"], 0, [one])
    assert 0 < known.count() < 2000 / ledger_state.BUCKETS * 3
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_rejected_rows_and_empty_batches(spark, how):
    bad = _candidates(spark, [(9, None), (None, "u"), (8, "u8")]).withColumn("severity", F.when(F.col("domain_id") == 8, "LOUD").otherwise("HIGH"))
    domains = spark.createDataFrame([(1,)], "domain_id long")
    ledger_state.append_batch(bad.unionByName(_candidates(spark, [(6, "u6")])), 0, domains=domains, **how)
    problems = {r.problem for r in spark.read.parquet(batch_folder(f"{how['out']}-quarantine", 0)).collect()}
    assert problems == {"url missing", "domain missing", "unknown severity", "unknown domain"}
    ledger_state.append_batch(_candidates(spark, []), 1, **how)
    assert not _added(spark, how, 0) and not _added(spark, how, 1)
