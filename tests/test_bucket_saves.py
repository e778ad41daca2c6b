"""A save to buckets writes one row for each key between, not all candidates, and asks for buckets only once."""

from tidewatch.operators import findings as saving
from tidewatch.sources.buckets import BucketTable


def test_candidates_are_not_written_and_no_bucket_is_asked_for_twice(spark, tmp_path, monkeypatch):
    schema = "finding_id string, domain_id long, url string, finding_type string, status string"
    ledger = spark.createDataFrame([("a", 1, "u", "T", "NEW"), ("b", 2, "u", "T", "RESOLVED")], schema)
    table = BucketTable(str(tmp_path / "t"), ledger.schema, tuple(saving.DEDUP_KEY), 4)
    table.create(ledger)
    given = [(1, "u", "T", "LOW", 0.5), (2, "u", "T", "LOW", 0.5), (3, "u", "T", "LOW", 0.5), (3, "u", "T", "HIGH", 0.9), (None, "u", "T", "LOW", 0.5)]
    rows = spark.createDataFrame(given, "domain_id long, url string, finding_type string, severity string, confidence double").selectExpr("*", "'EMAIL' AS entity_type")
    wrote, asked = [], []
    cut, touched = saving.handover, BucketTable.touched
    monkeypatch.setattr(saving, "handover", lambda df, name: wrote.append(name) or cut(df, name))
    monkeypatch.setattr(BucketTable, "touched", lambda self, df: asked.append(1) or touched(self, df))
    version, new, bad = saving.save_to_buckets(rows, table, 0, "2026-01-01 00:00:00")
    assert {(r.domain_id, r.severity) for r in new.collect()} == {(2, "LOW"), (3, "HIGH")} and bad.count() == 1
    assert table.read(spark, version).count() == 4
    assert "bucket-candidates" not in wrote and len(asked) == 1
