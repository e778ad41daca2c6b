"""Ledger tables in hash buckets, and look-ups with a lane for hot keys."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.corpus import upsert_buckets, upsert_domains
from tidewatch.operators.findings import DEDUP_KEY, save_findings, save_to_buckets
from tidewatch.session import look_up
from tidewatch.sources import buckets
from tidewatch.sources.buckets import BucketTable
from tidewatch.workload import inputs as I

SF, AS_OF = "/root/testdata/sf0.001", "2026-01-01 00:00:00"


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def files(base):
    return {os.path.join(at, n) for at, _, names in os.walk(f"{base}/rows") for n in names if n.endswith(".parquet")}


@pytest.fixture
def small(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)] + [(None, "n")], "k long, v string")
    table = BucketTable(str(tmp_path / "t"), rows.schema, ("k",), 16)
    table.create(rows)
    return table, rows


def test_appends_touch_their_buckets_only(spark, small):
    table, rows = small
    assert rows_of(table.read(spark, 0)) == rows_of(rows)
    new = spark.createDataFrame([(7, "again"), (None, "again")], rows.schema)
    assert table.append(new, 0) == 1
    assert rows_of(table.read(spark, 1)) == rows_of(rows.unionByName(new)) and rows_of(table.read(spark, 0)) == rows_of(rows)
    wrote = {b for b, v in table.parts(spark, 1) if v == 1}
    assert wrote == set(table.touched(new)) and len(wrote) <= 2
    one = table.read(spark, 1, table.touched(new.filter("k = 7")))
    assert len(one.inputFiles()) < len(table.read(spark, 1).inputFiles()) / 2
    assert {r.v for r in one.filter("k = 7").collect()} == {"v7", "again"}


def test_finished_versions_stay_and_broken_ones_are_repeated(spark, small):
    table, rows = small
    new = spark.createDataFrame([(7, "again")], rows.schema)
    new.withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{table.base}/rows/version=1")
    with pytest.raises(ValueError, match="not finished"):
        table.read(spark, 1)
    table.append(new, 0)
    assert table.read(spark, 1).count() == 102
    with pytest.raises(ValueError, match="is finished"):
        table.append(new, 0)


def test_crowded_buckets_are_put_together_and_empty_batches_change_nothing(spark, small, monkeypatch):
    monkeypatch.setattr(buckets, "MOST_PARTS", 3)
    table, rows = small
    version, whole = 0, rows
    for i in range(4):
        new = spark.createDataFrame([(7, f"a{i}")], rows.schema)
        version, whole = table.append(new, version), whole.unionByName(new)
    assert rows_of(table.read(spark, version)) == rows_of(whole)
    (bucket,) = table.touched(new)
    assert sum(b == bucket for b, _ in table.parts(spark, version)) <= 3
    before = files(table.base)
    assert table.append(new.limit(0), version) == version + 1 and table.rewrite(new, version + 1, []) == version + 2
    assert files(table.base) == before and rows_of(table.read(spark, version + 2)) == rows_of(whole)


def test_empty_table(spark, tmp_path, small):
    table = BucketTable(str(tmp_path / "e"), small[1].schema, ("k",), 16)
    table.create(small[1].limit(0))
    assert table.read(spark, 0).count() == 0 and table.parts(spark, 0) == []
    table.append(small[1], 0)
    assert table.read(spark, 1).count() == 101


def test_saving_equals_saving_to_a_whole_ledger(spark, tmp_path):
    ledger = I.findings(spark, SF).withColumn("finding_id", F.col("finding_id").cast("string"))
    table = BucketTable(str(tmp_path / "f"), ledger.schema, tuple(DEDUP_KEY), 64)
    table.create(ledger)
    columns = ("domain_id", "finding_type", "severity", F.lit("OTHER").alias("entity_type"), F.col("heuristic_confidence").alias("confidence"))
    few = ledger.orderBy("finding_id").limit(5).select(F.concat("url", F.lit("/x")).alias("url"), *columns)
    want, _ = save_findings(few, ledger, AS_OF)
    before = files(table.base)
    version, rows, bad = save_to_buckets(few, table, 0, AS_OF)
    assert rows_of(rows) == rows_of(want) and bad.count() == 0
    assert len({f.split("bucket=")[1].split("/")[0] for f in files(table.base) - before}) <= 5
    again, none, _ = save_to_buckets(few, table, version, AS_OF)
    assert none.count() == 0 and table.read(spark, again).count() == ledger.count() + want.count()


def test_upsert_writes_changed_buckets_only(spark, tmp_path):
    inventory = I.inventory(spark, SF)
    table = BucketTable(str(tmp_path / "d"), inventory.schema, ("domain",), 32)
    table.create(inventory)
    incoming = inventory.limit(2).withColumn("iocs_score", F.lit(99)).unionByName(inventory.limit(1).withColumns({"domain": F.lit("new.in"), "iocs_score": F.lit(5)}))
    version, merged = upsert_buckets(table, 0, incoming, AS_OF)
    want = upsert_domains(inventory, incoming, AS_OF)
    assert rows_of(table.read(spark, version)) == rows_of(want.drop("action"))
    changed = {b for b, v in table.parts(spark, version) if v == version}
    assert changed == set(table.touched(want.filter("action IN ('created', 'updated')"))) and len(changed) <= 3
    assert merged.count() < want.count()


def test_hot_and_missing_keys_go_round_the_shuffle(spark):
    """A third of the rows have no key, a third one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900))
    rows = spark.range(30_000).select("id", key.cast("string").alias("ip"), F.create_map(F.lit("a"), F.lit(1)).alias("extra"))
    facts = spark.createDataFrame([("hot", 1), (None, 9), *((f"k{i}", i) for i in range(0, 900, 2))], "ip string, n int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = look_up(rows, facts, "ip")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        found = {r.id: r.n for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    known = {r.ip: r.n for r in facts.collect() if r.ip}
    assert found == {r.id: known.get(r.ip) for r in rows.collect()} and got.columns == ["id", "ip", "extra", "n"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert len(sizes) == 4 and max(sizes) < 1.2 * 30_000 / 4
    assert look_up(rows.limit(0), facts, "ip").count() == 0 and look_up(rows, facts.limit(0), "ip").filter("n IS NULL").count() == 30_000
