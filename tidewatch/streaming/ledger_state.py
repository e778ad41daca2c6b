"""Incremental detection against the ledger.

The state holds, for each finding key (domain, url, type), how often it was opened
and how often closed; it is open while it was opened more often. Rows are counts
that only add up, so a batch appends its own and rewrites none.

Folders: ``epoch=E/source=S/bucket=B/batch_id=N``. A key's bucket is its hash, so a
batch reads the buckets that its candidates fall into and no others. Every
``EPOCH`` batches the counts are added up once and a new epoch starts from them, so
that a batch reads a bounded number of files of a bucket. All folders follow from
the batch number alone, so a batch repeated after a failure reads what it read
before and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.findings import DEDUP_KEY, dedup_in_run, new_findings, split_known, split_valid
from tidewatch.schemas import is_open
from tidewatch.session import handover
from tidewatch.streaming.detect import batch_folder

BUCKETS = 64
EPOCH = 50
STATE = "domain_id string, url string, finding_type string, opened long, closed long, source string, bucket int, batch_id int"
# The ledger before the first batch, or all counts before an epoch; findings of a batch; findings closed after it.
BASE, FOUND, CLOSED = "base", "found", "closed"


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col("domain_id").cast("string"), "url", "finding_type"), F.lit(buckets)).cast("int")


def _epoch(state: str, batch_id: int) -> str:
    return f"{state.rstrip('/')}/epoch={max(0, batch_id) // EPOCH * EPOCH}"


def _counts(findings: DataFrame, opened: Column, closed: Column) -> DataFrame:
    keyed = findings.select(F.col("domain_id").cast("string").alias("domain_id"), "url", "finding_type", opened.alias("o"), closed.alias("c"))
    return keyed.groupBy(*DEDUP_KEY).agg(F.sum("o").cast("long").alias("opened"), F.sum("c").cast("long").alias("closed"))


def _write(counts: DataFrame, folder: str, source: str, batch_id: int, buckets: int) -> None:
    """Replace the rows of one source and batch in the buckets that ``counts`` falls into."""
    placed = counts.withColumn("source", F.lit(source)).withColumn("bucket", bucket_of(buckets)).withColumn("batch_id", F.lit(batch_id))
    (
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "bucket", "batch_id").parquet(folder)
    )


def _read(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """What earlier batches know, from the epoch that ``batch_id`` belongs to."""
    return spark.read.schema(STATE).parquet(_epoch(state, batch_id)).filter(F.col("batch_id") < batch_id)


def start_state(ledger: DataFrame, state: str, buckets: int = BUCKETS) -> None:
    """The state before the first batch: every key of the ledger with its numbers of findings and of closed ones."""
    counts = _counts(ledger, F.lit(1), F.when(is_open(F.col("status")), 0).otherwise(1))
    _write(counts, _epoch(state, 0), BASE, -1, buckets)


def start_epoch(spark: SparkSession, state: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Add up all counts before ``batch_id``, the first batch of an epoch."""
    earlier = spark.read.schema(STATE).parquet(_epoch(state, batch_id - 1))
    _write(_counts(earlier, F.col("opened"), F.col("closed")), _epoch(state, batch_id), BASE, batch_id - 1, buckets)


def record_closed(closed: DataFrame, state: str, after_batch: int, buckets: int = BUCKETS) -> None:
    """Findings closed by reviews after a batch and before the next; a second call for the same batch replaces the first in its buckets."""
    _write(_counts(closed, F.lit(0), F.lit(1)), _epoch(state, after_batch), CLOSED, after_batch, buckets)


def known_keys(spark: SparkSession, state: str, batch_id: int, wanted: list[int]) -> DataFrame:
    """(key, is_open, closed_before) of the keys in the wanted buckets, as they were before the batch."""
    rows = _read(spark, state, batch_id).filter(F.col("bucket").isin(wanted))
    counts = rows.groupBy(*DEDUP_KEY).agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed_before"))
    return counts.select(*DEDUP_KEY, (F.col("opened") > F.col("closed_before")).alias("is_open"), "closed_before")


def append_batch(
    batch: DataFrame,
    batch_id: int,
    *,
    detect: Callable[[DataFrame], DataFrame],
    ledger: DataFrame,
    state: str,
    out: str,
    as_of: str,
    domains: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> None:
    """One batch: candidates to new findings in ``out`` and rejected rows in ``out`` + ``-quarantine``.

    Of several candidates of a key the most confident is saved. A key that is open in the ledger or was appended by an
    earlier batch is left out; one that was closed gets an id of its own, as ``save_findings`` gives it.
    """
    spark = batch.sparkSession
    if batch_id == 0:
        start_state(ledger, state, buckets)
    elif batch_id % EPOCH == 0:
        start_epoch(spark, state, batch_id, buckets)
    valid, bad = split_valid(handover(detect(batch), "stream-candidates"))
    if domains is not None:
        valid, orphans = split_known(valid, domains)
        bad = bad.unionByName(orphans)
    bad.write.mode("overwrite").parquet(batch_folder(f"{out.rstrip('/')}-quarantine", batch_id))

    best = handover(dedup_in_run(valid).withColumn("bucket", bucket_of(buckets)), "stream-best")
    wanted = [r.bucket for r in best.select("bucket").distinct().collect()]  # numbers up to ``buckets``
    known = known_keys(spark, state, batch_id, wanted).withColumnRenamed("domain_id", "_domain")
    same = (best["domain_id"].cast("string") == known["_domain"]) & (best["url"] == known["url"]) & (best["finding_type"] == known["finding_type"])
    fresh = (
        best.join(known, same, "left")
        .filter(~F.coalesce("is_open", F.lit(False)))
        .select(*[best[c] for c in best.columns if c != "bucket"], F.coalesce("closed_before", F.lit(0)).alias("closed_before"))
    )
    folder = batch_folder(out, batch_id)
    new_findings(fresh, as_of).write.mode("overwrite").parquet(folder)
    _write(_counts(spark.read.parquet(folder), F.lit(1), F.lit(0)), _epoch(state, batch_id), FOUND, batch_id, buckets)


def append_available(stream: DataFrame, checkpoint: str, **how) -> None:
    """Run ``append_batch`` (``how``: its settings) over everything that has arrived."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, **how))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
