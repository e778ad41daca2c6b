"""Incremental detection over arriving text, and bounded-state dedup of findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.content_scan import DEFAULT_RULES, scan_content
from tidewatch.rules import ContentRule


def arriving(spark: SparkSession, path: str, schema: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Stream of Parquet files under ``path``."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out.rstrip('/')}/batch_id={batch_id}"


def detect_available(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    detect: Callable[[DataFrame], DataFrame],
    key: Sequence[str],
) -> None:
    """Run ``detect`` on everything that has arrived and append what is new.

    Each batch overwrites its own folder, so a batch repeated after a failure
    replaces itself; rows whose key an earlier batch wrote are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = detect(batch).dropDuplicates(list(key))
        if batch_id > 0:
            earlier = batch.sparkSession.read.parquet(out).filter(F.col("batch_id") < batch_id)
            found = found.join(earlier.select(*key), list(key), "left_anti")
        found.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def scan_available(
    stream: DataFrame, text: str, *, key: str, salt: str, out: str, checkpoint: str,
    rules: Sequence[ContentRule] = DEFAULT_RULES,
) -> DataFrame:
    """Content scan of everything that has arrived; returns all findings written so far.

    Detection is stateless, so the file sink alone makes each file count once.
    """
    found = scan_content(stream, text, key=key, salt=salt, rules=rules)
    query = (
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(found.schema).parquet(out)


def dedup_stream(findings: DataFrame, event_time: str = "fetched_at", delay: str = "1 hour", key: str = "finding_id") -> DataFrame:
    """Drop repeats of a finding across batches, with state bounded by the watermark."""
    return findings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def dedup_available(
    stream: DataFrame, out: str, checkpoint: str, *, event_time: str = "fetched_at", delay: str = "1 hour", key: str = "finding_id"
) -> int:
    """Append the first arrival of each key among everything that has arrived; returns how many rows came too late.

    A row is late if its event time lies ``delay`` or more behind the latest one of earlier batches. Late rows are dropped,
    since the state that could tell whether they are repeats is gone by then; the state holds keys of the last ``delay`` only.
    """
    query = (
        dedup_stream(stream, event_time, delay, key).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    states = [state for progress in query.recentProgress for state in progress["stateOperators"]]
    return sum(state["numRowsDroppedByWatermark"] for state in states)


def with_finding_key(hits: DataFrame, domain: str, url: str) -> DataFrame:
    return hits.withColumn("finding_id", F.sha2(F.concat_ws("|", domain, url, "finding_type"), 256))
