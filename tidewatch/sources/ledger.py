"""Ledger tables: typed reads, idempotent appends and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import LEDGER


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Scan one ledger table with its declared schema."""
    return spark.read.schema(LEDGER[table]).format(fmt).load(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Scan a ledger table from a database in parallel ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .options(partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
    )


def finding_key(domain: Column, url: Column, finding_type: Column, closed_before: Column | None = None) -> Column:
    """Deterministic finding id: the dedup key, hashed, so that re-runs agree.

    An exposure found again after it was closed is a finding of its own: how often
    it was closed before is part of the key, unless that is 0.
    """
    again = F.when(closed_before > 0, closed_before.cast("string")) if closed_before is not None else F.lit(None)
    return F.sha2(F.concat_ws("|", domain, url, finding_type, again), 256)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append rows that an anti-join has already made new."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write a full table as a new version beside the one being read.

    The path read is never overwritten, so a lost executor can always recompute.
    """
    target = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def read_snapshot(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/version={version}")
