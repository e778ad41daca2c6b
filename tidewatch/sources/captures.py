"""Web captures at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import canonical_host
from tidewatch.schemas import CAPTURES


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet", max_chars: int | None = None) -> DataFrame:
    """Scan captures with the declared schema.

    Bodies are kept whole. ``max_chars`` cuts them for a user who wants the
    scanner-style limits (50,000 home page, 10,000 validators, 8,000 filter).
    """
    df = spark.read.schema(CAPTURES).format(fmt).load(path)
    if max_chars is None:
        return df
    return df.withColumn("body", F.substring("body", 1, max_chars))


def home_captures(captures: DataFrame) -> DataFrame:
    """Usable captures of home pages: the root path, a status below 500, http or https."""
    root = F.coalesce("path", F.lit("")).isin("", "/")
    return captures.filter(root & (F.col("status") < 500) & F.col("scheme").isin("https", "http"))


def best_capture(captures: DataFrame) -> DataFrame:
    """One home page per domain: status below 500, https before http, then newest.

    Captures at other paths, such as those of path rules, never stand for the domain.

    ``row_number() = 1`` is planned as a per-partition limit before the
    shuffle, so a domain with very many captures sends few rows.
    """
    rank = F.when(F.col("scheme") == "https", 0).otherwise(1)
    order = Window.partitionBy("domain").orderBy(rank, F.col("fetched_at").desc_nulls_last(), F.col("url"))
    return home_captures(captures).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def base_urls(captures: DataFrame) -> DataFrame:
    """Base URL per domain from its best capture, on the stored host or its www twin."""
    host = canonical_host(F.col("url"), F.col("domain"))
    return best_capture(captures).select(
        "domain", F.concat("scheme", F.lit("://"), host).alias("base_url"), host.alias("host")
    )
