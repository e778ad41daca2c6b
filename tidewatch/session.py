"""Session settings and the few partitioning helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the results depend on (UTC) or that keep hot keys from
# becoming one straggling task (adaptive skew splitting, also where it costs an
# extra exchange).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# A look-up key is hot with more than one in so many rows; rows that the look-up's shuffle has nothing for go in so many lanes.
HOT_SHARE, HOT_LANES = 64, 4096


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one
    machine may leave it unset; then a fresh folder is made. On a cluster a
    machine-local folder would lose rows, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def handover(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    For a result that several later steps use: it is computed once, later plans
    start from the written table, and a lost executor rereads it.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that is too coarse to keep the cluster busy.

    Call it on a scan, before any join. Text work costs far more than the scan,
    so a file with one row group would leave one busy task. Nothing is shuffled
    unless the session asks for it with ``tidewatch.scanPartitions``. Hashing on
    the row key keeps a recomputed task's rows the same after an executor is lost.
    """
    partitions = df.sparkSession.conf.get("tidewatch.scanPartitions", None)
    if df.isStreaming or not partitions:
        return df
    return df.repartition(int(partitions), *keys)


def look_up(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join of a look-up table that has at most one row for each ``key``; null keys find nothing.

    Rows go in two lanes. A key with more than one in ``HOT_SHARE`` of the rows that have a key is hot: there are fewer than
    ``HOT_SHARE`` of them, so their facts are broadcast. Other keys are joined by a shuffle, in which hot rows and
    rows without a key, that need nothing from it, are dealt evenly instead of by their key. Keys are compared as text.
    """
    mark = uuid.uuid4().hex[:8]
    hot, cold = f"_hot_{mark}", f"_cold_{mark}"
    new = [c for c in facts.columns if c != key]
    per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    often = per_key.filter(F.col("n") * HOT_SHARE > per_key.agg(F.sum("n")).scalar()).select(key)
    known = facts.join(F.broadcast(often), key, "left_semi")
    first = F.broadcast(often.join(known, key, "left").select(F.col(key).alias(hot), *[F.col(c).alias(f"{c}_{hot}") for c in new]))
    marked = df.join(first, df[key] == first[hot], "left")
    # One text column: a key that is looked up, or the lane of a row that isn't.
    dealt = [c for c, kind in df.dtypes if kind.isalpha() and kind != "variant"]
    lane = F.pmod(F.xxhash64(*dealt), F.lit(HOT_LANES)).cast("string")
    asks = F.col(key).isNotNull() & F.col(hot).isNull()
    rest = marked.withColumn(cold, F.when(asks, F.concat(F.lit("key "), F.col(key).cast("string"))).otherwise(F.concat(F.lit("lane "), lane)))
    second = facts.select(F.concat(F.lit("key "), F.col(key).cast("string")).alias(f"_{cold}"), *[F.col(c).alias(f"{c}_{cold}") for c in new])
    found = rest.join(second, rest[cold] == second[f"_{cold}"], "left")
    return found.select(*[df[c] for c in df.columns], *[F.coalesce(f"{c}_{hot}", f"{c}_{cold}").alias(c) for c in new])


def as_of_column(as_of: str | Column) -> Column:
    """``as_of`` as a timestamp column; strings are read as UTC."""
    if isinstance(as_of, Column):
        return as_of
    return F.to_timestamp(F.lit(as_of))
