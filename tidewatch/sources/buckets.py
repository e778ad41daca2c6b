"""Ledger tables in hash buckets: a change reads and writes the buckets it falls into, and no others.

``rows/version=V/bucket=B`` holds what version V wrote of bucket B, and ``parts/version=V``
the (bucket, written) pairs that make up the table after version V. An append adds its own
pairs; a rewrite replaces those of its buckets. Folders of finished versions are never
written again, and the pairs come last, so that an interrupted version does not count and
can be repeated under the same number.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A bucket in more parts than these is written anew by the next append to it.
MOST_PARTS = 50
# Stands in place of a bucket's number in every whole list of pairs.
MARK = -1


@dataclass(frozen=True)
class BucketTable:
    """A table by the hash of ``keys`` (compared as text; nulls have a bucket too). ``number`` bounds what the driver sees."""

    base: str
    schema: StructType
    keys: tuple[str, ...]
    number: int = 256

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.number)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: at most ``number`` integers."""
        return sorted(r[0] for r in rows.select(self.bucket_of().alias("b")).distinct().collect())

    def _pairs(self, spark: SparkSession, version: int) -> list[tuple[int, int]] | None:
        """Pairs as written, with the mark of a whole list; None where the version has none."""
        try:
            rows = spark.read.schema("bucket int, written int").parquet(f"{self.base}/parts/version={version}").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return sorted((r.bucket, r.written) for r in rows) or None

    def parts(self, spark: SparkSession, version: int) -> list[tuple[int, int]]:
        """(bucket, written) pairs of the table after a version: at most ``MOST_PARTS`` + 1 for each bucket."""
        pairs = self._pairs(spark, version)
        if pairs is None:
            raise ValueError(f"version {version} of {self.base} is not finished")
        return [p for p in pairs if p[0] != MARK]

    def read(self, spark: SparkSession, version: int, only: list[int] | None = None) -> DataFrame:
        """The table after a version, or some of its buckets. No file of other buckets is listed or read."""
        wanted = None if only is None else set(only)
        paths = [f"{self.base}/rows/version={v}/bucket={b}" for b, v in self.parts(spark, version) if wanted is None or b in wanted]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def create(self, rows: DataFrame) -> None:
        """Version 0."""
        self._write(rows, 0, [])

    def append(self, rows: DataFrame, version: int) -> int:
        """Add rows to the table after ``version``; returns the new version. ``rows`` should be a written table, as it is read twice."""
        spark = rows.sparkSession
        parts = self.parts(spark, version)
        count = Counter(b for b, _ in parts)
        full = {b for b, n in count.items() if n >= MOST_PARTS}
        crowded = [b for b in self.touched(rows) if b in full] if full else []
        if crowded:
            rows = rows.select(*self.schema.names).unionByName(self.read(spark, version, crowded))
        gone = set(crowded)
        self._write(rows, version + 1, [p for p in parts if p[0] not in gone])
        return version + 1

    def rewrite(self, rows: DataFrame, version: int, buckets: list[int]) -> int:
        """Put ``rows`` in the place of all rows of some buckets; returns the new version."""
        gone = set(buckets)
        self._write(rows.filter(self.bucket_of().isin(buckets)), version + 1, [p for p in self.parts(rows.sparkSession, version) if p[0] not in gone])
        return version + 1

    def _write(self, rows: DataFrame, version: int, kept: list[tuple[int, int]]) -> None:
        spark = rows.sparkSession
        if self._pairs(spark, version) is not None:
            raise ValueError(f"version {version} of {self.base} is finished")
        folder = f"{self.base}/rows/version={version}"
        placed = rows.select(*self.schema.names).withColumn("bucket", self.bucket_of())
        # A bucket goes to eight tasks by the hash of its rows, so that a hot key does not make one task long.
        plain = [F.col(f.name) for f in self.schema if f.dataType.simpleString().isalpha()]
        lane = F.pmod(F.xxhash64(*plain), F.lit(8))
        placed.repartition("bucket", lane).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = spark.read.schema("bucket int").parquet(folder).distinct().collect()
        pairs = [*kept, *[(r.bucket, version) for r in written], (MARK, version)]
        spark.createDataFrame(pairs, "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/parts/version={version}")
