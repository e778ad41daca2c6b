"""Token counts of whole texts by a compiled transducer (see ``transducer``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_batch, ready, texts_of
from tidewatch.llm.transducer import compiled


def token_counts(
    docs: DataFrame, tokenizer: str, *, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return ``key``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    ``tokenizer`` is the path of a byte-level BPE file in JSON form, read on the
    driver; the vocabulary, of fixed size, is sent to the tasks. The counts are
    the library's with its defaults: no begin or end tokens; the string of the
    special token counts as that one token.

    Null and empty texts have 0 bytes and 0 tokens. Null and repeated keys are
    kept as rows of their own; other columns are not read; no rows give no rows.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = ready(docs.sparkSession).sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType

    def make():
        machine = compiled(source.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = pa.array([n for n, _ in machine.run(texts_of(batch, "text"), with_ids=False)], pa.int64())
            sizes = pa.array([len(t) for t in texts_of(batch, "text")], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("key"), sizes, counts], ["key", "n_bytes", "n_tokens"])

        return step

    counted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        by_batch(make), f"key {kind.simpleString()}, n_bytes long, n_tokens long"
    )
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit")
    )
