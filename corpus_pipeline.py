"""A corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of documents, whatever further columns these have; rows with null
keys or texts and repeated rows pass through each stage by its operator's rules.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, langid, packing, simhash, substring_dedup
from tidewatch.llm.common import keep, shuffles_freed, table
from tidewatch.session import checkpoint_root

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LEAST_SCORE = 0.3


def _renamed(docs: DataFrame, names: list[str]) -> DataFrame:
    """Columns of a decision under names that clash with none of the documents'."""
    mark = uuid.uuid4().hex[:8]
    return docs.withColumnsRenamed({n: f"_{n}_{mark}" for n in names})


def _decided(docs: DataFrame, decision: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Documents with a decision's other columns, joined null-safe by doc_id (and the text's hash, if it has it)."""
    single = _renamed(decision.dropDuplicates(keys), decision.columns)
    name = dict(zip(decision.columns, single.columns, strict=True))
    on = docs["doc_id"].eqNullSafe(single[name["doc_id"]])
    if "text_hash" in keys:
        on &= F.xxhash64(docs["text"]).eqNullSafe(single[name["text_hash"]])
    return docs.join(single, on, "left"), name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those of no language that the network knows (best score below 0.3).

    Learns from the labelled documents outside the held-out third. A document
    whose doc_id several rows share goes only if all of these would.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = keep(langid.predict(docs, model), "languages")
    fine = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    kept = _renamed(found.filter(fine).select("doc_id").distinct(), ["doc_id"])
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[kept.columns[0]]), "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group.

    Different texts under one doc_id are one document and stay or go together, so that no text without a near duplicate is
    lost; of rows equal in doc_id and text one stays. Rows without a doc_id all stay.
    """
    groups = simhash.near_duplicates(docs, shingle=5, similarity=0.8)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = _renamed(first, first.columns)
    mark = f"_{uuid.uuid4().hex[:8]}"
    stay = docs.join(kept, docs["doc_id"] == kept[kept.columns[0]], "left_semi").withColumn(mark, F.xxhash64("text"))
    return stay.dropDuplicates(["doc_id", mark]).drop(mark).unionByName(docs.filter("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that an earlier document has; documents of which nothing is left go.

    A cut text is its kept words joined by one space, with n_chars as counted
    anew. Texts without repeats stay as they are.
    """
    result = substring_dedup.remove_repeats(docs, window=50).filter("kept_text IS NOT NULL")
    joined, name = _decided(docs, result.select("doc_id", "text_hash", "kept_text"), ["doc_id", "text_hash"])
    cut = joined[name["kept_text"]]
    new = {"text": F.coalesce(cut, docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut.isNotNull(), F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return joined.filter(cut.isNull() | (cut != "")).select(
        *(new[c].alias(c) if c in new else docs[c] for c in docs.columns)
    )


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also those without a doc_id.

    A doc_id that several rows share goes if one of them does; rows without one go by their own text.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    leaks = decontamination.leaked_items(texts, table(spark, sf_dir, "benchmark"), key="text_hash")
    leaked = keep(leaks.select("text_hash").distinct(), "leaked-texts")
    ids = texts.join(leaked, "text_hash", "left_semi").filter("doc_id IS NOT NULL").select("doc_id").distinct()
    gone, own = _renamed(ids, ["doc_id"]), _renamed(leaked, ["text_hash"])
    clean = docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
    return clean.join(own, F.xxhash64(clean["text"]) == own[own.columns[0]], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens: a row a piece."""
    return packing.pack_best_fit(docs, TOKENIZER, capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
# No stage can be expressed in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = f"{checkpoint_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            with shuffles_freed(spark):
                docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
