"""Saving findings: dedup, quarantine, defaults and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.masking import display_url
from tidewatch.functions.text import sla_due
from tidewatch.schemas import CONFIDENCE, ENTITY_TYPES, SEVERITIES, is_open
from tidewatch.session import as_of_column, handover
from tidewatch.sources.buckets import BucketTable
from tidewatch.sources.ledger import finding_key

DEDUP_KEY = ["domain_id", "url", "finding_type"]


def dedup_in_run(candidates: DataFrame) -> DataFrame:
    """One candidate per (domain, url, type): the most confident one."""
    rest = [c for c in candidates.columns if c not in DEDUP_KEY]
    best = F.max_by(F.struct(*rest), F.struct("confidence", F.xxhash64(*rest)))
    return candidates.groupBy(*DEDUP_KEY).agg(best.alias("_b")).select(*DEDUP_KEY, "_b.*")


def not_already_open(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Drop candidates whose (domain, url, type) is already open in the ledger."""
    open_keys = findings.filter(is_open(F.col("status"))).select(*DEDUP_KEY)
    return candidates.join(open_keys, DEDUP_KEY, "left_anti")


def split_valid(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)``: a row the ledger would reject does not fail its batch."""
    problem = F.coalesce(
        F.when(F.col("domain_id").isNull(), F.lit("domain missing")),
        F.when(F.col("url").isNull(), F.lit("url missing")),
        F.when(F.col("finding_type").isNull(), F.lit("finding type missing")),
        F.when(F.col("severity").isNull() | ~F.col("severity").isin(*SEVERITIES), F.lit("unknown severity")),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence out of range")),
    )
    marked = candidates.withColumn("problem", problem)
    return marked.filter(F.col("problem").isNull()).drop("problem"), marked.filter(F.col("problem").isNotNull())


def with_closed_before(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Add ``closed_before``: how many closed findings of the ledger have this key."""
    closed = findings.filter(~is_open(F.col("status"))).groupBy(*DEDUP_KEY).agg(F.count("*").alias("closed_before"))
    return candidates.join(closed, DEDUP_KEY, "left").withColumn("closed_before", F.coalesce("closed_before", F.lit(0)))


def against_ledger(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """``not_already_open`` and ``with_closed_before`` in one: the ledger is added up once by key and joined once."""
    shut = ~is_open(F.col("status"))
    known = findings.groupBy(*DEDUP_KEY).agg(F.count_if(shut).alias("closed_before"), F.count_if(~shut).alias("_open"))
    joined = candidates.join(known, DEDUP_KEY, "left").filter(F.coalesce("_open", F.lit(0)) == 0).drop("_open")
    return joined.withColumn("closed_before", F.coalesce("closed_before", F.lit(0)))


def split_known(candidates: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(known, quarantined)``: a finding needs a domain of the inventory."""
    known = domains.select(F.col("domain_id").alias("_known")).distinct()
    marked = candidates.join(known, candidates["domain_id"] == known["_known"], "left")
    unknown = marked.filter(F.col("_known").isNull()).drop("_known")
    return marked.filter(F.col("_known").isNotNull()).drop("_known"), unknown.withColumn("problem", F.lit("unknown domain"))


def new_findings(candidates: DataFrame, as_of: str | Column, detected_by: str = "HEURISTIC") -> DataFrame:
    """Ledger rows for valid candidates: key, entity fallback, both confidences, SLA, defaults."""
    now = as_of_column(as_of)
    confidence = F.col("confidence").cast(CONFIDENCE)
    known = F.col("entity_type").isin(*ENTITY_TYPES)
    optional = {
        "http_status": F.lit(200), "value_hash": F.lit(None).cast("string"),
        "value_count_estimate": F.lit(1), "context_snippet_safe": F.lit(""),
        "content_type": F.lit(""), "file_size_bytes": F.lit(None).cast("long"),
        "vendor_fingerprint": F.lit(None).cast("string"), "url_path": F.lit(None).cast("string"),
    }
    given = {n: F.col(n) if n in candidates.columns else default for n, default in optional.items()}
    return candidates.select(
        finding_key(
            F.col("domain_id").cast("string"),
            F.col("url"),
            F.col("finding_type"),
            F.col("closed_before") if "closed_before" in candidates.columns else None,
        ).alias("finding_id"),
        "domain_id",
        "url",
        "finding_type",
        F.when(known, F.col("entity_type")).otherwise(F.lit("OTHER")).alias("entity_type"),
        "severity",
        confidence.alias("heuristic_confidence"),
        confidence.alias("final_confidence"),
        *[c.alias(n) for n, c in given.items()],
        F.lit("NEW").alias("status"),
        F.lit(False).alias("dark_web_confirmed"),
        F.lit(0).alias("escalation_level"),
        F.lit(detected_by).alias("detected_by"),
        sla_due(now, F.col("severity")).alias("disclosure_sla_due"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def save_findings(
    candidates: DataFrame, findings: DataFrame, as_of: str, domains: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rows to append, quarantined rows)``. Appending the same batch twice adds nothing.

    With ``domains``, findings of domains outside that inventory are quarantined.
    """
    valid, bad = split_valid(candidates)
    if domains is not None:
        valid, orphans = split_known(valid, domains)
        bad = bad.unionByName(orphans)
    return new_findings(against_ledger(dedup_in_run(valid), findings), as_of), bad


def save_to_buckets(
    candidates: DataFrame, table: BucketTable, version: int, as_of: str, domains: DataFrame | None = None
) -> tuple[int, DataFrame, DataFrame]:
    """``save_findings`` against a ledger in hash buckets of the dedup key: ``(new version, appended rows, quarantined rows)``.

    Only the buckets that candidates fall into are read, and only those with new findings get a new part. What is
    written between is one row for each key; the quarantined rows are read from the candidates if they are asked for.
    """
    valid, bad = split_valid(candidates)
    if domains is not None:
        valid, orphans = split_known(valid, domains)
        bad = bad.unionByName(orphans)
    best = handover(dedup_in_run(valid), "bucket-best")
    known = table.read(best.sparkSession, version, table.touched(best))
    rows = handover(new_findings(against_ledger(best, known), as_of), "bucket-findings")
    given = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in table.schema}
    placed = rows.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in table.schema])
    return table.append(placed, version), rows, bad


def audit(
    df: DataFrame, event_type: str, actor: str | Column, target_type: str, target_id: str, as_of: str, **details: Column
) -> DataFrame:
    """One audit row per row of ``df``, with the details as a JSON object."""
    who = F.lit(actor) if isinstance(actor, str) else actor
    body = F.struct(*[c.alias(n) for n, c in details.items()])
    return df.select(
        F.lit(event_type).alias("event_type"),
        who.alias("actor"),
        F.lit(target_type).alias("target_type"),
        F.col(target_id).cast("string").alias("target_id"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("details"),
        as_of_column(as_of).alias("event_at"),
    )


def audit_run(counters: DataFrame, event_type: str, as_of: str, *, name: str, value: str = "n", scope: str = "") -> DataFrame:
    """One audit row for a whole run, its counters as details.

    ``counters`` is a small table of ``(name, value)`` rows, one per outcome.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col(value).alias("v"))))
    one = counters.agg(F.to_json(F.map_from_entries(pairs)).alias("counters"))
    return one.select(
        F.lit(event_type).alias("event_type"),
        F.lit("SYSTEM").alias("actor"),
        F.lit("run").alias("target_type"),
        F.lit(scope).alias("target_id"),
        F.col("counters").alias("details"),
        as_of_column(as_of).alias("event_at"),
    )


def audit_created(rows: DataFrame, as_of: str) -> DataFrame:
    return audit(
        rows, "FINDING_CREATED", "SCANNER", "finding", "finding_id", as_of,
        finding_type=F.col("finding_type"), severity=F.col("severity"), url=display_url(F.col("url")),
        entity_type=F.col("entity_type"), confidence=F.col("heuristic_confidence"),
    )
