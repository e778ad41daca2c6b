"""Risk scoring and breach correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.functions.text import merge_notes
from tidewatch.schemas import is_open, is_risk_open
from tidewatch.session import as_of_column, look_up
from tidewatch.sources.lookups import breach_counts, host_vulnerabilities


def risk_breakdown(findings: DataFrame, as_of: str) -> DataFrame:
    """Per-domain counts. Partial aggregation makes a domain with very many
    findings one small row per task before anything is shuffled."""
    now = as_of_column(as_of)
    status, severity = F.col("status"), F.col("severity")
    risk_open, overdue = is_risk_open(status), F.col("disclosure_sla_due") < now
    return findings.groupBy("domain_id").agg(
        F.count_if(risk_open & (severity == "CRITICAL")).alias("open_critical"),
        F.count_if(risk_open & (severity == "HIGH")).alias("open_high"),
        F.count_if(F.col("dark_web_confirmed")).alias("dark_web_hits"),
        F.count_if(overdue & is_open(status)).alias("sla_breached"),
        F.count_if(risk_open & F.col("dark_web_confirmed")).alias("open_dark_web"),
        F.count_if(risk_open & overdue).alias("open_overdue"),
    )


def vendor_factor(vendor: Column) -> Column:
    """Largest factor of the vendor names contained; dashes count as spaces."""
    name = F.replace(F.lower(F.coalesce(vendor, F.lit(""))), F.lit("-"), F.lit(" "))
    picks = [F.when(F.contains(name, F.lit(k)), F.lit(float(v))) for k, v in rules.VENDOR_RISK.items()]
    return F.coalesce(F.greatest(*picks), F.lit(1.0))


def sector_weight(sector: Column) -> Column:
    picks = [F.when(sector == s, F.lit(float(w))) for s, w in rules.SECTOR_WEIGHT.items()]
    return F.coalesce(*picks, F.lit(1.0))


def _capped(count: str, points: int, cap: int) -> Column:
    return F.least(F.coalesce(F.col(count), F.lit(0)) * points, F.lit(cap)).cast("double")


def risk_scores(domains: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    """Score 0..100 and breakdown of every ACTIVE domain."""
    counts = risk_breakdown(findings, as_of)
    joined = domains.filter(F.col("status") == "ACTIVE").join(counts, "domain_id", "left")
    base = reduce(
        lambda a, b: a + b,
        [
            F.least(F.coalesce(F.col("iocs_score"), F.lit(0)) / F.lit(4.0), F.lit(25.0)),
            _capped("open_critical", 15, 30),
            _capped("open_high", 8, 24),
            _capped("open_dark_web", 10, 20),
            _capped("open_overdue", 5, 10),
        ],
    )
    score = base * vendor_factor(F.col("vendor_fingerprint")) * sector_weight(F.col("sector"))
    shown = ("open_critical", "open_high", "dark_web_hits", "sla_breached")
    return joined.select(
        *domains.columns,
        F.least(score.cast("int"), F.lit(100)).alias("risk_score"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in shown],
    )


def with_risk_notes(scored: DataFrame, as_of: str) -> DataFrame:
    """Merge the breakdown into the ``notes`` JSON and drop the score columns."""
    shown = ["risk_score", "open_critical", "open_high", "dark_web_hits", "sla_breached"]
    update = F.to_json(
        F.struct(
            *shown,
            F.col("vendor_fingerprint").alias("vendor"),
            "sector",
            F.date_format(as_of_column(as_of), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("last_scored_at"),
        ),
        {"ignoreNullFields": "false"},
    )
    return scored.withColumn("notes", merge_notes(F.col("notes"), update)).drop(*shown)


# --------------------------------------------------------------------------
# Breach correlation
# --------------------------------------------------------------------------


def _note(source: str, as_of: str, breach: Column, vulns: Column) -> Column:
    day = F.date_format(as_of_column(as_of), "yyyy-MM-dd")
    return F.concat(
        F.lit(f"[BREACH CORRELATION {source} @ "), day, F.lit("] breach_count="), breach, F.lit(" vuln_count="), vulns
    )


def breach_evidence(domains: DataFrame, breaches: DataFrame, host_vulns: DataFrame, as_of: str) -> DataFrame:
    """``(domain_id, breach_note, vuln_note)`` of ACTIVE domains with any evidence."""
    active = domains.filter(F.col("status") == "ACTIVE").select("domain_id", "domain", "ip_address")
    leaks = breach_counts(breaches).select("domain", "breach_count")
    vulns = (
        host_vulnerabilities(host_vulns)
        .groupBy(F.col("ip").alias("ip_address"))
        .agg(F.max("vuln_count").alias("vuln_count"))
        .filter(F.col("vuln_count") > 0)
    )
    found = look_up(active, vulns, "ip_address").join(leaks, "domain", "left")
    missing = F.lit("?")
    return found.filter(F.col("breach_count").isNotNull() | F.col("vuln_count").isNotNull()).select(
        "domain_id",
        F.when(
            F.col("breach_count").isNotNull(), _note("HIBP", as_of, F.col("breach_count").cast("string"), missing)
        ).alias("breach_note"),
        F.when(
            F.col("vuln_count").isNotNull(), _note("SHODAN", as_of, missing, F.col("vuln_count").cast("string"))
        ).alias("vuln_note"),
    )


def _append_once(text: Column, note: Column) -> Column:
    """Append a note on its own line unless it is there already."""
    longer = F.when(text == "", note).otherwise(F.concat(text, F.lit("\n"), note))
    return F.when(note.isNull() | F.contains(text, note), text).otherwise(longer)


def mark_breached(findings: DataFrame, evidence: DataFrame, as_of: str | None = None) -> DataFrame:
    """Flag open CRITICAL/HIGH findings of domains with evidence; all findings are returned."""
    joined = findings.join(evidence, "domain_id", "left")
    has = F.col("breach_note").isNotNull() | F.col("vuln_note").isNotNull()
    hit = has & F.col("severity").isin("CRITICAL", "HIGH") & is_open(F.col("status"))
    text = F.coalesce("context_snippet_safe", F.lit(""))
    noted = _append_once(_append_once(text, F.col("breach_note")), F.col("vuln_note"))
    changed = {
        "dark_web_confirmed": F.when(hit, F.lit(True)).otherwise(F.col("dark_web_confirmed")),
        "context_snippet_safe": F.when(hit, noted).otherwise(F.col("context_snippet_safe")),
        "escalation_level": F.when(hit, F.greatest("escalation_level", F.lit(1))).otherwise(F.col("escalation_level")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in findings.columns])


def breach_counters(domains: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: domains checked and domains with evidence."""
    checked = domains.filter(F.col("status") == "ACTIVE").select(F.lit(1).alias("checked"), F.lit(0).alias("breached"))
    found = evidence.select(F.lit(0).alias("checked"), F.lit(1).alias("breached"))
    return checked.unionByName(found).agg(F.sum("checked").alias("checked"), F.sum("breached").alias("breached"))
