"""Disclosure and escalation plans. Nothing is sent; the plan tables are the output."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.config import Settings
from tidewatch.functions.text import (
    case_id,
    effective_confidence,
    finding_line,
    is_government,
    plus_hours,
    sla_summary,
)
from tidewatch.operators.findings import audit
from tidewatch.schemas import SEVERITIES, is_open, severity_rank
from tidewatch.session import as_of_column


def disclosure_queue(findings: DataFrame, as_of: str) -> DataFrame:
    """Undisclosed, open, and CRITICAL or due within 24 hours."""
    window_end = plus_hours(as_of_column(as_of), F.lit(rules.DISCLOSURE_WINDOW_HOURS))
    soon = F.coalesce(F.col("disclosure_sla_due") <= window_end, F.lit(False))
    return findings.filter(
        F.col("disclosed_at").isNull() & is_open(F.col("status")) & ((F.col("severity") == "CRITICAL") | soon)
    )


def escalation_queue(findings: DataFrame, as_of: str) -> DataFrame:
    """CRITICAL, disclosed and unacknowledged for 72 hours, or flagged and not yet escalated."""
    cutoff = plus_hours(as_of_column(as_of), F.lit(-rules.ESCALATION_WAIT_HOURS))
    silent = (
        (F.col("severity") == "CRITICAL")
        & (F.col("status") == "DISCLOSED")
        & F.col("acknowledged_at").isNull()
        & F.coalesce(F.col("disclosed_at") < cutoff, F.lit(False))
    )
    flagged = (
        F.col("dark_web_confirmed")
        & F.col("severity").isin("CRITICAL", "HIGH")
        & (F.col("escalation_level") < 3)
        & is_open(F.col("status"))
    )
    return findings.filter(silent | flagged)


# --------------------------------------------------------------------------
# Per-domain summary text
# --------------------------------------------------------------------------


def batch_summary(batch: DataFrame, as_of: str, lines: int = 5, types: int = 5) -> DataFrame:
    """One row per domain of a batch: counts, severity text, first types and all types, first finding lines.

    Order inside a batch is most severe first, then finding id. Everything but
    the lines comes from one aggregate per (domain, type), which Spark computes
    once and reuses; types and lines are cut to a few per domain before anything
    is collected, so a domain with very many findings never gathers in one place.
    """
    rank = severity_rank(F.col("severity"))
    order = F.struct(rank.alias("r"), F.col("finding_id").alias("id"))
    by_type = batch.groupBy("domain_id", "finding_type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES],
        F.min(F.struct(order.alias("o"), F.col("severity").alias("s"))).alias("first"),
        F.max(F.col("dark_web_confirmed")).alias("dark"),
        F.count_if(F.col("disclosure_sla_due") < as_of_column(as_of)).alias("overdue"),
    )
    counts = by_type.groupBy("domain_id").agg(
        F.sum("n").alias("n_findings"),
        *[F.sum(f"n_{s}").alias(f"n_{s}") for s in SEVERITIES],
        F.min("first").alias("first"),
        F.max("dark").alias("any_dark_web"),
        F.sum("overdue").alias("n_overdue"),
    )
    counts = counts.withColumns(
        {"top_severity": F.col("first.s"), "first_finding_id": F.col("first.o.id")}
    ).drop("first")
    parts = [
        F.when(F.col(f"n_{s}") > 0, F.concat(F.col(f"n_{s}").cast("string"), F.lit(f" {s}"))) for s in SEVERITIES
    ]

    w = Window.partitionBy("domain_id").orderBy("first.o", "finding_type")
    # A domain has as many types as rules exist, so all of them can be gathered.
    all_types = by_type.groupBy("domain_id").agg(F.array_sort(F.collect_list(F.struct("first.o", "finding_type"))).alias("t"))
    all_types = all_types.select("domain_id", F.transform("t", lambda x: x["finding_type"]).alias("types"))
    top_types = (
        by_type.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= types)
        .groupBy("domain_id").agg(F.array_sort(F.collect_list(F.struct("rn", "finding_type"))).alias("t"))
        .select("domain_id", F.array_join(F.transform("t", lambda x: x["finding_type"]), ", ").alias("types_text"))
    )

    w = Window.partitionBy("domain_id").orderBy(rank, "finding_id")
    path = F.col("url_path") if "url_path" in batch.columns else F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1)
    confidence = effective_confidence(F.col("final_confidence"), F.col("heuristic_confidence"))
    top_lines = (
        batch.select("domain_id", "finding_id", "severity", "finding_type", path.alias("p"), confidence.alias("c"))
        .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= lines)
        .select("domain_id", "rn", finding_line(F.col("rn"), F.col("severity"), F.col("finding_type"), F.col("p"), F.col("c")).alias("line"))
        .groupBy("domain_id").agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("l"))
        .select("domain_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines_text"))
    )
    return (
        counts.withColumn("severity_text", F.concat_ws(", ", *parts))
        .join(top_types, "domain_id")
        .join(all_types, "domain_id")
        .join(top_lines, "domain_id")
    )


def _join_lines(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name:<16}: "), value.cast("string"))


def notice_subject(settings: Settings, domain: Column, top: Column) -> Column:
    return F.concat(
        F.lit(f"[{settings.platform}] Security disclosure: "), domain, F.lit(" - "), top, F.lit(" | CVD-"), case_id(domain)
    )


def owner_body(settings: Settings, as_of: str) -> Column:
    domain = F.col("domain")
    copied = F.when(
        is_government(domain), F.lit(f"Copied to the government response team ({settings.government_team_email}).")
    )
    source = F.when(
        F.col("contact_source") != "stored", F.concat(F.lit("Contact found via "), F.col("contact_source"), F.lit("."))
    )
    return _join_lines(
        "Security disclosure notice", "",
        F.concat(F.lit("Exposures were found on "), domain, F.lit(".")), source, copied, "",
        _field("Severity", F.col("severity_text")), _field("Types", F.col("types_text")), "",
        "Findings (no credential or personal value is included):", F.col("lines_text"), "",
        "Please acknowledge within 48 hours, send a remediation timeline, and tell us when it is fixed.",
        "A CRITICAL finding without acknowledgement after 72 hours may go to the national response team.", "",
        _field("Reference", F.concat(F.lit("CVD-"), case_id(domain))),
        _field("Date", F.date_format(as_of_column(as_of), "yyyy-MM-dd")),
        _field("Acknowledge", F.concat(F.lit(settings.ack_url), F.col("ack_token"))),
    )


def national_body(settings: Settings, as_of: str) -> Column:
    def known(c: str, default: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(default))

    return _join_lines(
        "Incident report", "",
        _field("Domain", F.col("domain")), _field("Sector", known("sector", "UNKNOWN")),
        _field("IP address", known("ip_address", "UNKNOWN")), _field("Origin score", known("iocs_score", "0")),
        _field("Vendor", known("vendor_fingerprint", "N/A")), _field("Contact", known("contact_email", "Not found")), "",
        _field("Findings", F.col("n_findings")), _field("Severity", F.col("severity_text")),
        _field("Types", F.col("types_text")),
        _field("Dark web", F.when(F.col("any_dark_web"), F.lit("YES")).otherwise(F.lit("NO"))),
        _field("SLA", sla_summary(F.col("n_overdue"))), "",
        "Affected paths (no credential or personal value is included):", F.col("lines_text"), "",
        _field("Reference", F.concat(F.lit("CVD-"), case_id(F.col("domain")))),
        _field("Date", F.date_format(as_of_column(as_of), "yyyy-MM-dd")),
    )


def ack_token(settings: Settings, domain_id: Column, as_of: str) -> Column:
    """Keyed hash instead of a random token, so that a re-run gives the same plan."""
    return F.sha2(F.concat_ws("|", F.lit(settings.salt), domain_id.cast("string"), F.lit(as_of)), 256)


# --------------------------------------------------------------------------
# Plans
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """``notices`` one per domain, ``events`` one per finding and recipient."""

    notices: DataFrame
    events: DataFrame
    findings: DataFrame
    audit: DataFrame


def stored_or_found(domains: DataFrame, contacts: DataFrame) -> DataFrame:
    """Add ``contact_source`` and fill ``contact_email`` from resolved contacts."""
    found = contacts.select("domain", F.col("email").alias("_e"), F.col("source").alias("_s"))
    rest = [c for c in domains.columns if c != "contact_email"]
    return domains.join(found, "domain", "left").select(
        *rest,
        F.coalesce("contact_email", "_e", F.concat(F.lit("security@"), F.col("domain"))).alias("contact_email"),
        F.when(F.col("contact_email").isNotNull(), "stored").otherwise(F.coalesce("_s", F.lit("convention"))).alias("contact_source"),
    )


def disclosure_notices(queue: DataFrame, domains: DataFrame, settings: Settings, as_of: str) -> DataFrame:
    """One notice per domain in the queue; ``domains`` carries contact_email and contact_source."""
    columns = ["domain_id", "domain", "contact_email", "contact_source"]
    facts = batch_summary(queue, as_of).join(domains.select(*columns), "domain_id")
    tokened = facts.withColumn("ack_token", ack_token(settings, F.col("domain_id"), as_of))
    recipient = F.coalesce("contact_email", F.concat(F.lit("security@"), F.col("domain")))
    copies = F.when(is_government(F.col("domain")), F.lit(settings.government_team_email))
    return tokened.select(
        "domain_id", "domain", recipient.alias("recipient_email"), copies.alias("cc_email"),
        "contact_source", "n_findings", F.col("n_CRITICAL").alias("n_critical"), "first_finding_id", "ack_token",
        notice_subject(settings, F.col("domain"), F.col("top_severity")).alias("subject"),
        owner_body(settings, as_of).alias("body"),
    )


def disclosure_plan(
    findings: DataFrame, domains: DataFrame, settings: Settings, as_of: str, cut: Callable[[DataFrame], DataFrame] = lambda df: df
) -> Plan:
    """Notices, events, new finding states and audit rows of one disclosure run.

    ``cut`` may write the notices and the changed findings to the shared folder and read them
    back, for callers that use the whole plan: the other tables come from these.
    """
    queue = disclosure_queue(findings, as_of)
    notices = cut(disclosure_notices(queue, domains, settings, as_of))
    now = as_of_column(as_of)
    per_domain = notices.select("domain_id", "recipient_email", "cc_email", "subject", "ack_token", "first_finding_id")
    primary = F.struct(
        F.col("recipient_email").alias("email"), F.lit("PRIMARY").alias("type"),
        F.when(F.col("finding_id") == F.col("first_finding_id"), F.col("ack_token")).alias("token"),
    )
    copy = F.struct(F.col("cc_email").alias("email"), F.lit("CC_NIC").alias("type"), F.lit(None).cast("string").alias("token"))
    recipients = F.filter(F.array(primary, copy), lambda r: r["email"].isNotNull())
    rows = queue.select("finding_id", "domain_id").join(per_domain, "domain_id")
    events = rows.select("finding_id", "subject", F.explode(recipients).alias("r")).select(
        F.sha2(F.concat_ws("|", F.col("finding_id").cast("string"), "r.type", F.lit(as_of)), 256).alias("event_id"),
        "finding_id",
        F.col("r.email").alias("recipient_email"),
        F.col("r.type").alias("recipient_type"),
        "subject",
        now.alias("sent_at"),
        F.lit("PLANNED").alias("send_status"),
        F.col("r.token").alias("ack_token"),
        now.alias("created_at"),
    )
    sent = queue.join(domains.select("domain_id"), "domain_id", "left_semi")
    changed = cut(sent.withColumns({"disclosed_at": now, "status": F.lit("DISCLOSED")}))
    log = audit(
        notices, "DISCLOSURE_SENT", "SYSTEM", "domain", "domain_id", as_of,
        domain=F.col("domain"), findings_count=F.col("n_findings"), recipient=F.col("recipient_email"),
        contact_source=F.col("contact_source"), cc=F.col("cc_email"), critical_immediate=F.col("n_critical"),
    )
    return Plan(notices, events, changed, log)


def escalation_plan(
    findings: DataFrame, domains: DataFrame, settings: Settings, as_of: str, cut: Callable[[DataFrame], DataFrame] = lambda df: df
) -> Plan:
    """Escalation of the queue to the national team: level 3, ESCALATED. ``cut`` as in ``disclosure_plan``."""
    queue = escalation_queue(findings, as_of)
    now = as_of_column(as_of)
    columns = ["domain_id", "domain", "sector", "ip_address", "iocs_score", "vendor_fingerprint", "contact_email"]
    facts = batch_summary(queue, as_of, lines=10).join(domains.select(*columns), "domain_id")
    notices = cut(facts.select(
        "domain_id", "domain", F.lit(settings.national_team_email).alias("recipient_email"), "n_findings",
        F.col("types_text").alias("triggers"), F.col("types").alias("all_triggers"),
        notice_subject(settings, F.col("domain"), F.col("top_severity")).alias("subject"),
        national_body(settings, as_of).alias("body"),
    ))
    rows = queue.select("finding_id", "domain_id").join(notices.select("domain_id", "recipient_email", "subject"), "domain_id")
    events = rows.select(
        F.sha2(F.concat_ws("|", F.col("finding_id").cast("string"), F.lit("ESCALATION"), F.lit(as_of)), 256).alias("event_id"),
        "finding_id", "recipient_email", F.lit("CC_NIC").alias("recipient_type"), "subject",
        now.alias("sent_at"), F.lit("PLANNED").alias("send_status"),
        F.lit(None).cast("string").alias("ack_token"), now.alias("created_at"),
    )
    sent = queue.join(domains.select("domain_id"), "domain_id", "left_semi")
    changed = cut(sent.withColumns({"escalation_level": F.lit(3), "status": F.lit("ESCALATED")}))
    log = audit(
        notices, "CERTIN_ESCALATION", "SYSTEM", "domain", "domain_id", as_of,
        domain=F.col("domain"), findings=F.col("n_findings"), triggers=F.col("all_triggers"),
    )
    return Plan(notices, events, changed, log)
