"""Dashboard figures, lists and detail reports over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.functions.text import effective_confidence, note_int, plus_hours
from tidewatch.operators.disclosure import disclosure_queue
from tidewatch.schemas import is_open, severity_rank
from tidewatch.session import as_of_column

MAX_PAGE = 100
MAX_AUDIT_PAGE = 200


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 25, largest: int = MAX_PAGE) -> DataFrame:
    """One page. Planned as a top-k, so no full sort is shuffled."""
    if not 1 <= per_page <= largest:
        raise ValueError(f"per_page must be between 1 and {largest}")
    if page < 1:
        raise ValueError("page starts at 1")
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def write_paged(df: DataFrame, path: str, order: Column, key: str, files: int = 32) -> DataFrame:
    """Write a list in the order of its pages, one range of it a file, so that ``page_after`` reads the files of its page only.

    The sort value is stored as ``sort_value``; ``order`` is ascending with nulls last, so negate a number to descend.
    """
    rows = df.withColumn("sort_value", order)
    by = [F.col("sort_value").asc_nulls_last(), F.col(key).asc()]
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def page_after(paged: DataFrame, key: str, after: tuple[object, object] | None = None, per_page: int = 25, largest: int = MAX_PAGE) -> DataFrame:
    """The page that follows the row ``after`` (its sort value and key), or the first one.

    A seek instead of an offset: rows before the cursor are not read, however deep the page is. The page is planned as a
    top-k of what the pushed filter leaves.
    """
    if not 1 <= per_page <= largest:
        raise ValueError(f"per_page must be between 1 and {largest}")
    value = F.col("sort_value")
    if after is not None and after[0] is None:
        paged = paged.filter(value.isNull() & (F.col(key) > F.lit(after[1])))
    elif after is not None:
        at = F.lit(after[0]).cast(paged.schema["sort_value"].dataType)
        # The first condition alone can be pushed to the files' statistics.
        paged = paged.filter((value >= at) | value.isNull()).filter(value.isNull() | (value > at) | ((value == at) & (F.col(key) > F.lit(after[1]))))
    return paged.orderBy(value.asc_nulls_last(), F.col(key).asc()).limit(per_page)


def row_at(paged: DataFrame, key: str, number: int) -> tuple[object, object] | None:
    """Sort value and key of the row so far down a list of ``write_paged`` (from 1), as a cursor for ``page_after``; None if it is shorter.

    Files are counted, and only the one that holds the row is read in order, so no more than a file's rows meet anywhere.
    """
    order = F.struct(F.col("sort_value").isNull().alias("last"), "sort_value", F.col(key).alias("key"))
    counts = paged.select(F.input_file_name().alias("file"), order.alias("at")).groupBy("file").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    for r in counts.orderBy("first").collect():
        if number <= r.n:
            own = paged.filter(F.input_file_name() == r.file).select("sort_value", key)
            found = own.orderBy(F.col("sort_value").asc_nulls_last(), F.col(key).asc()).offset(number - 1).limit(1).first()
            return found[0], found[1]
        number -= r.n
    return None


def total_of(df: DataFrame) -> DataFrame:
    """Number of rows over all pages."""
    return df.agg(F.count(F.lit(1)).alias("total"))


# --------------------------------------------------------------------------
# Figures
# --------------------------------------------------------------------------


def _one_row(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Conditional counts over several tables in one row: one pass per table, no join."""
    names = [n for _, flags in parts for n in flags]
    out = None
    for df, flags in parts:
        row = df.select(*[(flags[n].cast("int") if n in flags else F.lit(0)).alias(n) for n in names])
        out = row if out is None else out.unionByName(row)
    return out.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def dashboard_summary(domains: DataFrame, findings: DataFrame) -> DataFrame:
    """Totals and open counts.

    Ids are keys and every finding belongs to a domain, so rows of each table
    are counted instead of distinct ids of their join.
    """
    open_, severity = is_open(F.col("status")), F.col("severity")
    domain_flags = {"total_domains": F.lit(True), "active_domains": F.col("status") == "ACTIVE"}
    finding_flags = {
        "total_findings": F.lit(True),
        "open_critical": open_ & (severity == "CRITICAL"),
        "open_high": open_ & (severity == "HIGH"),
        "open_medium": open_ & (severity == "MEDIUM"),
        "resolved_findings": F.col("status") == "RESOLVED",
        "pending_remediation": F.col("status") == "DISCLOSED",
    }
    return _one_row([(domains, domain_flags), (findings, finding_flags)])


def disclosure_summary(domains: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    now = as_of_column(as_of)
    open_, critical = is_open(F.col("status")), F.col("severity") == "CRITICAL"
    waiting = F.col("disclosed_at").isNull() & open_
    soon = F.coalesce(
        F.col("disclosure_sla_due") <= plus_hours(now, F.lit(rules.DISCLOSURE_WINDOW_HOURS)), F.lit(False)
    )
    late = F.coalesce(F.col("disclosed_at") < plus_hours(now, F.lit(-rules.ESCALATION_WAIT_HOURS)), F.lit(False))
    flags = {
        "awaiting_disclosure": waiting & (critical | soon),
        "awaiting_critical": waiting & critical,
        "awaiting_sla": waiting & ~critical & soon,
        "escalation_pending": critical & (F.col("status") == "DISCLOSED") & F.col("acknowledged_at").isNull() & late,
        "disclosed_total": F.col("disclosed_at").isNotNull(),
        "acknowledged": F.col("acknowledged_at").isNotNull(),
    }
    domain_flags = {"no_contact_email": (F.col("status") == "ACTIVE") & F.col("contact_email").isNull()}
    return _one_row([(findings, flags), (domains, domain_flags)])


def findings_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n_findings"))


def findings_by_domain(findings: DataFrame) -> DataFrame:
    return findings.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n_findings"))


def findings_by_sector(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """Counted per domain first, so a domain with very many findings joins as one row."""
    per_domain = findings_by_domain(findings)
    sectors = domains.select("domain_id", "sector").filter(F.col("sector").isNotNull())
    return per_domain.join(sectors, "domain_id").groupBy("sector").agg(F.sum("n_findings").alias("n_findings"))


def recent_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc_nulls_first(), "job_id").limit(n)


def recent_jobs_per_domain(jobs: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` jobs of each domain; each task keeps its own best ``n`` before the shuffle."""
    w = Window.partitionBy("domain_id").orderBy(F.col("created_at").desc_nulls_first(), "job_id")
    return jobs.withColumn("job_rank", F.row_number().over(w)).filter(F.col("job_rank") <= n)


# --------------------------------------------------------------------------
# Lists
# --------------------------------------------------------------------------

# PostgreSQL null order: ascending last, descending first.
DOMAIN_SORTS = {
    "iocs_desc": lambda: F.col("iocs_score").desc_nulls_first(),
    "iocs_asc": lambda: F.col("iocs_score").asc_nulls_last(),
    "domain_asc": lambda: F.col("domain").asc_nulls_last(),
    "scanned_desc": lambda: F.col("last_scanned_at").desc_nulls_first(),
    "created_desc": lambda: F.col("created_at").desc_nulls_first(),
}
FINDING_SORTS = {
    "created_desc": lambda: F.col("created_at").desc_nulls_first(),
    "severity_desc": lambda: severity_rank(F.col("severity")).asc(),
    "confidence_desc": lambda: F.col("final_confidence").desc_nulls_first(),
    "sla_asc": lambda: F.col("disclosure_sla_due").asc_nulls_last(),
}


def list_domains(domains: DataFrame, findings: DataFrame, sort: str = "iocs_desc", page: int = 1, per_page: int = 25) -> DataFrame:
    """A page of (already filtered) domains with their finding counts.

    The page is cut first; only findings of its at most 100 domains are counted.
    """
    order = DOMAIN_SORTS.get(sort, DOMAIN_SORTS["iocs_desc"])()
    shown = page_of(domains, [order, F.col("domain_id")], page, per_page)
    few = F.broadcast(shown.select("domain_id"))  # at most MAX_PAGE rows
    counts = findings_by_domain(findings.select("domain_id").join(few, "domain_id", "left_semi"))
    counts = counts.withColumnRenamed("n_findings", "_n")
    return shown.join(counts, "domain_id", "left").select(
        *domains.columns, F.coalesce("_n", F.lit(0)).alias("findings_count")
    )


def list_findings(findings: DataFrame, domains: DataFrame, sort: str = "created_desc", page: int = 1, per_page: int = 25) -> DataFrame:
    """A page of (already filtered) findings with the domain name.

    Every finding belongs to a domain (its key is checked when it is saved and
    deletes cascade), so the page is cut first and only its rows are joined.
    """
    order = FINDING_SORTS.get(sort, FINDING_SORTS["created_desc"])()
    shown = page_of(findings, [order, F.col("finding_id")], page, per_page)
    names = domains.select("domain_id", F.col("domain").alias("domain_name"))
    few = F.broadcast(shown)  # at most MAX_PAGE rows
    return names.join(few, "domain_id").select(
        "finding_id", F.col("domain_name").alias("domain"), "domain_id", "url", "finding_type", "severity", "status",
        effective_confidence(F.col("final_confidence"), F.col("heuristic_confidence")).alias("confidence"),
        F.col("disclosure_sla_due").alias("sla_due"), "dark_web_confirmed", F.col("created_at").alias("detected_at"),
    )


def finding_detail(findings: DataFrame, domains: DataFrame, finding_id: object = None) -> DataFrame:
    """All ledger columns of one finding, or of all, with the domain name; the evidence is the masked one."""
    rows = findings if finding_id is None else findings.filter(F.col("finding_id") == F.lit(finding_id))
    return rows.join(domains.select("domain_id", "domain"), "domain_id")


def list_jobs(jobs: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    return page_of(jobs, [F.col("created_at").desc_nulls_first(), F.col("job_id")], page, per_page)


def list_audit(logs: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    return page_of(logs, [F.col("event_at").desc_nulls_first(), F.col("id")], page, per_page, MAX_AUDIT_PAGE)


def list_disclosures(events: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    return page_of(events, [F.col("created_at").desc_nulls_first(), F.col("event_id")], page, per_page)


# --------------------------------------------------------------------------
# Detail and overview
# --------------------------------------------------------------------------


def domain_findings(findings: DataFrame, domains: DataFrame, domain_id: object = None) -> DataFrame:
    """Findings per domain as rows, numbered most severe and newest first.

    Rows, not one nested list, because a domain may hold a large share of all
    findings; without a ``domain_id`` the numbering is left out for that reason.
    """
    named = domains.select("domain_id", "domain")
    rows = findings
    if domain_id is not None:
        named = named.filter(F.col("domain_id") == F.lit(domain_id))
        rows = findings.filter(F.col("domain_id") == F.lit(domain_id))
    return rows.join(named, "domain_id").select(
        "domain_id", "domain", "finding_id", "url", "finding_type", "severity",
        severity_rank(F.col("severity")).alias("severity_rank"), "status",
        effective_confidence(F.col("final_confidence"), F.col("heuristic_confidence")).alias("confidence"),
        "dark_web_confirmed", F.col("created_at").alias("detected_at"),
    )


def domain_overview(domains: DataFrame, findings: DataFrame, jobs: DataFrame, n_jobs: int = 10) -> DataFrame:
    """Per domain: severity counts and its last jobs (at most ``n_jobs``) as one nested list."""
    counts = findings.groupBy("domain_id").agg(
        F.count(F.lit(1)).alias("n_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")],
    )
    nested = (
        recent_jobs_per_domain(jobs, n_jobs).filter(F.col("domain_id").isNotNull()).groupBy("domain_id")
        .agg(F.array_sort(F.collect_list(F.struct("job_rank", "job_id", "status", "findings_count", "duration_ms"))).alias("recent_jobs"))
    )
    return domains.join(counts, "domain_id", "left").join(nested, "domain_id", "left").fillna(
        0, ["n_findings", "n_critical", "n_high", "n_medium", "n_low", "n_info"]
    )


def risk_overview(domains: DataFrame, top: int = 100) -> DataFrame:
    """Top ACTIVE domains by the risk score stored in their notes."""
    fields = ["risk_score", "open_critical", "open_high", "dark_web_hits", "sla_breached"]
    rows = domains.filter(F.col("status") == "ACTIVE").select(
        "domain_id", "domain", "sector", F.col("vendor_fingerprint").alias("vendor"), "iocs_score",
        *[note_int(F.col("notes"), f).alias(f) for f in fields],
        F.get_json_object("notes", "$.last_scored_at").alias("last_scored_at"),
    )
    return rows.orderBy(F.col("risk_score").desc(), "domain_id").limit(top)


def waiting_by_domain(findings: DataFrame, as_of: str) -> DataFrame:
    """Queue length per domain."""
    return disclosure_queue(findings, as_of).groupBy("domain_id").agg(F.count(F.lit(1)).alias("n_waiting"))
