"""Vendor correlation: one vendor's exposure raised on every domain that runs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.findings import new_findings
from tidewatch.schemas import is_open, severity_rank


def risky_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(
        F.col("vendor_fingerprint").isNotNull()
        & (F.col("vendor_fingerprint") != "")
        & F.col("severity").isin("CRITICAL", "HIGH")
        & is_open(F.col("status"))
    )


def with_domain_vendor(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """Findings without a vendor take their domain's."""
    vendors = domains.select("domain_id", F.col("vendor_fingerprint").alias("_v"))
    own = F.col("vendor_fingerprint") if "vendor_fingerprint" in findings.columns else F.lit(None).cast("string")
    kept = [c for c in findings.columns if c != "vendor_fingerprint"]
    return findings.join(vendors, "domain_id", "left").select(*kept, F.coalesce(own, "_v").alias("vendor_fingerprint"))


def vendor_representatives(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """Most severe risky finding per vendor: ``(vendor, severity, finding_type)``.

    A finding without a vendor takes its domain's. The best finding per domain
    is found first, so domains with very many findings join as one row.
    """
    own = F.col("vendor_fingerprint") if "vendor_fingerprint" in findings.columns else F.lit(None).cast("string")
    risky = findings.filter(F.col("severity").isin("CRITICAL", "HIGH") & is_open(F.col("status")))
    rows = risky.select("domain_id", own.alias("own"), "finding_id", "severity", "finding_type")
    order = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("finding_id").alias("id"))
    best = F.min(F.struct(order.alias("order"), F.col("severity"), F.col("finding_type"))).alias("b")
    vendors = domains.select("domain_id", "vendor_fingerprint")
    per_domain = rows.groupBy("domain_id", "own").agg(best).join(vendors, "domain_id", "left")
    vendor = F.coalesce("own", "vendor_fingerprint")
    per_vendor = per_domain.select(vendor.alias("vendor"), "b").filter(F.length("vendor") > 0)
    return per_vendor.groupBy("vendor").agg(F.min("b").alias("b")).select("vendor", "b.severity", "b.finding_type")


def match_vendors(vendors: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Pairs where a fingerprint contains the vendor's first word, ignoring case.

    ``vendors(vendor)`` against ``fingerprints(vendor_fingerprint)``. Substring
    search is turned into an equi-join: both sides meet on a gram of up to three
    characters that starts the word, and only those pairs are compared. Distinct
    words are compared, not vendors, so many versions of one vendor count once.
    """
    word = F.lower(F.get(F.split(F.trim("vendor"), r"\s+"), F.lit(0)))
    worded = vendors.select("vendor", word.alias("word")).filter(F.length("word") > 0)
    left = worded.select("word").distinct().withColumn("gram", F.substring("word", 1, 3))
    distinct = fingerprints.select("vendor_fingerprint").filter(F.col("vendor_fingerprint").isNotNull()).distinct()
    text = F.lower("vendor_fingerprint")
    starts = F.sequence(F.lit(1), F.length("vendor_fingerprint"))
    grams = F.array_distinct(
        F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(text, i, F.lit(n)) for n in (1, 2, 3)])))
    )
    right = distinct.filter(F.length("vendor_fingerprint") > 0).select("vendor_fingerprint", F.explode(grams).alias("gram"))
    met = left.join(right, "gram").filter(F.contains(F.lower("vendor_fingerprint"), F.col("word")))
    pairs = met.select("word", "vendor_fingerprint").distinct()
    return worded.distinct().join(pairs, "word").select("vendor", "vendor_fingerprint")


def correlate_vendors(domains: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    """New VENDOR_CORRELATION findings, one per ACTIVE domain and matching risky vendor."""
    templates = vendor_representatives(findings, domains)
    active = domains.filter(F.col("status") == "ACTIVE")
    pairs = match_vendors(templates.select("vendor"), active).join(templates, "vendor")
    affected = active.select("domain_id", "domain", "vendor_fingerprint").join(pairs, "vendor_fingerprint")
    raised = findings.filter(F.col("finding_type") == "VENDOR_CORRELATION")
    existing = with_domain_vendor(raised, domains).select(
        "domain_id", F.col("vendor_fingerprint").alias("vendor")
    )
    fresh = affected.join(existing, ["domain_id", "vendor"], "left_anti")
    text = F.concat(
        F.lit("[VENDOR CORRELATION] "), F.col("vendor"), F.lit(" runs on this domain. A "), F.col("severity"),
        F.lit(" "), F.col("finding_type"),
        F.lit(" was found on another domain with the same software. Check this domain for it."),
    )
    candidates = fresh.select(
        "domain_id",
        F.concat(F.lit("https://"), F.col("domain"), F.lit("/")).alias("url"),
        F.lit("/").alias("url_path"),
        F.lit("VENDOR_CORRELATION").alias("finding_type"),
        F.lit("OTHER").alias("entity_type"),
        F.lit("HIGH").alias("severity"),
        F.lit("0.750").alias("confidence"),
        text.alias("context_snippet_safe"),
        F.col("vendor").alias("vendor_fingerprint"),
    )
    rows = new_findings(candidates, as_of, detected_by="VENDOR_CORRELATION")
    key = F.concat_ws("|", F.col("domain_id").cast("string"), "url", "finding_type", "vendor_fingerprint")
    return rows.withColumn("finding_id", F.sha2(key, 256))


# Copies of the word index, which is small, so that one fingerprint of most domains is joined by as many tasks.
SALTS = 16


def first_word(vendor: str) -> Column:
    return F.lower(F.get(F.split(F.trim(F.col(vendor)), r"\s+"), F.lit(0)))


def vendor_words(templates: DataFrame) -> DataFrame:
    """A row for each first word of the risky vendors: its most severe vendor, as representative, and the number of vendors.

    ``templates`` has (vendor, severity, finding_type); with it, ``word`` is the membership of a word's vendors.
    """
    order = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("vendor").alias("name"))
    worded = templates.withColumn("word", first_word("vendor")).filter(F.length("word") > 0)
    best = F.min_by(F.struct("vendor", "severity", "finding_type"), order).alias("b")
    return worded.groupBy("word").agg(best, F.count("*").alias("vendors")).select("word", "b.*", "vendors")


def fingerprint_words(words: DataFrame, domains: DataFrame) -> DataFrame:
    """Inverted index of distinct fingerprints: (vendor_fingerprint, words), the risky words that each contains."""
    pairs = match_vendors(words.select(F.col("word").alias("vendor")), domains)
    return pairs.groupBy("vendor_fingerprint").agg(F.array_sort(F.collect_set("vendor")).alias("words"))


def correlate_vendor_words(domains: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    """New VENDOR_CORRELATION findings, one per ACTIVE domain and word, however many versions of the vendor are at risk.

    The compact form of ``correlate_vendors``: ``vendor_fingerprint`` names the most severe vendor with that first word,
    ``vendors`` says how many there are, and ``vendor_words`` with the templates lists them. A domain that has such
    a finding for any of them gets none. The join to domains is salted, so a bare name on most domains is not one task's.
    """
    words = vendor_words(vendor_representatives(findings, domains))
    active = domains.filter(F.col("status") == "ACTIVE")
    index = fingerprint_words(words, active).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = active.select("domain_id", "domain", "vendor_fingerprint", F.pmod(F.xxhash64("domain_id"), F.lit(SALTS)).cast("int").alias("salt"))
    met = salted.join(index, ["vendor_fingerprint", "salt"]).select("domain_id", "domain", F.explode("words").alias("word"))
    raised = with_domain_vendor(findings.filter(F.col("finding_type") == "VENDOR_CORRELATION"), domains)
    existing = raised.select("domain_id", first_word("vendor_fingerprint").alias("word")).distinct()
    fresh = met.join(existing, ["domain_id", "word"], "left_anti").join(words, "word")
    more = F.when(F.col("vendors") > 1, F.concat(F.lit(" and "), F.col("vendors") - 1, F.lit(" more with its name"))).otherwise("")
    text = F.concat(
        F.lit("[VENDOR CORRELATION] "), F.col("vendor"), more, F.lit(" at risk elsewhere. A "), F.col("severity"), F.lit(" "),
        F.col("finding_type"), F.lit(" was found on another domain with this software. Check this domain for it."),
    )
    candidates = fresh.select(
        "domain_id",
        F.concat(F.lit("https://"), F.col("domain"), F.lit("/")).alias("url"),
        F.lit("/").alias("url_path"),
        F.lit("VENDOR_CORRELATION").alias("finding_type"),
        F.lit("OTHER").alias("entity_type"),
        F.lit("HIGH").alias("severity"),
        F.lit("0.750").alias("confidence"),
        text.alias("context_snippet_safe"),
        F.col("vendor").alias("vendor_fingerprint"),
    )
    rows = new_findings(candidates, as_of, detected_by="VENDOR_CORRELATION").withColumn("vendor_word", first_word("vendor_fingerprint"))
    key = F.concat_ws("|", F.col("domain_id").cast("string"), "url", "finding_type", "vendor_word")
    counted = rows.join(words.select(F.col("word").alias("vendor_word"), "vendors"), "vendor_word")
    return counted.withColumn("finding_id", F.sha2(key, 256))
