"""Corpus refresh: names at rest → scored, fingerprinted, gated inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.functions.text import in_tlds, tld_class
from tidewatch.operators.corpus import (
    first_sector,
    origin_score,
    page_features,
    passes_gate,
    sector_hits,
    upsert_domains,
)
from tidewatch.operators.findings import audit_run
from tidewatch.operators.names import resolving
from tidewatch.sources.captures import best_capture, home_captures
from tidewatch.sources.lookups import home_asn, resolve


def limit_roots(roots: DataFrame, per_tld: int | None = None) -> DataFrame:
    """First ``per_tld`` root names of each TLD, alphabetically; all if not given."""
    if per_tld is None:
        return roots
    order = Window.partitionBy("tld").orderBy("name")
    return roots.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_tld).drop("_rn")


def score_names(
    names: DataFrame,
    resolutions: DataFrame,
    ip_geo: DataFrame,
    captures: DataFrame,
    *,
    discovered_via: str = "CT_LOG",
    gate: bool = True,
    assume_home_for_country_tld: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Score every distinct name and say what becomes of it in ``outcome``.

    ``outcome`` is skipped_dns, skipped_iocs or candidate. Names below a country
    TLD count as located at home without a look-up unless told otherwise. Page
    text of home pages, and of no other captures, is reduced to features before
    anything is shuffled.
    """
    distinct = names.select(F.col("name").alias("domain")).distinct()
    placed = home_asn(resolve(distinct, resolutions, "domain"), ip_geo)
    if assume_home_for_country_tld:
        at_home = in_tlds(F.col("domain"), rules.COUNTRY_TLDS, strict)
        placed = placed.withColumn("asn", F.when(at_home, F.lit("")).otherwise(F.col("asn")))
    pages = best_capture(page_features(home_captures(captures))).select("domain", "content", "page_sectors", "content_hash", "vendor")
    scored = origin_score(placed.join(pages, "domain", "left"), "domain", F.col("content"), "asn", strict)
    keeps = passes_gate(F.col("iocs_score"), F.col("signal_count")) if gate else F.lit(True)
    dead = F.col("ip").isNull() if gate else F.lit(False)
    return scored.select(
        "domain",
        tld_class(F.col("domain"), rules.OTHER_TLDS, strict).alias("tld"),
        F.col("ip").alias("ip_address"),
        "iocs_score",
        "signal_count",
        "signal_detail",
        F.col("vendor").alias("vendor_fingerprint"),
        F.col("content_hash").alias("baseline_hash"),
        first_sector(sector_hits(F.lower("domain"), host=True), F.col("page_sectors")).alias("sector"),
        F.lit(discovered_via).alias("discovered_via"),
        F.when(dead, "skipped_dns").when(~keeps, "skipped_iocs").otherwise("candidate").alias("outcome"),
    )


def refresh(scored: DataFrame, existing: DataFrame, as_of: str) -> DataFrame:
    """New inventory snapshot with an ``action`` per domain."""
    return upsert_domains(existing, scored.filter(F.col("outcome") == "candidate"), as_of)


def refresh_counters(scored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``(outcome, n)``: new, updated, unchanged, skipped_iocs, skipped_dns.

    Uses ``scored`` twice; hand over a written table, so that the page text is
    read and matched once.
    """
    label = F.when(F.col("action") == "created", "new").otherwise(F.col("action"))
    done = snapshot.filter(F.col("action") != "kept").select(label.alias("outcome"))
    skipped = scored.filter(F.col("outcome") != "candidate").select("outcome")
    return done.unionByName(skipped).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def audit_refresh(counters: DataFrame, as_of: str, scope: str = "all") -> DataFrame:
    return audit_run(counters, "CORPUS_REFRESH_COMPLETED", as_of, name="outcome", scope=scope)


def audit_enumeration(stats: DataFrame, as_of: str, scope: str = "all") -> DataFrame:
    """``stats`` is ``(source, n_names)`` over the ingested roots."""
    return audit_run(stats, "SUBDOMAIN_ENUM_COMPLETED", as_of, name="source", value="n_names", scope=scope)


def add_domains(
    names: DataFrame, existing: DataFrame, resolutions: DataFrame, ip_geo: DataFrame, captures: DataFrame, as_of: str
) -> DataFrame:
    """Manual additions: scored like a refresh, but neither gate nor resolution is required."""
    scored = score_names(
        names, resolutions, ip_geo, captures, discovered_via="MANUAL", gate=False, assume_home_for_country_tld=False
    )
    return refresh(scored, existing, as_of)


def ingest_names(
    names: DataFrame, existing: DataFrame, resolutions: DataFrame, ip_geo: DataFrame, captures: DataFrame, as_of: str
) -> DataFrame:
    """On-demand ingest of consolidated, resolving names of a root, without the gate."""
    live = resolving(names, resolutions)
    scored = score_names(live, resolutions, ip_geo, captures, discovered_via="SUBDOMAIN_ENUM", gate=False)
    return refresh(scored, existing, as_of)
