"""Domain scoring, fingerprinting, sector inference, change detection and upsert."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.functions.text import content_hash, contains_any, header_text, in_tlds
from tidewatch.session import as_of_column, handover, spread
from tidewatch.sources.buckets import BucketTable

# --------------------------------------------------------------------------
# Country-origin score
# --------------------------------------------------------------------------


def content_signals(html: Column) -> Column:
    """Struct of the signals a page's text gives; all false for a missing page."""
    found = {n: html.rlike(pattern) for n, pattern in rules.ORIGIN_PATTERNS.items()}
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in found.items()])


def origin_score(df: DataFrame, domain: str, content: Column, asn: str, strict: bool = True) -> DataFrame:
    """Add ``iocs_score`` (0..100), ``signal_count`` and ``signal_detail`` (map of points).

    ``content`` is the struct of ``content_signals``, null without a page;
    ``asn`` is null unless geography says home.
    """
    name, net = F.col(domain), F.col(asn)
    if strict:
        known = F.substring_index(net, " ", 1).isin(*rules.HOME_ASNS)
    else:
        known = reduce(lambda a, b: a | b, [net.startswith(a) for a in rules.HOME_ASNS])
    placed = {
        "tld": in_tlds(name, rules.COUNTRY_TLDS, strict),
        "pilot_tld_bonus": in_tlds(name, rules.PILOT_TLDS, strict),
        "ip_geo_india": net.isNotNull(),
        "indian_asn": known,
    }
    staged = df.select(
        "*",
        content.alias("_content"),
        F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in placed.items()]).alias("_placed"),
    )
    hit = {
        n: F.coalesce(F.col(f"{'_placed' if n in placed else '_content'}.{n}"), F.lit(False)) for n in rules.ORIGIN_POINTS
    }
    points = {n: F.when(hit[n], F.lit(p)).otherwise(F.lit(0)) for n, p in rules.ORIGIN_POINTS.items()}
    counted = [c.cast("int") for n, c in hit.items() if n != "pilot_tld_bonus"]
    detail = F.map_from_arrays(F.array(*[F.lit(n) for n in points]), F.array(*points.values()))
    return staged.select(
        *df.columns,
        F.least(reduce(lambda a, b: a + b, points.values()), F.lit(100)).alias("iocs_score"),
        reduce(lambda a, b: a + b, counted).alias("signal_count"),
        F.map_filter(detail, lambda _k, v: v > 0).alias("signal_detail"),
    )


def passes_gate(score: Column, signals: Column) -> Column:
    return (score >= rules.SCORE_THRESHOLD) & (signals >= rules.MIN_SIGNALS)


# --------------------------------------------------------------------------
# Vendor fingerprint
# --------------------------------------------------------------------------

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def _signal(pattern: str, text: Column, lowered: Column) -> Column:
    """A signal test; patterns that are plain literals become substring searches."""
    bare = pattern.removeprefix("(?i)")
    literal = bare.replace(r"\.", "")
    if _META.search(literal):
        return text.rlike(pattern)
    plain = bare.replace(r"\.", ".")
    if bare != pattern:
        return F.contains(lowered, F.lit(plain.lower()))
    return F.contains(text, F.lit(plain))


def fingerprint(df: DataFrame, html: str, headers: Column | None = None) -> DataFrame:
    """Add ``vendor`` (with version), ``vendor_name``, ``vendor_version``, ``vendor_risk``, ``vendor_signals``.

    First signature in list order with enough signals wins; null where none does
    or the page is empty.
    """
    page = F.when(F.length(html) > 0, F.col(html))
    combined = page if headers is None else F.concat(page, F.lit("\n"), F.coalesce(header_text(headers), F.lit("")))
    staged = df.withColumn("_page", combined).withColumn("_lower", F.lower("_page"))
    text, lowered = F.col("_page"), F.col("_lower")
    table = rules.VENDOR_SIGNATURES
    counts = []
    for sig in table:
        count = reduce(lambda a, b: a + b, [_signal(p, text, lowered).cast("int") for p in sig.signals])
        counts.append(F.when(contains_any(lowered, sig.gates), count).otherwise(F.lit(0)))
    # Signals are counted once, as an array; the rest works on its position.
    counted = staged.withColumn("_n", F.array(*counts))
    least = F.array(*[F.lit(sig.min_signals) for sig in table])
    enough = F.zip_with("_n", least, lambda n, m: n >= m)
    placed = counted.withColumn("_i", F.array_position(enough, F.lit(True)).cast("int"))
    at = F.col("_i")
    version = F.coalesce(
        *[
            F.when(at == i, F.nullif(F.regexp_extract(text, sig.version, 1), F.lit("")))
            for i, sig in enumerate(table, 1)
            if sig.version
        ]
    )
    name = F.element_at(F.array(*[F.lit(sig.vendor) for sig in table]), at)
    found = F.struct(
        F.concat_ws(" ", name, version).alias("vendor"),
        name.alias("vendor_name"),
        version.alias("vendor_version"),
        F.element_at(F.array(*[F.lit(sig.risk) for sig in table]), at).alias("vendor_risk"),
        F.element_at("_n", at).alias("vendor_signals"),
    )
    # Exploding one struct per row keeps a later filter on these columns from
    # being pushed below and matching every signal a second time.
    empty = F.lit(None).cast(
        "struct<vendor:string,vendor_name:string,vendor_version:string,vendor_risk:string,vendor_signals:int>"
    )
    one = F.explode(F.array(F.when(at > 0, found).otherwise(empty))).alias("_f")
    return placed.select(*df.columns, one).select(*df.columns, "_f.*")


# --------------------------------------------------------------------------
# Sector
# --------------------------------------------------------------------------


def _bordered(words: Sequence[str]) -> str:
    """Pattern for dotted keywords with borders: no letter or digit before them, nor after those that don't end in a dot."""
    ends = [re.escape(w) + ("" if w.endswith(".") else "([^a-z0-9]|$)") for w in words]
    return "(^|[^a-z0-9])(" + "|".join(ends) + ")"


def sector_patterns(words: Sequence[str]) -> tuple[list[str], str | None, str | None]:
    """A sector's plain words, the pattern of its dotted keywords and that of words that compound labels begin or end with."""
    plain, dotted = [w for w in words if "." not in w], [w for w in words if "." in w]
    parts = "|".join(w for w in plain if w in rules.COMPOUND_SECTOR_WORDS)
    return plain, _bordered(dotted) if dotted else None, f"(^|[^a-z0-9])({parts})|({parts})([^a-z0-9]|$)" if parts else None


def sector_hits(text: Column, host: bool = False, strict: bool = True) -> Column:
    """Which sectors have a keyword in the text, as an array in sector order.

    A keyword is a whole word of the text, or part of a host between dots and dashes; a dotted one stands between borders.
    In a ``host``, some words also begin or end a compound label (``citybank``). The text becomes a set of words once.
    With ``strict=False`` a keyword counts anywhere, also inside other words.
    """
    if not strict:
        found = [F.coalesce(contains_any(text, words), F.lit(False)) for words in rules.SECTOR_KEYWORDS.values()]
        return F.array(*found)
    lowered = F.lower(text)
    tokens = F.array_distinct(F.split(lowered, "[^a-z0-9]+"))
    found = []
    for words in rules.SECTOR_KEYWORDS.values():
        plain, dotted, compound = sector_patterns(words)
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in plain]))
        if dotted:
            hit = hit | lowered.rlike(dotted)
        if host and compound:
            hit = hit | lowered.rlike(compound)
        found.append(F.coalesce(hit, F.lit(False)))
    return F.array(*found)


def first_sector(*hits: Column) -> Column:
    """First sector that any of the hit arrays names."""
    picks = []
    for i, sector in enumerate(rules.SECTOR_KEYWORDS):
        named = reduce(lambda a, b: a | b, [F.coalesce(F.get(h, F.lit(i)), F.lit(False)) for h in hits])
        picks.append(F.when(named, F.lit(sector)))
    return F.coalesce(*picks, F.lit(rules.DEFAULT_SECTOR))


def infer_sector(domain: Column, html: Column | None = None, head_chars: int | None = None, strict: bool = True) -> Column:
    """First sector with a keyword in the lower-cased name or the page (see ``sector_hits`` for ``strict``).

    The whole page is searched; ``head_chars`` restricts it to the page's head.
    """
    hits = [sector_hits(F.lower(domain), host=True, strict=strict)]
    if html is not None:
        page = html if head_chars is None else F.substring(html, 1, head_chars)
        hits.append(sector_hits(F.coalesce(page, F.lit("")), strict=strict))
    return first_sector(*hits)


# --------------------------------------------------------------------------
# Page features
# --------------------------------------------------------------------------


def page_features(captures: DataFrame) -> DataFrame:
    """Everything the corpus needs of a capture's text, without the text.

    Computed where the capture is read, so that only small rows are shuffled
    when captures are ranked and joined.
    """
    rows = fingerprint(spread(captures, "url"), "body", F.col("headers"))
    return rows.select(
        "domain", "url", "path", "scheme", "status", "fetched_at",
        content_signals(F.col("body")).alias("content"),
        sector_hits(F.col("body")).alias("page_sectors"),
        content_hash(F.col("body")).alias("content_hash"),
        "vendor",
    )


# --------------------------------------------------------------------------
# Change detection and re-fingerprint
# --------------------------------------------------------------------------


def content_changed(old_hash: Column, new_hash: Column) -> Column:
    return old_hash.isNotNull() & ~old_hash.eqNullSafe(new_hash)


def due_for_fingerprint(domains: DataFrame, force: bool = False) -> DataFrame:
    """ACTIVE domains without a vendor, or every ACTIVE domain if forced."""
    active = domains.filter(F.col("status") == "ACTIVE")
    return active if force else active.filter(F.col("vendor_fingerprint").isNull())


def refingerprint(domains: DataFrame, pages: DataFrame, as_of: str) -> DataFrame:
    """New vendor and hash per captured domain; the old vendor stays where none is found.

    ``pages`` is one ``(domain, html, headers)`` row per domain.
    """
    fresh = fingerprint(pages, "html", F.col("headers")).select(
        "domain", F.col("vendor").alias("_vendor"), content_hash(F.col("html")).alias("_hash"), F.lit(True).alias("_hit")
    )
    joined = domains.join(fresh, "domain", "left")
    hit = F.col("_hit").isNotNull()
    before = F.col("updated_at") if "updated_at" in domains.columns else F.lit(None).cast("timestamp")
    return joined.select(
        *[c for c in domains.columns if c not in ("vendor_fingerprint", "baseline_hash", "updated_at")],
        F.coalesce("_vendor", "vendor_fingerprint").alias("vendor_fingerprint"),
        F.when(hit, F.col("_hash")).otherwise(F.col("baseline_hash")).alias("baseline_hash"),
        (hit & content_changed(F.col("baseline_hash"), F.col("_hash"))).alias("content_changed"),
        F.when(hit, as_of_column(as_of)).otherwise(before).alias("updated_at"),
    )


# --------------------------------------------------------------------------
# Upsert
# --------------------------------------------------------------------------

UPSERT_COLUMNS = (
    "domain", "tld", "iocs_score", "status", "ip_address", "discovered_via", "sector",
    "vendor_fingerprint", "baseline_hash",
)


def upsert_domains(existing: DataFrame, incoming: DataFrame, as_of: str | Column) -> DataFrame:
    """Merge scored domains into the inventory, whose columns all stay; adds ``action``.

    Existing: ip only if missing, score only if higher, vendor and hash if given
    and different, PENDING becomes ACTIVE at the threshold. New: ACTIVE at the
    threshold else PENDING. ``action`` is created / updated / unchanged, or
    kept for rows the batch does not name. The result is a full snapshot. A new
    row gets an id made from its name, is due at once, and has null in columns
    that nothing is known of; ``updated_at`` changes only with created and updated.
    """
    candidate = F.struct(*[c for c in UPSERT_COLUMNS if c not in ("status", "domain")])
    best = incoming.groupBy("domain").agg(
        F.max_by(candidate, F.struct("iocs_score", F.coalesce("baseline_hash", F.lit("")))).alias("n")
    )
    old = existing.select(F.col("domain"), F.struct(*[c for c in existing.columns if c != "domain"]).alias("o"))
    both = old.join(best, "domain", "full_outer")
    is_new, is_named = F.col("o").isNull(), F.col("n").isNotNull()

    ip = F.coalesce(F.nullif("o.ip_address", F.lit("")), F.col("n.ip_address"))
    score = F.greatest(F.coalesce("o.iocs_score", F.lit(0)), F.col("n.iocs_score"))
    vendor = F.coalesce("n.vendor_fingerprint", "o.vendor_fingerprint")
    digest = F.coalesce("n.baseline_hash", "o.baseline_hash")
    qualifies = F.col("n.iocs_score") >= rules.SCORE_THRESHOLD
    status = (
        F.when(is_new, F.when(qualifies, "ACTIVE").otherwise("PENDING"))
        .when((F.col("o.status") == "PENDING") & qualifies, "ACTIVE")
        .otherwise(F.col("o.status"))
    )
    same = reduce(
        lambda a, b: a & b,
        [
            ip.eqNullSafe(F.col("o.ip_address")),
            score.eqNullSafe(F.coalesce("o.iocs_score", F.lit(0))),
            vendor.eqNullSafe(F.col("o.vendor_fingerprint")),
            digest.eqNullSafe(F.col("o.baseline_hash")),
            status.eqNullSafe(F.col("o.status")),
        ],
    )
    action = (
        F.when(~is_named, F.lit("kept"))
        .when(is_new, F.lit("created"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    now = as_of_column(as_of)
    text_key = dict(existing.dtypes).get("domain_id") == "string"
    created = {
        "tld": F.col("n.tld"),
        "discovered_via": F.col("n.discovered_via"),
        "sector": F.col("n.sector"),
        "domain_id": F.sha2("domain", 256) if text_key else F.xxhash64("domain"),
        "signal_whois_in": in_tlds(F.col("domain"), rules.COUNTRY_TLDS),
        "scan_count": F.lit(0),
        "next_scan_due_at": now,
        "created_at": now,
    }
    merged = {
        "iocs_score": F.when(is_named, score).otherwise(F.col("o.iocs_score")),
        "status": status,
        "ip_address": F.when(is_named, ip).otherwise(F.col("o.ip_address")),
        "vendor_fingerprint": vendor,
        "baseline_hash": digest,
        "updated_at": F.when(is_new | (is_named & ~same), now).otherwise(F.col("o.updated_at"))
        if "updated_at" in existing.columns
        else None,
    }

    def value(name: str, kind: str) -> Column:
        if name == "domain":
            return F.col("domain")
        if name in merged:
            return merged[name].cast(kind).alias(name)
        kept = F.col(f"o.{name}")
        return (F.when(is_new, created[name].cast(kind)).otherwise(kept) if name in created else kept).alias(name)

    return both.select(*[value(n, kind) for n, kind in existing.dtypes], action.alias("action"))


def upsert_buckets(table: BucketTable, version: int, incoming: DataFrame, as_of: str | Column) -> tuple[int, DataFrame]:
    """``upsert_domains`` on an inventory in hash buckets of ``domain``: ``(new version, merged rows of the buckets read)``.

    Buckets that the batch does not name are neither read nor written; of those it names, only those with a created or
    updated row are written.
    """
    batch = handover(incoming, "bucket-incoming")
    named = table.read(batch.sparkSession, version, table.touched(batch))
    merged = handover(upsert_domains(named, batch, as_of), "bucket-merged")
    changed = table.touched(merged.filter(F.col("action").isin("created", "updated")))
    return table.rewrite(merged, version, changed), merged


def delete_domains(
    domains: DataFrame, findings: DataFrame, jobs: DataFrame, disclosures: DataFrame, doomed: DataFrame
) -> dict[str, DataFrame]:
    """Remove domains with their findings and disclosures; jobs stay with a null domain.

    ``doomed`` is a ``(domain_id)`` table.
    """
    doomed = doomed.select("domain_id").distinct()
    gone = findings.join(doomed, "domain_id", "left_semi").select("finding_id").distinct()
    marked = jobs.join(doomed.withColumn("_gone", F.lit(True)), "domain_id", "left")
    return {
        "domains": domains.join(doomed, "domain_id", "left_anti"),
        "findings": findings.join(doomed, "domain_id", "left_anti"),
        "scan_jobs": marked.select(
            *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "domain_id" else F.col(c) for c in jobs.columns]
        ),
        "disclosure_events": disclosures.join(gone, "finding_id", "left_anti"),
    }
