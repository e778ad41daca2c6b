"""Consolidation of discovered names and of security contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import contact_emails
from tidewatch.rules import CONTACT_MAILBOXES


def consolidate(names: DataFrame) -> DataFrame:
    """Distinct ``(root, name)`` over all feeds."""
    return names.select("root", "name").distinct()


def resolving(names: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Names that resolve; a name with very many addresses is one key."""
    return names.join(resolutions.select("name").distinct(), "name", "left_semi")


def source_stats(names: DataFrame, by_root: bool = True) -> DataFrame:
    """Distinct names per source. Distinct runs on the full name first, so a
    source or root that holds most rows is counted by many tasks."""
    keys = ["root", "source"] if by_root else ["source"]
    return names.select("root", "source", "name").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_names"))


def candidate_names(words: DataFrame, roots: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``word.root`` names that resolve: ``(root, name)``.

    The word × root product is never formed. Each resolved name is split at
    every dot instead, and a split is kept if its left part is a word and its
    right part is a root.
    """
    parts = F.split("name", r"\.")
    at = F.explode(F.sequence(F.lit(1), F.size(parts) - 1))
    splits = (
        resolutions.select("name").distinct().filter(F.size(parts) > 1).select("name", parts.alias("p"), at.alias("i"))
    ).select(
        "name",
        F.array_join(F.slice("p", F.lit(1), F.col("i")), ".").alias("word"),
        F.array_join(F.slice("p", F.col("i") + 1, F.size("p")), ".").alias("root"),
    )
    return (
        splits.join(words.select("word").distinct(), "word", "left_semi")
        .join(roots.select("root").distinct(), "root", "left_semi")
        .select("root", "name")
    )


def security_contacts(domains: DataFrame, contact_files: DataFrame) -> DataFrame:
    """``(domain, email, source, candidates)`` per domain.

    E-mails of the first contact file that has any come first, then the
    conventional mailboxes.
    """
    emails = contact_emails(F.col("body"))
    parsed = contact_files.filter(F.col("status") == 200).select("domain", "priority", emails.alias("emails"))
    first = parsed.filter(F.size("emails") > 0).groupBy("domain").agg(F.min_by("emails", "priority").alias("emails"))
    usual = F.array(*[F.concat(F.lit(f"{m}@"), F.col("domain")) for m in CONTACT_MAILBOXES])
    found = F.coalesce(F.col("emails"), F.array().cast("array<string>"))
    return (
        domains.select("domain").join(first, "domain", "left")
        .select(
            "domain",
            F.array_distinct(F.concat(found, usual)).alias("candidates"),
            F.when(F.size(found) > 0, "security.txt").otherwise("convention").alias("source"),
        )
        .select("domain", F.get("candidates", F.lit(0)).alias("email"), "source", "candidates")
    )
