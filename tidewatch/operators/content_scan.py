"""Personal-data and secret detection over text, in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.checks import CHECKS, ascii_digits, hash_value, strip_separators
from tidewatch.functions.masking import display_url, mask, masked_context
from tidewatch.functions.text import contains_any, only_marked, strip, strip_noise
from tidewatch.rules import CONTENT_RULES, OPTIONAL_CONTENT_RULES, ContentRule
from tidewatch.schemas import CONFIDENCE
from tidewatch.session import spread

DEFAULT_RULES = CONTENT_RULES
ALL_RULES = (*CONTENT_RULES, *OPTIONAL_CONTENT_RULES)

def select_rules(*names: str) -> tuple[ContentRule, ...]:
    return tuple(r for r in ALL_RULES if r.name in names)


def _gate(raw: Column, rule: ContentRule) -> Column:
    """Cheap necessary condition on the text, cleaned or not."""
    if rule.gate_contains:
        return contains_any(raw, rule.gate_contains)
    return raw.rlike(rule.gate_rlike)


def _row_gate(raw: Column, rules: Sequence[ContentRule]) -> Column:
    """Condition that every rule's gate implies: four digits of any script in a row or a literal."""
    literals = list(dict.fromkeys(lit for r in rules for lit in r.gate_contains))
    gate = F.lit(False)
    if any(r.gate_rlike for r in rules):
        gate = gate | raw.rlike(r"\p{Nd}{4}")
    return gate | contains_any(raw, literals) if literals else gate


def _normalised(value: Column, rule: ContentRule) -> Column:
    return ascii_digits(strip_separators(value)) if rule.digits else strip(value)


def _matches(clean: Column, rule: ContentRule) -> Column:
    found = F.regexp_extract_all(clean, F.lit(rule.pattern), F.lit(rule.value_group))
    found = F.transform(found, lambda v: _normalised(v, rule))
    if rule.check:
        found = F.filter(found, CHECKS[rule.check])
    return found


def rule_matches(
    df: DataFrame, text: str, rules: Sequence[ContentRule] = DEFAULT_RULES, *, key: str
) -> DataFrame:
    """Add one array column ``m_<rule>`` per rule: normalised values that passed its check.

    Rows that pass no gate are not cleaned. Local rules are tried on the cleaned
    text's parts with a digit or an @ only. Cleaning, cutting and matching are separate
    projections, so each text is computed once. There is deliberately no
    filter here: it would be pushed below the projections (every pattern
    evaluated twice) and below ``spread`` (gates evaluated in one task).
    """
    df = spread(df, key)
    raw = F.col(text)
    cleaned = df.withColumn("clean_text", F.when(_row_gate(raw, rules), strip_noise(raw)))
    none = F.array().cast("array<string>")
    clean, marked = F.col("clean_text"), F.col("_marked_text")
    cut = cleaned.withColumn("_marked_text", only_marked(clean))

    def found(r: ContentRule) -> Column:
        gate = _gate(marked if r.local else raw, r)
        return F.when(clean.isNotNull() & gate, _matches(marked if r.local else clean, r)).otherwise(none)

    return cut.select(*df.columns, "clean_text", *[found(r).alias(f"m_{r.name}") for r in rules])


def scan_content(
    df: DataFrame,
    text: str,
    *,
    key: str,
    salt: str,
    rules: Sequence[ContentRule] = DEFAULT_RULES,
    with_context: bool = False,
    window: int = 250,
) -> DataFrame:
    """One row per (row, rule) that holds.

    Patterns run on cleaned text, keywords on the whole lower-cased text. A rule
    holds with its keyword or enough occurrences; a rule that requires its
    keyword needs it. Output keeps the other input columns, never the text.
    """
    keep = [c for c in df.columns if c != text]
    matched = rule_matches(df, text, rules, key=key)
    any_match = reduce(lambda a, b: a | b, [F.size(f"m_{r.name}") > 0 for r in rules])
    extra = [F.when(any_match, F.lower(F.col(text))).alias("lower_text")]
    if with_context:
        extra.append(F.when(any_match, mask(F.col("clean_text"))).alias("masked_text"))
    staged = matched.select(*keep, *[f"m_{r.name}" for r in rules], *extra)

    hits = []
    for r in rules:
        values = F.col(f"m_{r.name}")
        found = F.size(values) > 0
        has_kw = contains_any(F.col("lower_text"), r.keywords) if r.keywords else F.lit(False)
        fields = [
            F.lit(r.name).alias("rule"),
            F.lit(r.entity).alias("entity_type"),
            F.lit(r.severity).alias("severity"),
            F.size(values).alias("value_count_estimate"),
            (found & has_kw).alias("has_keyword"),
            F.get(values, F.lit(0)).alias("first_value"),
            F.lit(r.min_occurrences).alias("min_occurrences"),
            F.lit(r.require_keyword).alias("require_keyword"),
        ]
        if with_context:
            fields.append(F.when(found, masked_context(F.col("masked_text"), r.name, window)).alias("context"))
        hits.append(F.when(found, F.struct(*fields)))

    def holds(hit: Column) -> Column:
        enough = ~hit["require_keyword"] & (hit["value_count_estimate"] >= hit["min_occurrences"])
        return hit.isNotNull() & (hit["has_keyword"] | enough)

    exploded = staged.select(*keep, F.explode(F.filter(F.array(*hits), holds)).alias("hit"))
    confidence = F.when(F.col("hit.has_keyword"), F.lit("0.80")).otherwise(F.lit("0.60")).cast(CONFIDENCE)
    return exploded.select(
        *keep,
        "hit.rule",
        F.concat(F.col("hit.rule"), F.lit("_IN_CONTENT")).alias("finding_type"),
        "hit.entity_type",
        "hit.severity",
        "hit.value_count_estimate",
        "hit.has_keyword",
        confidence.alias("confidence"),
        hash_value(F.col("hit.first_value"), salt).alias("value_hash"),
        *(["hit.context"] if with_context else []),
    )


def evidence_card(hits: DataFrame, url: str = "url") -> DataFrame:
    """Add the evidence text of a content finding; needs ``with_context=True`` hits. The url is shown without its secrets."""
    card = F.struct(
        "finding_type", display_url(F.col(url)).alias("url"), F.col("value_count_estimate").alias("found"),
        F.col("has_keyword").alias("keyword_near"), "confidence", F.col("context").alias("masked_context"),
    )
    return hits.withColumn("context_snippet_safe", F.to_json(card)).drop("context")


def scan_summary(captures: DataFrame, hits: DataFrame, by: str, rules_checked: int) -> DataFrame:
    """Per domain: URLs checked (path rules plus the home page) and new findings."""
    per = hits.groupBy(by).agg(F.count(F.lit(1)).alias("findings_count"))
    return (
        captures.select(by).distinct().join(per, by, "left")
        .select(
            by,
            F.lit(rules_checked + 1).alias("urls_checked"),
            F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
        )
    )
