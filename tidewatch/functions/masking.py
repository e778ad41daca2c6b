"""Masking: no matched value leaves the engine in clear text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import MARK, contains_any, context_window, once, split_marked
from tidewatch.rules import CONTENT_RULES, MASK_OVERRIDES, OPTIONAL_CONTENT_RULES, ContentRule

# Longer and wider shapes first, so that a number inside them is not split.
_MASK_ORDER = (
    "PRIVATE_KEY_BLOCK",
    "GENERIC_SECRET_FIELD",
    "GENERIC_API_KEY",
    "STRIPE_LIVE_KEY",
    "AWS_ACCESS_KEY",
    "EMAIL",
    "UPI_ID",
    "ABHA_ID",
    "DRIVING_LICENSE",
    "CREDIT_CARD",
    "AADHAAR",
    "PAN",
    "VOTER_ID",
    "INDIAN_PASSPORT",
    "INDIAN_PHONE",
    "BANK_ACCOUNT",
)
# What stands in everything that the rule masks.
_MASK_LITERAL = {"PRIVATE_KEY_BLOCK": "-----BEGIN", "GENERIC_SECRET_FIELD": '"', "STRIPE_LIVE_KEY": "sk_live_", "AWS_ACCESS_KEY": "AKIA", "EMAIL": "@", "UPI_ID": "@"}
_ALL: dict[str, ContentRule] = {r.name: r for r in (*CONTENT_RULES, *OPTIONAL_CONTENT_RULES)}


def marker(rule_name: str) -> str:
    return f"[REDACTED {rule_name}]"


def mask_pattern(rule_name: str) -> str:
    return MASK_OVERRIDES.get(rule_name, _ALL[rule_name].pattern)


def mask(text: Column) -> Column:
    """Replace whatever any rule's pattern matches, checksum or not.

    Text without four digits of any script in a row and without any rule's literal has
    nothing to mask and is passed through. Local rules come last and are tried only on the
    parts of a text that have a digit or an @; the others only where their literal stands.
    """
    literals = list(dict.fromkeys(lit for r in _ALL.values() for lit in r.gate_contains))
    suspect = text.rlike(r"\p{Nd}{4}") | contains_any(text, literals) | text.rlike(r"(?i)key|token|secret")
    masked = text
    for name in (n for n in _MASK_ORDER if not _ALL[n].local):
        masked = _masked_where(masked, name)
    return F.when(suspect, F.array_join(F.transform(split_marked(masked), _masked_part), "")).otherwise(text)


def _masked_where(text: Column, name: str) -> Column:
    literal = _MASK_LITERAL.get(name)

    def replaced(t: Column) -> Column:
        return F.regexp_replace(t, mask_pattern(name), marker(name))

    return once(text, lambda t: F.when(F.contains(t, F.lit(literal)), replaced(t)).otherwise(t)) if literal else replaced(text)


def _masked_part(part: Column) -> Column:
    masked = part
    for name in (n for n in _MASK_ORDER if _ALL[n].local):
        masked = _masked_where(masked, name)
    return F.when(part.rlike(f"[{MARK}]"), masked).otherwise(part)


def display_url(url: Column) -> Column:
    """A url for people to read: without user and password, query and fragment as a marker, the rest masked.

    Keys and ids are made of the url as it is; only text that is shown or logged holds this form. Null stays null.
    """
    shown = F.regexp_replace(url, r"^([^/?#]*//)[^/?#]*@", "$1")
    return mask(F.regexp_replace(shown, r"(?s)[?#].+", "?[REDACTED QUERY]"))


def masked_context(masked: Column, rule_name: str, window: int = 250) -> Column:
    """Window of already masked text around a rule's first marker.

    The whole text is masked before it is cut, so a value on the window's edge
    cannot survive in part.
    """
    own = F.instr(masked, marker(rule_name))
    anywhere = F.instr(masked, "[REDACTED ")
    at = F.greatest(F.when(own > 0, own).otherwise(anywhere) - 1, F.lit(0))
    return context_window(masked, at, window)
