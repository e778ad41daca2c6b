"""String, host, date and JSON scalars."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import rules


def strip(c: Column) -> Column:
    """Trim every kind of white space, not just the space character."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def strips_to(c: Column, least: int) -> Column:
    """Whether the stripped text has at least so many characters. Reads no further than these, as ``strip`` does to the end."""
    return c.rlike(rf"(?Us)\S.{{{least - 2},}}?\S" if least > 1 else r"(?U)\S")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with a costly value computed once for a row, however often and in whatever branches it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


# A digit of any script or an @, and stretches of text without one that end where white space is followed by something else.
MARK = r"\p{Nd}@"
_UNMARKED = rf"[^{MARK}]++\z|[^{MARK}]*\s(?=[^{MARK}])"
_MARKED = rf"(?:[^{MARK}\s]*+\s?+[{MARK}])++[^{MARK}\s]*+"


def split_marked(text: Column) -> Column:
    """The whole text in parts, in order, so that patterns that need a mark run on the few parts that have one.

    A part ends beside white space that no digit follows, so no match of a ``local`` rule reaches into two parts, and
    what such a match sees beyond its part's border is white space or nothing.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?U){_UNMARKED}|{_MARKED}"), F.lit(0))


def only_marked(text: Column) -> Column:
    """The parts of ``split_marked`` that have a mark, with a comma after each and for what stood between them."""
    return F.regexp_replace(text, rf"(?U)(?:{_UNMARKED})|({_MARKED})", "$1,")


def first_contained(text: Column, phrases: Iterable[str]) -> Column:
    """The first phrase, in list order, that occurs in the text; null if none does."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


# -- names and hosts -------------------------------------------------------


def normalise_domain(c: Column) -> Column:
    name = F.lower(strip(c))
    name = F.replace(F.replace(name, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.rtrim(name, F.lit("/"))


def strip_wildcard(c: Column) -> Column:
    return F.regexp_replace(c, r"^[*.]+", "")


def in_root(name: Column, root: Column) -> Column:
    """The name is the root itself or lies below it."""
    return (name == root) | F.endswith(name, F.concat(F.lit("."), root))


def in_tlds(name: Column, tlds: Iterable[str], strict: bool = True) -> Column:
    """Suffix test. ``strict`` respects label borders; otherwise the dot is ignored."""
    tests = []
    for tld in tlds:
        bare = tld.lstrip(".")
        tests.append(((name == bare) | name.endswith(tld)) if strict else name.endswith(bare))
    return reduce(lambda a, b: a | b, tests)


def tld_class(name: Column, extra: Iterable[str] = (), strict: bool = True) -> Column:
    """TLD of a name.

    ``strict`` takes the longest matching suffix; otherwise the first list
    entry the name ends with, dot ignored, which labels ``x.co.in`` as ``.in``.
    """
    tlds = [*rules.COUNTRY_TLDS, *extra]
    if strict:
        tlds = sorted(tlds, key=len, reverse=True)
    picks = [F.when(in_tlds(name, [t], strict), F.lit(t)) for t in tlds]
    return F.coalesce(*picks, F.lit(rules.DEFAULT_TLD))


def url_host(url: Column) -> Column:
    """Text after the last ``//`` up to ``/`` or ``:``, trailing dots off, lower case."""
    tail = F.substring_index(url, "//", -1)
    host = F.substring_index(F.substring_index(tail, "/", 1), ":", 1)
    return F.lower(F.rtrim(host, F.lit(".")))


def canonical_host(final_url: Column, stored: Column) -> Column:
    """The host a capture ended at if it is the stored host or its ``www.`` twin."""
    host = url_host(final_url)
    same_site = (
        (host == stored)
        | (host == F.concat(F.lit("www."), stored))
        | (host == F.replace(stored, F.lit("www."), F.lit("")))
    )
    return F.when(same_site, host).otherwise(stored)


def join_path(base: Column, path: Column) -> Column:
    """Absolute rule path on a base URL."""
    return F.concat(F.regexp_extract(base, r"^([a-z]+://[^/]*)", 1), path)


def is_government(name: Column, strict: bool = True) -> Column:
    return in_tlds(name, rules.GOVERNMENT_TLDS, strict)


# -- page text -------------------------------------------------------------

_MARKUP = (
    r"(?Uis)<style[^>]*>.*?</style>",
    r"(?Uis)<script[^>]*>.*?</script>",
    r"<[^>]+>",
)


def strip_noise(html: Column) -> Column:
    """Remove style blocks, script blocks, tags, decimal percentages and CSS units.

    Each step runs only where a character it needs is present, so prose without
    markup costs a substring search instead of three regular expressions.
    """
    text = html
    for pattern in _MARKUP:
        text = F.regexp_replace(text, pattern, " ")
    text = F.when(F.contains(html, F.lit("<")), text).otherwise(html)
    text = F.when(
        F.contains(html, F.lit("%")), F.regexp_replace(text, r"(?U)\d+\.\d+\s*%", " ")
    ).otherwise(text)
    return F.regexp_replace(text, r"(?U)\b\d+(?:px|rem|em|vh|vw|pt|cm|mm)\b", " ")


def header_text(headers: Column) -> Column:
    """``k: v`` pairs joined by single spaces, keys in order."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")


def content_hash(html: Column) -> Column:
    return F.when(F.length(html) > 0, F.sha2(html, 256))


def context_window(text: Column, position: Column, window: int) -> Column:
    """Text around a 0-based position, control characters dropped, stripped."""
    start = F.greatest(position - window, F.lit(0))
    stop = F.least(position + window, F.length(text))
    cut = F.substring(text, start + 1, stop - start)
    return strip(F.regexp_replace(cut, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ""))


# -- case ids, time, confidence -------------------------------------------


def case_id(domain: Column) -> Column:
    return F.upper(F.substring(F.sha2(domain, 256), 1, 12))


def sla_hours(severity: Column) -> Column:
    picks = [F.when(severity == s, F.lit(h)) for s, h in rules.SLA_HOURS.items()]
    return F.coalesce(*picks, F.lit(rules.SLA_HOURS_DEFAULT))


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours)


def plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def sla_due(created: Column, severity: Column) -> Column:
    return plus_hours(created, sla_hours(severity))


def next_scan_at(as_of: Column, sector: Column) -> Column:
    fast = F.coalesce(sector.isin(*rules.FAST_SCAN_SECTORS), F.lit(False))
    days = F.when(fast, F.lit(rules.NEXT_SCAN_DAYS_FAST)).otherwise(F.lit(rules.NEXT_SCAN_DAYS))
    return plus_days(as_of, days)


def effective_confidence(final: Column, heuristic: Column) -> Column:
    """Final if set and not zero, else heuristic, else 0."""
    zero = F.lit(0).cast("decimal(4,3)")
    return F.coalesce(F.nullif(final, zero), heuristic, zero)


# -- contacts --------------------------------------------------------------


def is_valid_email(c: Column) -> Column:
    return c.rlike(r"(?Ud)^[^@\s]+@[^@\s]+\.[^@\s]+\n?\z") & ~F.contains(c, F.lit("://"))


def contact_emails(body: Column) -> Column:
    """E-mail contacts of a security.txt body, in file order."""
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    contacts = F.filter(lines, lambda x: F.lower(x).startswith("contact:"))
    values = F.transform(contacts, lambda x: strip(F.substr(x, F.lit(9))))
    emails = F.transform(
        values,
        lambda v: F.when(F.lower(v).startswith("mailto:"), strip(F.substr(v, F.lit(8)))).otherwise(v),
    )
    return F.filter(emails, is_valid_email)


# -- search ----------------------------------------------------------------


def search(c: Column, term: str) -> Column:
    """Case-insensitive substring search; ``%`` and ``_`` keep their LIKE meaning."""
    return c.ilike(f"%{term}%")


# -- JSON notes ------------------------------------------------------------


def is_json(c: Column) -> Column:
    """The whole text is one JSON value.

    The readers stop after the first value and ignore what follows, so the text
    is read inside an array and inside an object: trailing text breaks at least
    one of the two.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.json_object_keys(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.coalesce((in_array == 1) & in_object.isNotNull(), F.lit(False))


def is_json_object(c: Column) -> Column:
    return is_json(c) & F.json_object_keys(c).isNotNull()


def merge_notes(notes: Column, update: Column) -> Column:
    """Merge a JSON object into notes; the update wins, unreadable notes count as empty.

    Values keep their JSON types: both sides are read as ``map<string,variant>``.
    """
    old = _json_object(notes)
    new = _json_object(update)
    kept = F.map_filter(old, lambda k, _v: ~F.map_contains_key(new, k))
    return F.to_json(F.map_concat(kept, new))


def _json_object(text: Column) -> Column:
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    return F.coalesce(F.when(is_json_object(text), F.from_json(text, "map<string,variant>")), empty)


def note_int(notes: Column, field: str) -> Column:
    """Integer field of the notes JSON, 0 where missing or unreadable."""
    return F.coalesce(F.get_json_object(notes, f"$.{field}").try_cast("int"), F.lit(0))


# -- finding lines ---------------------------------------------------------


def short_path(path: Column) -> Column:
    shown = F.when(F.length(path) > 0, path).otherwise(F.lit("/"))
    return F.when(F.length(shown) > 80, F.concat(F.substring(shown, 1, 77), F.lit("..."))).otherwise(shown)


def finding_line(number: Column, severity: Column, finding_type: Column, path: Column, confidence: Column) -> Column:
    percent = F.bround(confidence * 100, 0).cast("int").cast("string")
    return F.concat(
        F.lit("  "), number.cast("string"), F.lit(". ["), severity, F.lit("] "), finding_type,
        F.lit(" @ "), short_path(path), F.lit(" (confidence="), percent, F.lit("%)"),
    )


def sla_summary(overdue: Column) -> Column:
    text = F.concat(F.lit("BREACHED ("), overdue.cast("string"), F.lit(" overdue)"))
    return F.when(overdue > 0, text).otherwise(F.lit("Within SLA"))
