"""Passive-name feeds at rest: one parser per payload shape.

Every parser takes ``(source, root, payload)`` rows and returns
``(source, root, name)`` rows. A payload row is one response page, so a root
with very many names is spread over many rows and no row grows without bound.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import in_root, strip, strip_wildcard
from tidewatch.rules import FEEDS, SEED_NAMES

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _emit(feed: DataFrame, names: Column, check_root: bool = True) -> DataFrame:
    """Explode an array of raw names, normalise, keep those in the root."""
    rows = feed.select("source", "root", F.explode(names).alias("name"))
    rows = rows.filter(F.length("name") > 0)
    if check_root:
        rows = rows.filter(in_root(F.col("name"), F.col("root")))
    return rows


def _clean(names: Column) -> Column:
    return F.transform(names, lambda n: F.lower(strip(n)))


def _json(schema: str) -> Column:
    return F.from_json("payload", schema)


def ct_names(entries: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Distinct names of certificate entries: ``(name)``; ``max_entries`` takes the first ids."""
    if max_entries is not None:
        entries = entries.orderBy("entry_id").limit(max_entries)
    raw = entries.select(F.explode(F.split(F.lower("name_value"), "\n")).alias("name"))
    name = strip(strip_wildcard(strip(F.col("name"))))
    names = raw.select(name.alias("name"))
    return names.filter((F.length("name") > 3) & ~F.contains("name", F.lit(" "))).distinct()


# A payload's names by shape, as an array; columns ``payload`` and ``root``.


def _ct() -> Column:
    return F.transform(F.split(F.lower("payload"), "\n"), lambda n: strip_wildcard(strip(n)))


def _objects(schema: str, path: str, field: str) -> Column:
    items = _json(schema)
    for part in path.split("."):
        items = items[part]
    return _clean(F.transform(items, lambda o: o[field]))


def _nested() -> Column:
    hits = _json("result struct<hits:array<struct<`parsed.names`:array<string>>>>")["result"]["hits"]
    names = F.flatten(F.filter(F.transform(hits, lambda h: h["parsed.names"]), lambda a: a.isNotNull()))
    return F.transform(_clean(names), strip_wildcard)


def _plain(field: str) -> Column:
    return _clean(_json(f"{field} array<string>")[field])


def _labels() -> Column:
    return F.transform(_json("subdomains array<string>")["subdomains"], lambda x: F.lower(F.concat(x, F.lit("."), F.col("root"))))


def _csv_lines() -> Column:
    return _clean(F.transform(F.split("payload", _LINES), lambda x: F.get(F.split(x, ","), F.lit(0))))


def _csv_in_json() -> Column:
    return _clean(F.flatten(F.transform(_json("Results array<string>")["Results"], lambda r: F.split(r, ","))))


def _html_cells() -> Column:
    cells = F.regexp_extract_all("payload", F.lit(r"<td>([a-zA-Z0-9._-]+)</td>"), F.lit(1))
    return _clean(F.filter(cells, lambda n: F.endswith(n, F.concat(F.lit("."), F.col("root")))))


NAMES = {
    # newline-separated names of certificates
    "ct": _ct,
    # arrays of objects with a name field, e.g. passive_dns[].hostname
    "passive_dns": lambda: _objects("passive_dns array<struct<hostname:string>>", "passive_dns", "hostname"),
    "list_name": lambda: _objects("list array<struct<name:string>>", "list", "name"),
    "data_id": lambda: _objects("data array<struct<id:string>>", "data", "id"),
    "records_domain": lambda: _objects("result struct<records:array<struct<domain:string>>>", "result.records", "domain"),
    # arrays inside an array: result.hits[]["parsed.names"][]
    "nested_names": _nested,
    # arrays of plain names: subdomains[] or events[]
    "plain_names": lambda: _plain("subdomains"),
    "events": lambda: _plain("events"),
    # labels relative to the root, which need no suffix check
    "labels": _labels,
    # lines of host,ip
    "csv_lines": _csv_lines,
    # CSV strings inside Results[]; every field is tested
    "csv_in_json": _csv_in_json,
    # table cells of an HTML page that hold a name below the root
    "html_cells": _html_cells,
}
RELATIVE = ("labels",)


def feed_names(feed: DataFrame, shape: str) -> DataFrame:
    """``(source, root, name)`` of payloads that all have one shape."""
    return _emit(feed, NAMES[shape](), check_root=shape not in RELATIVE)


SHAPES = {shape: partial(feed_names, shape=shape) for shape in NAMES}


def feed_config(spark: SparkSession, configured: tuple[str, ...] = ()) -> DataFrame:
    """``(source, shape, needs_key, available)`` of every known feed; fixed size."""
    rows = [(name, shape, key, (not key) or name in configured) for name, shape, key in FEEDS]
    return spark.createDataFrame(rows, "source string, shape string, needs_key boolean, available boolean")


def available_feeds(feeds: DataFrame, config: DataFrame) -> DataFrame:
    """Rows of feeds that are configured. ``config`` is the small feed table."""
    return feeds.join(F.broadcast(config.filter("available").select("source")), "source", "left_semi")


def parse_feeds(feeds: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """All available feeds as ``(source, root, name)``.

    One pass over the payloads: a row's source says its shape, and only that shape's parser runs on it.
    """
    shape_of = {name: shape for name, shape, key in FEEDS if not key or name in configured}
    source, names = F.col("source"), None
    for shape, column in NAMES.items():
        sources = [n for n, s in shape_of.items() if s == shape]
        if sources:
            case = F.when if names is None else names.when
            names = case(source.isin(*sources), column())
    if names is None:
        return feeds.select("source", "root", F.lit(None).cast("string").alias("name")).limit(0)
    relative = [n for n, s in shape_of.items() if s in RELATIVE]
    rows = _emit(feeds.filter(source.isin(*shape_of)), names, check_root=False)
    return rows.filter(source.isin(*relative) | in_root(F.col("name"), F.col("root")))


def seed_fallback(spark: SparkSession, roots: DataFrame, tlds: tuple[str, ...]) -> DataFrame:
    """``(tld, name)`` roots, plus the seed names of the given TLDs that have none."""
    rows = [(t, n) for t in tlds for n in SEED_NAMES.get(t, ())]
    seeds = spark.createDataFrame(rows, "tld string, name string")
    missing = seeds.join(roots.select("tld").distinct(), "tld", "left_anti")
    return roots.select("tld", "name").unionByName(missing)
