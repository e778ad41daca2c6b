"""Histogram sort: shards of near equal bytes, with DataFrame operations only.

Rows are ordered by (hash of the text, hash of doc_id), so equal texts lie side by side.
Shard boundaries are found by counting, not by sampling or sorting: each round
counts the exact bytes below up to 4,096 equally spaced candidate keys in every
interval that still holds an undecided boundary. A boundary is settled when the
bytes below a candidate meet its target within the tolerance; else the interval
between two candidates is refined in the next round, first in the hash and then,
inside one text with many copies, in a hash of doc_id. Only these counts reach the driver:
at most 4,096 for each of the boundaries, whatever the input. When all
boundaries stand, rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, no_text

DIGIT_BITS = 12
LOWEST = -(1 << 63)


@dataclass
class _Boundary:
    """Rows with a text hash under ``hash``, or equal to it and a doc_id hash under ``doc``, lie below."""

    target: float
    base: int = 0
    prefix: int | None = None
    hash: int = LOWEST
    doc: int | None = None
    settled: bool = False
    heavy: int | None = None


def _settle(b: _Boundary, cells: list[tuple[int, int, int]], tolerance: float, last: bool = False) -> tuple[int, bool]:
    """The cell at whose lower edge the boundary lies, or the one to refine (then False). Moves ``b.base``.

    ``cells`` has (cell, size, rows); one row, or ``last`` cells, can't be refined and go to the nearer side.
    """
    below, cell = b.base, 0
    for cell, size, rows in cells:
        if below >= b.target - tolerance:
            return cell, True
        if below + size > b.target + tolerance:
            if rows == 1 or last:
                return cell + (b.target - below > below + size - b.target), True
            b.base = below
            return cell, False
        below += size
    return cell + 1, True


def _refine_hash(rows: DataFrame, bounds: list[_Boundary], tolerance: float) -> None:
    shift = 64
    while todo := [b for b in bounds if not b.settled and b.heavy is None]:
        above, shift = shift, max(0, shift - DIGIT_BITS)
        part = rows
        if above < 64:
            part = rows.filter(F.shiftright("h", above).isin(sorted({b.prefix for b in todo})))
        cells = (
            part.groupBy(F.shiftright("h", shift).alias("cell"))
            .agg(F.sum("size"), F.count("*"))
            .orderBy("cell")
            .collect()
        )
        for b in todo:
            own = [tuple(c) for c in cells if above == 64 or c[0] >> (above - shift) == b.prefix]
            cell, done = _settle(b, own, tolerance)
            if done:
                b.hash, b.settled = min(cell << shift, (1 << 63) - 1), True
            elif shift:
                b.prefix = cell
            else:  # one text is too large for any boundary beside it
                b.heavy = cell


def _refine_doc(rows: DataFrame, bounds: list[_Boundary], tolerance: float) -> None:
    """Inside one text's copies, by the hash of doc_id."""
    todo = [b for b in bounds if b.heavy is not None]
    above = 63
    for b in todo:
        b.prefix = 0
    while todo := [b for b in todo if not b.settled]:
        shift = max(0, above - DIGIT_BITS)
        wanted = sorted({(b.heavy, b.prefix) for b in todo})
        inside = F.struct("h", F.shiftright("doc", above)).isin(
            [F.struct(F.lit(h).cast("long"), F.lit(p).cast("long")) for h, p in wanted]
        )
        cells = (
            rows.filter(inside)
            .groupBy("h", F.shiftright("doc", shift).alias("cell"))
            .agg(F.sum("size"), F.count("*"))
            .orderBy("h", "cell")
            .collect()
        )
        for b in todo:
            own = [tuple(c[1:]) for c in cells if c[0] == b.heavy and c[1] >> (above - shift) == b.prefix]
            cell, done = _settle(b, own, tolerance, last=shift == 0)
            if done:
                b.hash, b.doc, b.settled = b.heavy, cell << shift, True
            else:
                b.prefix = cell
        above = shift


def _above(b: _Boundary) -> Column:
    at_hash = F.col("h") == F.lit(b.hash)
    if b.doc is not None:
        at_hash &= F.col("doc") >= F.lit(b.doc)
    return ((F.col("h") > F.lit(b.hash)) | at_hash).cast("int")


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 16,
    *,
    key: str = "doc_id",
    text: str = "text",
    tolerance: float = 0.002,
    piece_rows: int = 4096,
) -> DataFrame:
    """Deal every row to one of ``shards`` shards with near equal sums of size.

    Size is the text's UTF-8 bytes plus 1 (null text: 1). Boundaries meet their
    targets within ``tolerance`` times a shard's mean size, or as near as whole
    rows allow. Returns ``key``, size, text_crc32 (of nothing for null), law
    ``bytes``, shard, slot (gapless from 0 in each shard) and grown_shard null.

    Copies of a text stay in one shard unless a boundary must cut their run. Rows
    equal in text and doc_id can't be told apart and go together; a null doc_id is
    a value like any other. Slots number the pieces of a shard one after the other; a piece
    holds about ``piece_rows`` rows, chosen by a hash, and is sorted by key. Other
    columns are not read. No rows give no rows.
    """
    rows = keep(
        docs.select(
            F.col(key).cast("long").alias("id"),
            (F.octet_length(no_text(text)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(no_text(text)).alias("crc"),
            F.xxhash64(no_text(text)).alias("h"),
            F.shiftrightunsigned(F.xxhash64(key), 1).alias("doc"),
        ),
        "shard-keys",
    )
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bounds = [_Boundary(total * i / shards) for i in range(1, shards)]
    _refine_hash(rows, bounds, tolerance * total / shards)
    _refine_doc(rows, bounds, tolerance * total / shards)

    pieces = max(1, -(-count // (shards * piece_rows)))
    dealt = rows.withColumn("shard", sum((_above(b) for b in bounds), F.lit(0))).withColumn(
        "piece", F.pmod(F.xxhash64("doc", "h"), F.lit(pieces)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "piece")
        .agg(F.count("*").alias("n"))
        .select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("shard", "piece").orderBy("h", "doc")
    return (
        dealt.withColumn("row", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "piece"])
        .select(
            F.col("id").alias(key),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
