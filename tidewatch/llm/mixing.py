"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

Targets: sources share a multiple of all words by weight; a target stops at
``most`` times its source's size, and the excess is shared anew among the others.

Blocks: in each source, documents are ordered by a seeded hash and dealt by it to
shards. A shard's words, laid end to end, are cut into blocks of equal size; what
is left over at the end of each shard (less than a block) forms one further line
of the source, cut in the same way, so that at most one piece of each source, its
rest, is shorter than a block.

Quotas: sources get whole blocks by the highest quotients target / (2 j - 1), and
each source's blocks are given to its lines in the same way, by the blocks these
hold. No line gets more than ``most`` times its blocks: that many quotients of
each line are at least as high as all others.

Selection: a line with n blocks and a quota q takes each block q div n times, and
q mod n of them once more, evenly spaced from a seeded start. As documents lie in
hash order, this is a seeded draw. What a document gives follows from its place
on the line alone, so no block becomes a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, no_text

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
# Distinct documents that one task sorts, and rows in a range of ``numbered``.
PIECE_UNITS = 4096
RANGE_ROWS = 50_000
# Copies of one document that one task writes.
COPIES = 4096
SPANS = "array<struct<start:bigint,end:bigint,times:bigint>>"


def seeded(seed: int, *parts: Column) -> Column:
    """60 bits of an MD5 of the seed and the parts; null and empty parts differ."""
    texts = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("null")) for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _before(rows: DataFrame, group: list[str], order: str, what: str, name: str) -> DataFrame:
    """``name``: the sum of ``what`` over the rows of a group that come earlier."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(what).over(window), F.lit(0)))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, from 1 in the given order, which must tell all rows apart. No task sorts all rows."""
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    parts = keep(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    starts = _before(counts, [], "_part", "_rows", "_start").drop("_rows")
    return (
        parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
        .join(starts, "_part")
        .withColumn("number", (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_part", "_row", "_start")
    )


def capped_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: their part by weight of ``share`` times all sizes, at most ``most`` times their size.

    Each round shares among the others what the sources at their limit leave. Only sums reach the driver.
    """
    limit = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        fixed, weights = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if not weights or (total - fixed) / weights <= level:
            return sources.withColumn("full", full).withColumn(
                "target", F.when(full, limit).otherwise(F.col("weight") * F.lit(level))
            )
        level = (total - fixed) / weights


def _bounds(votes: Column, total: Column, seats: Column, parties: Column) -> tuple[Column, Column]:
    """Seats that a party has for sure, and the most it can have.

    A party's seats lie within half a seat of votes / divisor, so the divisor is between total / (seats + parties / 2)
    and total / (seats - parties / 2). Between the bounds of all parties lie only a few seats for each party.
    """
    least = F.floor(votes * F.greatest(F.lit(0.0), seats - parties / 2) / total - 0.5)
    most = F.ceil(votes * (seats + parties / 2) / total + 1.5)
    able = (votes > 0) & (seats > 0)
    return (
        F.when(able, F.greatest(F.lit(0), least)).otherwise(0).cast("long"),
        F.when(able, F.least(seats, most)).otherwise(0).cast("long"),
    )


def _open_seats(parties: DataFrame, votes: Column) -> DataFrame:
    """A row for each seat from ``sure`` + 1 to ``upper``, with its quotient."""
    seats = parties.filter("upper > sure").withColumn("seat", F.explode(F.expr("sequence(sure + 1, upper)")))
    return seats.withColumn("quotient", votes / (2 * F.col("seat") - 1))


def apportion_sources(sources: DataFrame, block: int, most: int) -> DataFrame:
    """``sources`` (number, full, target, blocks, rest) with ``quota`` (blocks) and ``rest_times``.

    Sources at their limit take all blocks ``most`` times. The others share the whole number of blocks nearest to their
    targets by highest quotients, ties to the lower number. A source's rest is taken as often as brings its words nearest
    to its target.
    """
    others = sources.filter("NOT full AND target > 0")
    total, parties = others.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    seats = int(total / block + 0.5)
    rows = sources.withColumn("given", F.lit(0).cast("long"))
    if seats:
        sure, upper = _bounds(F.col("target"), F.lit(total), F.lit(seats), F.lit(parties))
        bounded = keep(others.withColumn("sure", sure).withColumn("upper", upper).select("number", "target", "sure", "upper"), "bounds")
        left = seats - bounded.agg(F.sum("sure")).first()[0]
        contested = _open_seats(bounded.withColumnRenamed("number", "party"), F.col("target"))
        ranked = numbered(contested, F.desc("quotient"), F.asc("party"), F.asc("seat"))
        won = F.count(F.when(F.col("number") <= left, 1))
        given = ranked.groupBy(F.col("party").alias("number")).agg((F.max("sure") + won).alias("given"))
        rows = sources.join(given, "number", "left")
    limit = F.col("blocks") * most
    share = F.least(F.coalesce("given", F.lit(0)), limit)
    rows = rows.withColumn("quota", F.when(F.col("full"), limit).otherwise(share).cast("long"))
    away = [F.abs(F.col("target") - F.col("quota") * block - F.col("rest") * t) for t in range(most + 1)]
    nearest = F.array_position(F.array(*away), F.least(*away)) - 1
    return rows.withColumn("rest_times", nearest.cast("long")).drop("given")


def apportion_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (number, shard, blocks, source_blocks, quota) with ``line_quota``, by highest quotients of their blocks."""
    own = Window.partitionBy("number")
    held = F.count(F.when(F.col("blocks") > 0, 1)).over(own)
    lines = lines.withColumn("held", held)
    sure, upper = _bounds(F.col("blocks"), F.col("source_blocks"), F.col("quota"), F.col("held"))
    lines = lines.withColumn("sure", sure).withColumn("upper", upper)
    lines = keep(lines.withColumn("left", F.col("quota") - F.sum("sure").over(own)).drop("held"), "lines")
    order = Window.partitionBy("number").orderBy(F.desc("quotient"), "shard", "seat")
    place = F.row_number().over(order)
    won = (
        _open_seats(lines, F.col("blocks"))
        .withColumn("place", place)
        .filter("place <= left")
        .groupBy("number", "shard")
        .agg(F.count("*").alias("won"))
    )
    return (
        lines.join(won, ["number", "shard"], "left")
        .withColumn("line_quota", (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long"))
        .drop("sure", "upper", "left", "won")
    )


@dataclass
class _Line:
    """Columns of a line: its blocks, quota and seeded start, and how often the piece after its last block is taken."""

    block: int
    blocks: Column
    quota: Column
    phase: Column
    rest_times: Column

    def _picked(self, first: Column) -> Column:
        """Times that the blocks before ``first`` are taken together."""
        n = F.greatest(self.blocks, F.lit(1))
        return first * _div(self.quota, n) + _div(first * (self.quota % n) + self.phase, n)

    def times(self, number: Column) -> Column:
        inside = self._picked(number + 1) - self._picked(number)
        return F.when(number < self.blocks, inside).otherwise(self.rest_times)

    def below(self, x: Column) -> Column:
        """Words taken before position ``x``."""
        number = F.least(_div(x, F.lit(self.block)), self.blocks)
        return self._picked(number) * self.block + self.times(number) * (x - number * self.block)

    def spans(self, start: Column, end: Column, origin: Column) -> Column:
        """(start, end, times) of the parts of ``start`` to ``end`` that are taken, as word numbers of the document."""
        first, last = _div(start, F.lit(self.block)), _div(end - 1, F.lit(self.block))

        def part(b: Column) -> Column:
            return F.struct(
                (F.greatest(b * self.block, start) - origin).alias("start"),
                (F.least((b + 1) * self.block, end) - origin).alias("end"),
                self.times(b).alias("times"),
            )

        parts = F.when(start < end, F.transform(F.sequence(first, last), part)).otherwise(F.array().cast(SPANS))
        return F.filter(parts, lambda p: p["times"] > 0)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    *,
    most: int = 2,
    block: int = 64,
    shards: int = 64,
    seed: int = 11,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How often each document's words are taken for a mix of sources.

    Size is a document's number of words (null text: 0). Sources in order of code points, null last, weigh ``weights`` in
    turn and share ``share`` times all sizes. Returns a row a document: ``key``, source, size, source_size, target (its
    source's), taken (words, repeats counted) and spans (start, end, times: the taken ranges of the document's words). No
    word is taken more than ``most`` times. A source's taken words differ from its target by a few blocks at most.

    The same rows and seed give the same result, however they are partitioned. A null key is a value like any other; an
    empty source is a source of its own. Rows equal in key, source and size can't be told apart: they lie side by side.
    Documents without words take no part and give 0. Other columns are not read. No rows give no rows.
    """
    sid = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))  # sorts as the sources do, null last
    size = F.coalesce(F.regexp_count(no_text(text), F.lit(WORD)), F.lit(0)).cast("long")
    units = (
        docs.select(F.col(key).alias("id"), sid.alias("sid"), size.alias("size"))
        .groupBy("sid", "id", "size")
        .agg(F.count("*").alias("copies"))
        .withColumn("h", seeded(seed, F.col("id"), F.col("size")))
        .withColumn("shard", (F.col("h") % shards).cast("int"))
        .withColumn("words", F.col("size") * F.col("copies"))
    )
    units = keep(units, "mix-units")
    bits = max(0, (units.count() // (shards * PIECE_UNITS)).bit_length())
    units = units.withColumn("piece", F.shiftright("h", HASH_BITS - bits))

    pieces = keep(units.groupBy("sid", "shard", "piece").agg(F.sum("words").alias("words")), "mix-pieces")
    ends = pieces.groupBy("sid", "shard").agg(F.sum("words").alias("words"))
    ends = ends.withColumn("blocks", _div(F.col("words"), F.lit(block))).withColumn("tail", F.col("words") % block)
    ends = keep(_before(ends, ["sid"], "shard", "tail", "rest_start"), "mix-shards")
    sources = ends.groupBy("sid").agg(
        F.sum("words").alias("source_size"), F.sum("blocks").alias("shard_blocks"), F.sum("tail").alias("tails")
    )
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    sources = (
        numbered(sources, F.asc("sid"))
        .withColumn("weight", weight)
        .withColumn("rest_blocks", _div(F.col("tails"), F.lit(block)))
        .withColumn("rest", F.col("tails") % block)
        .withColumn("blocks", F.col("shard_blocks") + F.col("rest_blocks"))
    )
    sources = capped_targets(keep(sources, "mix-sources"), share, most)
    sources = keep(apportion_sources(sources, block, most), "mix-quotas")

    own = sources.select("sid", "number", F.col("blocks").alias("source_blocks"), "quota")
    lines = ends.select("sid", "shard", "blocks").join(own, "sid")
    rest = sources.select("sid", F.lit(shards).alias("shard"), F.col("rest_blocks").alias("blocks"), "number", "quota", F.col("blocks").alias("source_blocks"))
    lines = apportion_lines(lines.unionByName(rest))
    phase = seeded(seed, F.col("sid"), F.col("shard")) % F.greatest(F.col("blocks"), F.lit(1))
    lines = lines.select("sid", "shard", "blocks", "line_quota", phase.alias("phase"))
    last = lines.filter(F.col("shard") == shards).select(
        "sid", F.col("blocks").alias("rest_blocks"), F.col("line_quota").alias("rest_quota"), F.col("phase").alias("rest_phase")
    )
    params = (
        lines.join(ends.select("sid", "shard", "rest_start"), ["sid", "shard"])
        .join(last, "sid")
        .join(sources.select("sid", "source_size", "target", "rest_times"), "sid")
    )

    # Places on the lines: sums over pieces, then inside a piece.
    starts = _before(pieces, ["sid", "shard"], "piece", "words", "piece_start").drop("words")
    inside = Window.partitionBy("sid", "shard", "piece").orderBy("h", "id", "size")
    placed = (
        units.withColumn("until", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["sid", "shard", "piece"])
        .withColumn("first", F.col("piece_start") + F.col("until") - F.col("words"))
        .join(params, ["sid", "shard"])
    )
    few = placed.filter(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    many = placed.filter(F.col("copies") > COPIES).withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    many = many.repartition("sid", "id", "size", "run").withColumn(
        "copy", F.explode(F.expr(f"sequence(run * {COPIES}, least(copies, (run + 1) * {COPIES}) - 1)"))
    )
    rows = few.unionByName(many.drop("run")).withColumn("first", F.col("first") + F.col("copy") * F.col("size"))

    edge = F.col("blocks") * block
    start, end = F.col("first"), F.col("first") + F.col("size")
    main = _Line(block, F.col("blocks"), F.col("line_quota"), F.col("phase"), F.lit(0))
    rest_line = _Line(block, F.col("rest_blocks"), F.col("rest_quota"), F.col("rest_phase"), F.col("rest_times"))
    shift = F.col("rest_start") - edge  # from a place after the shard's last block to its place on the rest line
    m_start, m_end = F.least(start, edge), F.least(end, edge)
    r_start, r_end = F.greatest(start, edge) + shift, F.greatest(end, edge) + shift
    taken = main.below(m_end) - main.below(m_start) + rest_line.below(r_end) - rest_line.below(r_start)
    spans = F.concat(main.spans(m_start, m_end, start), rest_line.spans(r_start, r_end, start + shift))
    return rows.select(
        F.col("id").alias(key),
        F.when(F.col("sid") != "null", F.substring("sid", 2, 1 << 30)).alias(source),
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        spans.alias("spans"),
    )
