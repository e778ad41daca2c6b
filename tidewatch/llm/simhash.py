"""SimHash fingerprints, linked through BK-trees.

A BK-tree keeps each fingerprint under its parent by their Hamming distance; a
search with radius r at distance d follows only the edges from d - r to d + r.
One tree over all fingerprints can't be built or broadcast at scale, so
fingerprints are dealt to many small trees that together lose no link: the 64
bits are five blocks, and of any two fingerprints within three bits at least two
blocks are equal, so each fingerprint goes to one tree for each pair of blocks.
A tree that would hold too many, as in a large group of near copies, is split
once more by quarters of the remaining bits, of which at least one must be equal.
A tree emits only edges that join two parts of it, never all pairs.

Near duplicates by similarity start from the same fingerprints, BK-trees and components;
texts of one component are then compared exactly. About one of a hundred pairs with a
similarity of 0.8 differs in over 16 bits, so that texts meet once more in trees dealt by
minimum hashes. All comparisons are made within shards of bounded size, to which the
texts' shingle hashes are sent: a shard yields only the links that join two parts of it,
so rows grow with its members and not with its pairs. A tree can't be split by its
members' values when a third of all documents are near copies; a first round cuts it into
blocks that share some heads (see ``_blocks``), the last brings those members together
that no link joins yet (see ``_crossing``). Where it holds many texts of one template,
these meet by their rarest shingles instead; large trees of one group are then one tree (see ``_merged``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import by_batch, keep, lend, ready, texts_of, tidy
from tidewatch.llm.components import components
from tidewatch.llm.words import mixed, run_hashes, word_hashes

BITS = 64
MASK = (1 << BITS) - 1
SLICE = 1 << 15
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
MINIMA = 8
# Size of a block of an overfull tree, and of the heads that all its blocks hold in the first round. A text counts
# as one, or as a WEIGHTth of its distinct shingles if these are more, so that a shard's hashes fit in memory.
BLOCK = 256
HEADS = 32
WEIGHT = 4096
# Parts of the last round's shards whose texts are sent one part after the other, so that their disk is free again for the next.
LOTS = 4
# Counts of shingles by the first 20 bits of their hashes.
BUCKETS = 1 << 20
# Sides of a shard: pairs are those of two sides, or of side OWN.
SHARED, OWN, UPPER = 0, 1, 2


def shingle_hashes(text: bytes, length: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of lower-cased (A-Z) words; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = min(length, len(words))
    last = len(words) - length + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[length - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, last)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; as a signed number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp) of every row; null and empty texts and those without words have fingerprint zero."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            marks = [fingerprint(shingle_hashes(t, shingle)) for t in texts_of(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(marks, pa.int64())], ["doc", "fp"])

        return step

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(
        by_batch(make), "doc long, fp long"
    )


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            below = self.children[at]
            distance = (value ^ self.values[at]).bit_count()
            if distance not in below:
                below[distance] = new
                return
            at = below[distance]

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """(distance, number) of every member within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                yield distance, at
            low, high = distance - radius, distance + radius
            todo.extend(child for edge, child in self.children[at].items() if low <= edge <= high)


def _spanning(values: list[int], nodes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Edges between members within the radius, enough to connect all that are connected."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        own = i
        for _, j in tree.within(value, radius):
            if (other := find(j)) != own:
                root[own] = other
                own = other
                yield nodes[i], nodes[j]
        tree.add(value)


def _joining(
    sides: np.ndarray, nodes: np.ndarray, roots: np.ndarray, runs: list[np.ndarray], similarity: float
) -> Iterator[tuple[int, int]]:
    """Links between a shard's members with different roots, enough to connect all that its links connect.

    Similarity is exact: the part of two texts' distinct shingles that both have. Pairs of a
    shard are those of two sides, or of side OWN.
    """
    sizes = np.array([len(r) for r in runs])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(runs), return_inverse=True)[1]
    has, part = np.zeros(len(ids), bool), roots.copy()
    for i in range(1, len(nodes)):
        other = (part[:i] != part[i]) & ((sides[:i] != sides[i]) | (sides[i] == OWN))
        if not other.any():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        has[own] = True
        common = np.add.reduceat(has[ids[: starts[i]]], starts[:i], dtype=np.int64)
        has[own] = False
        for j in np.flatnonzero(other & (common >= similarity * (sizes[i] + sizes[:i] - common))):
            if part[j] != part[i]:
                part[part == part[i]] = part[j]
                yield int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))


def _by_shard(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of one shard after the other, from batches in the order of ``shard``, the first column."""
    shard, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != shard:
                if len(rows) > 1:
                    yield rows
                shard, rows = row[0], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _packed(edges: Iterator[tuple[int, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(edges, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names)


def tree_edges(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b) found by one tree for each value of ``shard``; ``dealt`` has (shard, fp, node).

    A partition is a sorted stream of shards; one shard is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (
            edge
            for rows in _by_shard(batches, ["shard", "fp", "node"])
            for edge in _spanning([r[1] & MASK for r in rows], [r[2] for r in rows], radius)
        )
        yield from _packed(edges, ["a", "b"])

    return dealt.repartition("shard").sortWithinPartitions("shard", "node", "fp").mapInArrow(tidy(run), "a long, b long")


def _links(shards: DataFrame, runs: DataFrame, roots: DataFrame | None, similarity: float, lots: int = 1) -> DataFrame:
    """(a, b) that join parts of a shard (see ``_joining``); ``shards`` has (shard, side, node), ``runs`` (node, runs).

    With several ``lots``, shards are dealt to so many by their hash, each is shuffled after the one before is done and removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = (
            link
            for rows in _by_shard(batches, ["shard", "side", "node", "root", "runs"])
            for link in _joining(
                *(np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3)),
                [np.frombuffer(r[4], np.uint64) for r in rows],
                similarity,
            )
        )
        yield from _packed(links, ["a", "b"])

    def found(rows: DataFrame) -> DataFrame:
        full = rows.join(runs, "node").select("shard", "side", "node", "root", "runs")
        return full.repartition("shard").sortWithinPartitions("shard", "side", "node").mapInArrow(tidy(run), "a long, b long")

    rooted = _rooted(shards, roots)
    if lots == 1:
        return found(rooted)
    rooted = keep(rooted, "shards")
    return reduce(DataFrame.unionByName, [keep(found(rooted.filter(F.pmod("shard", F.lit(lots)) == lot)), "links") for lot in range(lots)])


def _rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """With the root of each node, itself if no link has it."""
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _bits(start: int, count: int) -> Column:
    return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << count) - 1))


def _shards(distinct: DataFrame, most: int) -> DataFrame:
    """(shard, fp, node): ten trees for each fingerprint, and four for each of those in an overfull tree."""
    first, rest = [], []
    for number, pair in enumerate(combinations(range(len(BLOCKS)), 2)):
        (a, n), (b, m) = (BLOCKS[i] for i in pair)
        first.append(F.lit(number << 40) + F.shiftleft(_bits(a, n), 13) + _bits(b, m))
        left = F.lit(0).cast("long")
        for start, count in (BLOCKS[i] for i in range(len(BLOCKS)) if i not in pair):
            left = F.shiftleft(left, count) + _bits(start, count)
        rest.append(left)
    trees = F.explode(F.array(*(F.struct(f.alias("shard"), r.alias("rest")) for f, r in zip(first, rest, strict=True))))
    dealt = distinct.select("fp", "node", trees.alias("tree")).select("fp", "node", "tree.*")
    overfull = dealt.groupBy("shard").count().filter(F.col("count") > most).select("shard", F.lit(True).alias("split"))
    quarters = F.array(
        *(
            F.xxhash64("shard", F.lit(q), F.shiftrightunsigned("rest", 10 * q).bitwiseAND(F.lit(1023)))
            for q in range(4)
        )
    )
    return dealt.join(overfull, "shard", "left").select(
        F.explode(F.when(F.col("split"), quarters).otherwise(F.array(F.xxhash64("shard")))).alias("shard"), "fp", "node"
    )


def _linked_fingerprints(distinct: DataFrame, most: int) -> DataFrame:
    """(fp, component_id) of fingerprints that chains of three or fewer differing bits link; ``distinct`` has (fp, node)."""
    roots = components(tree_edges(_shards(distinct, most), RADIUS))
    return distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))


def simhash_components(
    docs: DataFrame, *, shingle: int = 3, most: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return ``key``, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints link at three or fewer differing bits; component_id is the
    smallest doc_id that can be reached. Every row with a doc_id counts, copies
    through their one fingerprint. A row with a null doc_id links nothing and
    takes the component of its fingerprint, null if no other row has it. Rows
    that share a doc_id count as one document. Null, empty and blank texts have
    fingerprint zero, linked like any other. Other columns are not read; no rows
    give no rows. ``most``: fingerprints in a tree before it is split.
    """
    marks = keep(fingerprints(docs, shingle=shingle, key=key, text=text), "fingerprints")
    distinct = keep(
        marks.filter("doc IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("node")), "distinct-fingerprints"
    )
    by_fp = keep(_linked_fingerprints(distinct, most), "by-fp")
    return marks.join(by_fp, "fp", "left").select(
        F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _runs(text: bytes, length: int) -> np.ndarray:
    """A hash of each shingle of lower-cased (A-Z) words; of all words if they are fewer."""
    words = word_hashes(text.lower())
    return run_hashes(words, min(length, len(words))) if len(words) else np.zeros(0, np.uint64)


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of MINIMA re-hashings: two texts agree in one with the probability of their similarity."""
    out = np.zeros(MINIMA, np.uint64)
    for i in range(MINIMA):
        out[i] = mixed(hashes ^ mixed(np.array([i + 1], np.uint64))).min() if len(hashes) else i
    return out


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc, text_hash, same, minima, fp, weight): ``same`` is equal for texts with equal words, ``fp`` is of distinct shingles."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            same, minima, marks, weights = [], [], [], []
            for text in texts_of(batch, "text"):
                hashes = np.unique(_runs(text, shingle))
                same.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
                minima.append(_minima(hashes).view(np.int64))
                marks.append(fingerprint(hashes))
                weights.append(max(1.0, len(hashes) / WEIGHT))
            arrays = [batch.column("doc"), batch.column("text_hash"), pa.array(same)]
            arrays += [pa.array(minima, pa.list_(pa.int64())), pa.array(marks, pa.int64()), pa.array(weights, pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc", "text_hash", "same", "minima", "fp", "weight"])

        return step

    return docs.mapInArrow(
        by_batch(make), "doc long, text_hash long, same binary, minima array<long>, fp long, weight double"
    )


def _trees(classes: DataFrame) -> DataFrame:
    """(tree, node, weight): a tree for each value of each minimum hash."""
    return classes.select("node", "weight", F.posexplode("minima").alias("place", "least")).select(
        F.xxhash64("place", "least").alias("tree"), "node", "weight"
    )


def _met(trees: DataFrame) -> DataFrame:
    """Trees of several members; of those with the same members, as for two texts that agree in many minima, one."""
    sums = trees.groupBy("tree").agg(
        F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("other"), "node")).alias("other"),
    )
    kept = sums.filter("members > 1").groupBy("members", "one", "other").agg(F.min("tree").alias("tree"))
    return trees.join(kept.select("tree"), "tree", "left_semi")


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("other")


def _blocks(trees: DataFrame) -> DataFrame:
    """(shard, side, node): trees of up to BLOCK members as they are, others in random blocks that share HEADS heads.

    A first round only, of linear work: it finds most links of a large group of
    near copies, through the heads those in different blocks. Trees of which ``small``
    is false are left out if they have up to BLOCK members.
    """
    sizes = trees.groupBy("tree", "small").agg(F.count("*").alias("members"), F.sum("weight").alias("weight"))
    sizes = sizes.filter((F.col("members") > 1) & (F.col("small") | (F.col("weight") > BLOCK)))
    sizes = keep(sizes.select("tree", F.ceil(F.col("weight") / BLOCK).alias("blocks")), "tree-sizes")
    dealt = trees.join(sizes, "tree")
    order = Window.partitionBy("tree").orderBy(F.xxhash64("node", "tree"), "node")
    heads = dealt.filter("blocks > 1").withColumn("number", F.row_number().over(order)).filter(F.col("number") <= HEADS)
    heads = heads.withColumn("upto", F.sum("weight").over(order)).filter((F.col("upto") <= HEADS) | (F.col("number") == 1))
    own = dealt.select(
        F.xxhash64("tree", F.pmod(F.xxhash64("tree", "node"), "blocks")).alias("shard"), F.lit(OWN).alias("side"), "node"
    )
    shared = heads.select("tree", "node", _every(F.col("blocks")))
    return own.unionByName(shared.select(F.xxhash64("tree", "other").alias("shard"), F.lit(SHARED).alias("side"), "node"))


def _mixed_trees(trees: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees that hold several roots: (tree, members, strays, most) by weight, and their rows (tree, node, weight, root).

    ``most`` is the root of most members, strays are the members with another.
    """
    rooted = keep(_rooted(trees, roots), "rooted-trees")
    parts = rooted.groupBy("tree", "root").agg(F.sum("weight").alias("weight"))
    sizes = parts.groupBy("tree").agg(
        F.sum("weight").alias("members"), F.max(F.struct("weight", "root")).alias("top"), F.count("*").alias("parts")
    )
    mixed_ = keep(
        sizes.filter("parts > 1").select(
            "tree", "members", (F.col("members") - F.col("top.weight")).alias("strays"), F.col("top.root").alias("most")
        ),
        "mixed-trees",
    )
    return mixed_, rooted


def _prefix_trees(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(tree, node): a tree for each of a text's rarest shingles, as many as it can lack of another of that similarity, and one.

    Any two texts of the similarity share one of these, as all are in one order:
    by the number of texts in the bucket of the shingle's hash (in eighths of its
    logarithm), then by hash. One byte for each of BUCKETS is all that reaches the
    driver and is broadcast. A passage that many texts share is in the rarest part
    of none that has enough of its own.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in texts_of(batch, "text"):
                np.add.at(total, _bucket(np.unique(_runs(text, shingle))), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "texts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.zeros(BUCKETS, np.uint8)
        for batch in batches:
            steps[batch.column("bucket").to_numpy()] = 8 * np.log2(batch.column("texts").to_numpy() + 1)
        yield pa.RecordBatch.from_pydict({"steps": [steps.tobytes()]})

    tallied = texts.select("text").mapInArrow(tidy(tally), "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts"))
    gathered = tallied.repartition(1).mapInArrow(gather, "steps binary").collect()
    sent = ready(texts.sparkSession).sparkContext.broadcast(bytes(gathered[0].steps) if gathered else bytes(BUCKETS))

    def make():
        known = np.frombuffer(sent.value, np.uint8)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rare, sizes = [np.zeros(0, np.uint64)], []
            for text in texts_of(batch, "text"):
                hashes = np.unique(_runs(text, shingle))
                lacking = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9))
                rare.append(hashes[np.lexsort((hashes, known[_bucket(hashes)]))][: lacking + 1])
                sizes.append(len(rare[-1]))
            nodes = np.repeat(batch.column("doc").to_numpy(), sizes)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare).view(np.int64)), pa.array(nodes)], ["rare", "node"])

        return step

    rows = texts.select("doc", "text").mapInArrow(by_batch(make), "rare long, node long")
    return keep(rows.select(F.xxhash64(F.lit("prefix"), "rare").alias("tree"), "node"), "prefixes")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _merged(mixed_: DataFrame, rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As from ``_mixed_trees``, with overfull trees of one group as one tree where that takes fewer comparisons.

    The near copies of one text share each of its rarest shingles, so that they meet in many trees with
    nearly the same members, and each tree costs the square of these. Trees of over BLOCK members
    whose most members have the same root become the tree of all their members, unless its square is
    larger than theirs in sum. Any two members of a tree still meet.
    """
    mark = F.xxhash64(F.lit("merged"), "most").alias("tree")
    large = mixed_.filter(F.col("members") > BLOCK).select("tree", "most", "members")
    rows = rooted.join(large.select("tree", "most"), "tree").groupBy("most", "node")
    rows = keep(rows.agg(F.first("weight").alias("weight"), F.first("root").alias("root")), "merged-rows")
    stray = F.when(F.col("root") != F.col("most"), F.col("weight")).otherwise(0.0)
    union = rows.groupBy("most").agg(F.sum("weight").alias("members"), F.sum(stray).alias("strays"))
    apart = large.groupBy("most").agg(F.sum(F.col("members") * F.col("members")).alias("squares"), F.count("*").alias("trees"))
    union = keep(union.join(apart, "most").filter("trees > 1 AND members * members < squares").drop("squares", "trees"), "merged-trees")
    gone = keep(large.join(union.select("most"), "most", "left_semi").select("tree"), "replaced-trees")
    rows = rows.join(union.select("most"), "most", "left_semi").select(mark, "node", "weight", "root")
    return (
        mixed_.join(gone, "tree", "left_anti").unionByName(union.withColumn("tree", mark)),
        rooted.join(gone, "tree", "left_anti").unionByName(rows),
    )


def _crossing(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """(shard, side, node): shards in which any two members of a tree with different roots meet.

    A tree of up to BLOCK members is a shard. A larger one is dealt to random
    blocks that all hold its strays, if these are up to BLOCK; otherwise any two
    of its blocks are a shard. No shard has over about two blocks.
    """
    mixed_, rooted = _merged(*_mixed_trees(trees, roots))
    dealt = rooted.join(mixed_.withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "tree").withColumn(
        "block", F.pmod(F.xxhash64("tree", "node"), "blocks")
    )
    few = F.col("strays") <= BLOCK
    own = dealt.filter(few | (F.col("blocks") == 1))
    strays = own.filter("blocks > 1 AND root <> most").select("tree", "node", _every(F.col("blocks")))
    grid = dealt.filter(~few & (F.col("blocks") > 1)).select("tree", "node", "block", _every(F.col("blocks")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), OWN).when(F.col("block") < F.col("other"), SHARED).otherwise(UPPER)
    return (
        own.select(F.xxhash64("tree", "block").alias("shard"), F.lit(OWN).alias("side"), "node")
        .unionByName(strays.select(F.xxhash64("tree", "other").alias("shard"), F.lit(SHARED).alias("side"), "node"))
        .unionByName(grid.select(F.xxhash64("tree", low, high).alias("shard"), side.alias("side"), "node"))
    )


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, most: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return ``key``, text_hash and component_id of every row, by similarity of whole texts.

    Texts with equal words (A-Z lowered) are one class. Classes get the SimHash fingerprint of
    their distinct shingles of ``shingle`` words; BK-trees find fingerprints that differ in three or
    fewer bits, and the texts of each component of these are compared. Then classes meet in trees of
    one level, one for each value of each of eight minimum hashes over the same shingles: two
    texts of similarity 0.8 share none of them in fewer than three of a million cases.
    Similarity (shared by all distinct shingles) is computed exactly, first in components and
    blocks of large trees, then for all members of a tree that the links found so far do
    not join already. Pairs below ``similarity`` are no links. ``most``: fingerprints in a
    BK-tree before it is split. component_id is the smallest doc_id that links reach.

    Texts without words are one class. Rows with a null key link nothing and have
    a null component_id. Rows that share a key count as one document. Other
    columns are not read; no rows give no rows.
    """
    read = docs.select(
        F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )
    sketches = keep(_sketches(read, shingle), "sketches")
    first = F.min(F.struct("doc", "text_hash", "minima", "fp", "weight")).alias("first")
    classes = keep(
        sketches.filter("doc IS NOT NULL")
        .groupBy("same")
        .agg(first)
        .select("same", F.col("first.doc").alias("node"), "first.text_hash", "first.minima", "first.fp", "first.weight"),
        "classes",
    )

    def texts_of_nodes(nodes: DataFrame) -> DataFrame:
        """One text for each class, of all its rows the one whose sketch was taken."""
        wanted = classes.select("node", "text_hash").join(nodes.distinct(), "node", "left_semi")
        return (
            read.filter("doc IS NOT NULL")
            .join(wanted.withColumnRenamed("node", "doc"), ["doc", "text_hash"])
            .dropDuplicates(["doc", "text_hash"])
            .select("doc", F.coalesce("text", F.lit("")).alias("text"))
        )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs = [np.unique(_runs(t, shingle)).tobytes() for t in texts_of(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(runs, pa.binary())], ["node", "runs"])

        return step

    distinct = keep(classes.groupBy("fp").agg(F.min("node").alias("node")), "distinct-fingerprints")
    linked = _linked_fingerprints(distinct, most)
    near = classes.join(linked, "fp").select(F.xxhash64(F.lit("near"), "component_id").alias("tree"), "node", "weight")
    near = keep(_met(near), "near-fingerprints")
    trees = keep(_met(_trees(classes)), "trees")
    runs = texts_of_nodes(trees.select("node").unionByName(near.select("node")))
    runs, free_runs = lend(runs.mapInArrow(by_batch(make), "node long, runs binary"), "runs")

    both = near.withColumn("small", F.lit(True)).unionByName(trees.withColumn("small", F.lit(False)))
    roots = components(_links(_blocks(both), runs, None, similarity))
    mixed_, rooted = _mixed_trees(trees, roots)
    shared = mixed_.filter(F.col("strays") > BLOCK).select("tree")
    if not shared.isEmpty():  # texts that share a passage and little else: they meet by their rarest shingles instead
        texts = keep(texts_of_nodes(rooted.join(shared, "tree", "left_semi").select("node")), "shared-texts")
        rare = _met(_prefix_trees(texts, shingle, similarity)).join(classes.select("node", "weight"), "node")
        trees = keep(trees.join(shared, "tree", "left_anti").unionByName(rare), "all-trees")
    links = _links(_crossing(trees, roots), runs, roots, similarity, LOTS)
    # The links found before go on as stars, which join the same classes.
    roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    by_class = keep(
        classes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component_id")), "by-class"
    )
    free_runs()  # all links are in by_class; the hashes of shingles are as large as the texts
    return sketches.join(by_class, "same", "left").select(
        F.col("doc").alias(key),
        "text_hash",
        F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"),
    )
