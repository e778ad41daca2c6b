"""Hard negatives by slot-decomposed selection.

An anchor's positives give windows of scores: from a part of each positive's score
(its lower limit) up to that score (its upper limit). The distinct upper limits
split all scores into disjoint slots, numbered from the highest; a negative belongs
to one slot. Every task keeps the best k of each slot of each anchor, and merging
the tasks' lists gives the slots' best k. A window takes the scores up to its upper
limit, that is its own slot and all lower ones. So the best of a window are the
first entries of the slots' lists from its own slot down, read in descending order,
as far as its lower limit lets them: one list for each slot answers all windows,
however they overlap.

Rows are packed to blocks of bounded size and never shuffled. Anchors are met in
rounds; a round's anchors hold at most ``round_bytes`` of vectors, are packed too
and broadcast, and every block meets every pack of the round once. Only each
task's best of each slot are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import keep
from tidewatch.llm.mixing import numbered

LONG = 1 << 63
DOUBLE_WHOLE = 1 << 53
PACK = "width int, numbers array<long>, ids array<long>, labels array<string>, limits array<string>, parts array<double>"
FOUND = "number long, slot int, id long, score long"


def _packed(rows: DataFrame, most: int, scale: int) -> DataFrame:
    """Rows (number, id, label, limits, v) in packs of one length and at most ``most`` rows, components scaled to whole numbers."""

    def pack_of(width: int, rows: list[tuple]) -> pa.RecordBatch:
        *plain, parts = zip(*rows, strict=True)
        flat = np.floor(np.concatenate(parts).astype(float) * scale)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        lists = [pa.array([list(c)], pa.list_(k)) for c, k in zip(plain, kinds, strict=True)]
        offsets = pa.array([0, len(flat)], pa.int32())
        names = ["width", "numbers", "ids", "labels", "limits", "parts"]
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *lists, pa.ListArray.from_arrays(offsets, flat)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: dict[int, list[tuple]] = {}
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("number", "id", "label", "limits")]
            for row in zip(*plain, batch.column("v"), strict=True):
                part = row[-1].values.to_numpy(zero_copy_only=False)
                mine = open_rows.setdefault(len(part), [])
                mine.append((*row[:-1], part))
                if len(mine) == most:
                    yield pack_of(len(part), open_rows.pop(len(part)))
        for width, mine in open_rows.items():
            yield pack_of(width, mine)

    return rows.select("number", "id", "label", "limits", "v").mapInArrow(run, PACK)


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, a row for each anchor: as longs where these hold a hundred times any, else as Python's whole numbers."""
    bound = rows.shape[1] * int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0))
    if bound < DOUBLE_WHOLE:
        return (anchors @ rows.T).astype(np.int64)
    if bound * 100 < LONG:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(anchors) @ whole(rows).T if rows.shape[1] else np.zeros((len(anchors), len(rows)), object)


def _order(found: tuple[int, int]) -> tuple[int, int]:
    """Higher scores first, ties by smaller id."""
    return -found[0], found[1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    if len(scores) > k:
        near = scores >= np.sort(scores)[-k] if scores.dtype == object else scores >= np.partition(scores, len(scores) - k)[-k]
        scores, ids = scores[near], ids[near]
    return sorted(zip(scores.tolist(), ids.tolist(), strict=True), key=_order)[:k]


class Slots:
    """The best ``k`` of each slot of each anchor among the rows met so far.

    Without limits (``same``), an anchor has one slot for all other rows of its label; else rows of other labels are dealt to
    the slots between its limits.
    """

    def __init__(self, k: int, floor: int, same: bool) -> None:
        self.k, self.floor, self.same = k, floor, same
        self.best: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def meet(self, anchors: dict, rows: dict) -> None:
        scores = _scores(rows["parts"], anchors["parts"])
        names, codes = np.unique(rows["labels"], return_inverse=True)
        code_of = {name: code for code, name in enumerate(names)}
        for a, (number, own_id, label) in enumerate(zip(anchors["numbers"], anchors["ids"], anchors["labels"], strict=True)):
            alike = codes == code_of.get(label, -1)
            wanted = np.flatnonzero(alike & (rows["ids"] != own_id) if self.same else ~alike)
            mine, ids = scores[a][wanted], rows["ids"][wanted]
            if self.same:
                self._add((number, 0), mine, ids)
                continue
            uppers = [int(u) for u in anchors["limits"][a].split()]
            for slot, upper in enumerate(uppers):
                # A window that holds a row of this slot has this upper limit or a higher one, and so asks for this lower limit at least.
                inside = (mine <= upper) & (mine * 100 >= self.floor * upper)
                if slot + 1 < len(uppers):
                    inside &= mine > uppers[slot + 1]
                self._add((number, slot), mine[inside], ids[inside])

    def _add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            found = _best(scores, ids, self.k)
            self.best[key] = list(heapq.merge(self.best.get(key, []), found, key=_order))[: self.k]

    def batches(self) -> Iterator[pa.RecordBatch]:
        flat = [(number, slot, row_id, score) for (number, slot), found in self.best.items() for score, row_id in found]
        if any(not -LONG <= score < LONG for *_, score in flat):
            raise OverflowError("mine: a score is beyond a long")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for first in range(0, len(flat), 1 << 16):
            columns = zip(*flat[first : first + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["number", "slot", "id", "score"])


def _side(batch: pa.RecordBatch, row: int, prefix: str) -> dict:
    out = {c: batch.column(prefix + c)[row].values for c in ("numbers", "ids", "labels", "limits", "parts")}
    width = batch.column("width")[row].as_py()
    return {
        "numbers": out["numbers"].to_pylist(),
        "ids": out["ids"].to_numpy(),
        "labels": np.array(out["labels"].to_pylist(), str),
        "limits": out["limits"].to_pylist(),
        "parts": out["parts"].to_numpy().reshape(len(out["ids"]), width),
    }


def _search(blocks: DataFrame, anchors: DataFrame, k: int, floor: int, same: bool, pack_rows: int, round_rows: int, scale: int) -> DataFrame:
    """(number, slot, id, score): the best ``k`` of every slot of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(k, floor, same)
        for batch in batches:
            for row in range(batch.num_rows):
                slots.meet(_side(batch, row, "a_"), _side(batch, row, ""))
        yield from slots.batches()

    last = anchors.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    found = None
    for first in range(0, max(last, 1), round_rows):
        # At most round_rows anchors, so one task packs them and their broadcast is bounded.
        now = anchors.filter((F.col("number") > first) & (F.col("number") <= first + round_rows)).repartition(1)
        packs = _packed(now, pack_rows, scale)
        packs = packs.withColumnsRenamed({c: f"a_{c}" for c in packs.columns})
        met = blocks.join(F.broadcast(packs), F.col("width") == F.col("a_width"))
        part = keep(met.mapInArrow(run, FOUND), "slots")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    *,
    floor: int = 80,
    scale: int = 256,
    block_rows: int = 4096,
    pack_rows: int = 1024,
    round_bytes: int = 4 << 20,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Return the hardest negatives of each positive of each anchor.

    A component x counts as floor(``scale`` * x); scores are whole inner products. Higher scores come first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of the same label. For each of them, the first
    ``negatives`` rows of other labels whose score is from ``floor`` percent of the positive's score up to that score are
    returned: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` has the columns of ``vectors``. Rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Other rows are those of another id; rows of another length than the anchor's have no score with it. Equal
    rows of ``vectors`` count each, equal anchors once. A window of a negative score is empty. An anchor without
    positives, a positive without negatives, no anchors and no rows give no rows. A score that a long can't hold ends
    the job with an error if it is among the best. Other columns are not read.
    """
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < F.lit(float("inf")), F.lit(False)))

    def valid(df: DataFrame) -> DataFrame:
        whole = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(finite)
        return whole.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))

    def bare(df: DataFrame) -> DataFrame:
        return df.withColumn("limits", F.lit(None).cast("string"))

    blocks = keep(_packed(bare(valid(vectors)).withColumn("number", F.lit(None).cast("long")), block_rows, scale), "blocks")
    asked = keep(numbered(valid(anchors).distinct(), F.asc("id"), F.asc("label"), F.asc("v")), "anchors")
    widest = asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    sizes = {"pack_rows": pack_rows, "round_rows": max(1, round_bytes // (8 * max(1, widest))), "scale": scale}

    near = _search(blocks, bare(asked), positives, floor, True, **sizes)
    near = keep(near.select("number", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = F.sort_array(F.collect_set("positive_score"), asc=False)  # at most ``positives`` of an anchor
    limits = near.groupBy("number").agg(scores.alias("uppers"))
    limited = asked.join(limits, "number").withColumn("limits", F.array_join(F.col("uppers").cast("array<string>"), " "))
    slots = _search(blocks, keep(limited.drop("uppers"), "limited"), negatives, floor, False, **sizes)

    # At most positives * negatives entries of an anchor, in descending order: slots follow one another.
    lists = slots.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("best"))
    answers = near.join(lists, "number").join(asked.select("number", F.col("id").alias("anchor_id")), "number")
    # The list from the window's slot down: all entries up to its upper limit.
    inside = F.filter(
        "best",
        lambda e: (e["score"] <= F.col("positive_score"))
        & (e["score"].cast("decimal(38,0)") * 100 >= F.col("positive_score").cast("decimal(38,0)") * floor),
    )
    return answers.select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("place", "negative")
    ).select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        "positive_score",
        F.col("negative.score").alias("negative_score"),
    )
