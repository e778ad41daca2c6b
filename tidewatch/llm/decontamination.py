"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if they share a seed: ``shortest``
consecutive words. Tiling then marks the longest common run of unmarked words,
again and again, longest first, until none of the least length is left; runs may
lie in any order, so reordered passages are found. Runs are found by running
Karp-Rabin: rolling hashes of the unmarked runs of one length, the length falling
from the item's to the least. An item is leaked if its tiles cover enough of it.

The benchmark is cut into blocks of at most ``block_words`` words; a block's seed
table has a bounded size and is sent to the tasks, and documents are read once
for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_batch, keep, texts_of
from tidewatch.llm.words import run_hashes, word_hashes


def _runs(hashes: np.ndarray, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the runs of ``length`` unmarked words."""
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    used = np.concatenate([[0], np.cumsum(marked)])
    starts = np.flatnonzero(used[length:] == used[:-length])
    return starts, run_hashes(hashes, length)[starts]


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start in the item, start in the document, words) of each tile, longest first."""
    shortest = min(shortest, len(item))
    item_marked, doc_marked, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    length = min(len(item), len(doc))
    while length >= shortest and length > 0:
        starts, own = _runs(item, item_marked, length)
        places, other = _runs(doc, doc_marked, length)
        common = np.isin(own, other)
        if not common.any():
            # The longest common run is shorter: go down, by halves while nothing is in common.
            low, high = shortest, length - 1
            while low < high:
                middle = (low + high + 1) // 2
                if np.isin(_runs(item, item_marked, middle)[1], _runs(doc, doc_marked, middle)[1]).any():
                    low = middle
                else:
                    high = middle - 1
            if length <= shortest:
                break
            length = low if high >= shortest else 0
            if length == shortest and not np.isin(_runs(item, item_marked, length)[1], _runs(doc, doc_marked, length)[1]).any():
                break
            continue
        order = np.argsort(other, kind="stable")
        for start, value in zip(starts[common].tolist(), own[common].tolist(), strict=True):
            if item_marked[start : start + length].any():
                continue
            at = int(np.searchsorted(other[order], np.uint64(value)))
            while at < len(order) and int(other[order[at]]) == value:
                place = int(places[order[at]])
                if not doc_marked[place : place + length].any() and (item[start : start + length] == doc[place : place + length]).all():
                    item_marked[start : start + length] = True
                    doc_marked[place : place + length] = True
                    out.append((start, place, length))
                    break
                at += 1
        length -= 1
    return out


def _covered(own: np.ndarray, other: np.ndarray, length: int) -> int:
    """How many words lie in a seed that ``other`` has too."""
    places = np.flatnonzero(np.isin(own, other))
    covered = np.zeros(len(own) + length - 1, bool)
    for i in range(length):
        covered[places + i] = True
    return int(covered.sum())


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    coverage: float = 0.6,
    shortest: int = 4,
    block_words: int = 1_000_000,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Return ``key``, ``item_key``, n_tiles, longest_tile, matched_words, item_words and coverage of each leak.

    A row for every pair of a document and an item whose tiles of at least
    ``shortest`` words cover at least ``coverage`` of the item's words. Words are
    lower-cased (A-Z) runs of other characters than white space, from whole texts.
    Items shorter than ``shortest`` must be there whole.

    Null, empty and blank texts and items have no words and no leaks. Null and
    repeated keys are rows of their own, on both sides. Other columns are not
    read; no documents or no items give no rows.
    """
    spark = docs.sparkSession
    measured = keep(
        items.select(F.col(item_key).cast("long").alias("item"), F.col(text).alias("text"))
        .filter(F.length(F.trim("text")) > 0)
        .withColumn("words", F.size(F.split("text", r"[ \t-\r]+")).cast("long")),
        "items",
    )
    blocks = -(-(measured.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]) // block_words)
    read = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    names = ["doc", "item", "n_tiles", "longest_tile", "matched_words", "item_words", "coverage"]
    schema = "doc long, item long, n_tiles int, longest_tile int, matched_words int, item_words int, coverage double"
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())

    def found_in(block: int) -> DataFrame:
        own = measured.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in own.select("item", "text").collect()])

        def make():
            known = [(item, word_hashes(t.encode().lower())) for item, t in sent.value]
            known = [(item, h) for item, h in known if len(h)]
            seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for length in sorted({min(shortest, len(h)) for _, h in known}):
                numbers = [i for i, (_, h) in enumerate(known) if min(shortest, len(h)) == length]
                each = [np.unique(run_hashes(known[i][1], length)) for i in numbers]
                of = np.repeat(np.array(numbers), [len(e) for e in each])
                values = np.concatenate(each)
                order = np.argsort(values, kind="stable")
                seeds[length] = (values[order], of[order])

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                out = []
                for doc, t in zip(batch.column("doc").to_pylist(), texts_of(batch, "text"), strict=True):
                    hashes = word_hashes(t.lower())
                    for length, (values, of) in seeds.items():
                        runs = np.unique(run_hashes(hashes, length))
                        first, last = np.searchsorted(values, runs), np.searchsorted(values, runs, "right")
                        some = np.flatnonzero(first < last)
                        numbers = {int(n) for i in some for n in of[first[i] : last[i]]}
                        for number in sorted(numbers):
                            item, words = known[number]
                            if _covered(run_hashes(words, length), runs, length) < coverage * len(words):
                                continue  # all shared seeds together cover too little
                            marks = tiles(words, hashes, shortest)
                            matched = sum(m[2] for m in marks)
                            if marks and matched >= coverage * len(words):
                                out.append((doc, item, len(marks), marks[0][2], matched, len(words), matched / len(words)))
                if not out:
                    return None
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, names)

            return step

        return read.mapInArrow(by_batch(make), schema)

    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        found = found.unionByName(found_in(block))
    return found.withColumnsRenamed({"doc": key, "item": item_key})
