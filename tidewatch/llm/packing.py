"""Bounded-space online best-fit packing of token sequences.

Every text is tokenized once, where it is read; only lengths and checksums of
its pieces go on. Pieces are dealt to tasks by a hash and packed as they come:
a fixed number of bins is open, their free spaces are bits of one integer, and
the lowest set bit at or above a piece's length is the best fit. When too many
are open, the fullest closes. The pieces of the bins that are still open at a
task's end meet in a second round, the longest first, so that splitting the work
over many tasks leaves no half-empty bins behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_batch, keep, texts_of
from tidewatch.llm.transducer import compiled

PIECES = "doc long, piece int, start long, length long, crc long"


class BestFit:
    """Bins of ``capacity``; at most ``most_open`` are open."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.free_bits, self.open_count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
            if self.open_count >= self.most_open and length < self.capacity:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        if left := free - length:
            self.by_free[left].append(bin_id)
            self.free_bits |= 1 << left
            self.open_count += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.open_count -= 1
        return bin_id

    def still_open(self) -> set[int]:
        return {b for bins in self.by_free for b in bins}


def token_pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, piece, start, length, crc) of every text's ids with ``end_id`` after them, cut if longer than ``capacity``."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        machine = compiled(source.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            runs = machine.run(texts_of(batch, "text"), with_ids=True)
            for doc, (_, ids) in zip(batch.column("doc").to_pylist(), runs, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, length = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[start : start + length])))
                    start, length = start + length, capacity
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc", "piece", "start", "length", "crc"])

        return step

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(by_batch(make), PIECES)


def _packed(pieces: DataFrame, capacity: int, most_open: int, round_no: int) -> DataFrame:
    """Add sequence, offset and whether the sequence was still open at the task's end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, most_open)
        first = (TaskContext.get().partitionId() << 36) + (round_no << 60)
        held = []
        for batch in batches:
            if batch.num_rows:
                at = [bins.put(n) for n in batch.column("length").to_pylist()]
                held.append((batch, np.array([b for b, _ in at], np.int64), np.array([o for _, o in at], np.int64)))
        still_open = np.array(sorted(bins.still_open()), np.int64)
        for batch, bin_ids, offsets in held:
            added = [pa.array(bin_ids + first), pa.array(offsets), pa.array(np.isin(bin_ids, still_open))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "sequence", "offset", "open"])

    return pieces.mapInArrow(run, f"{PIECES}, sequence long, offset long, open boolean")


def pack_best_fit(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 1024,
    end_id: int = 2,
    most_open: int = 512,
    task_pieces: int = 50_000,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pack all texts into as few sequences of at most ``capacity`` tokens as best-fit finds.

    A document is its tokens and ``end_id``; only longer ones are cut, the first
    piece being the short one. Returns per piece: ``key``, piece, start, length,
    ids_crc32, sequence_id, offset.

    Null and empty texts are documents of one token. Null and repeated keys are
    documents of their own (equal rows can't be told apart in the result). Other
    columns are not read; no rows give no rows. A task packs about ``task_pieces``
    pieces, ``most_open`` bins open at a time in the first round; the second round
    holds only what the first left open, and closes no bin early.
    """
    pieces = keep(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, key=key, text=text), "pieces")

    def dealt(part: DataFrame, *order) -> DataFrame:
        tasks = max(1, -(-part.count() // task_pieces))
        return part.repartition(tasks, F.xxhash64("doc", "piece", "crc", "start")).sortWithinPartitions(*order)

    mixed = F.xxhash64("doc", "piece", "crc")
    first = keep(_packed(dealt(pieces, mixed, "doc", "piece"), capacity, most_open, 0), "packed")
    again = first.filter("open").select("doc", "piece", "start", "length", "crc")
    second = _packed(dealt(again, F.desc("length"), "doc", "piece", "crc"), capacity, 2 * task_pieces, 1)
    return first.filter("not open").unionByName(second).select(
        F.col("doc").alias(key),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"),
        "offset",
    )
