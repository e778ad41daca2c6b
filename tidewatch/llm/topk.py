"""Exact top-k inner products on a bit-sliced index.

Vectors are dealt by hash into blocks of bounded size. In a block each attribute
(one dimension's whole number, moved so that its least value is zero) is stored
as bit slices: bitmap i of an attribute has a bit for every row whose value has
bit i set. For a query, an attribute times a weight is the sum of its slices
shifted by the weight's set bits; a negative weight takes the attribute counted
down from its largest value. All shifted slices of all attributes are added by
carry-save adders on whole bitmaps, which gives the score's own slices. The top
rows are picked from the most significant slice downward; when a slice would
leave too few, its rows are taken and the search goes on among the rest, so the
rows left at the end all have the boundary score and go by id.

Each block meets the queries in groups of bounded size; only k rows for each query and
block are shuffled to the final ranking.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import keep

WORD = 64
# Whole numbers up to here can be sliced; a score beyond a long is refused, never wrapped.
LARGEST = 1 << 61
LONG = 1 << 63


class BitSlicedBlock:
    """One block's slices; rows are in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.words = -(-len(ids) // WORD)
        self.exists = self._bitmaps(np.ones((1, len(ids)), bool))[0]
        up, down = values - self.low, self.high - values
        self.up = [self._slices(up[:, d]) for d in range(values.shape[1])]
        self.down = [self._slices(down[:, d]) for d in range(values.shape[1])]

    def _bitmaps(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1, bitorder="little")
        out = np.zeros((len(bits), self.words * 8), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def _slices(self, column: np.ndarray) -> np.ndarray:
        count = int(column.max()).bit_length()
        return self._bitmaps((column[None, :] >> np.arange(count)[:, None]) & 1 == 1)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the score from the least significant up, and the constant to add to it."""
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d, weight in enumerate(query.tolist()):
            constant += weight * int(self.low[d] if weight >= 0 else self.high[d])
            slices = self.up[d] if weight >= 0 else self.down[d]
            weight = abs(weight)
            while weight and len(slices):
                shift = (weight & -weight).bit_length() - 1
                for i in range(len(slices)):
                    columns.setdefault(i + shift, []).append(slices[i])
                weight &= weight - 1
        total, place = [], 0
        while columns and place <= max(columns):
            part = np.array(columns.pop(place, [self.exists ^ self.exists]))
            carries = []
            while len(part) > 1:  # three bitmaps make one here and one at the next place
                whole = len(part) // 3 * 3
                if whole:
                    a, b, c = part[:whole:3], part[1:whole:3], part[2:whole:3]
                    either = a ^ b
                    carries.append((a & b) | (c & either))
                    part = np.concatenate([either ^ c, part[whole:]])
                else:
                    carries.append((part[0] & part[1])[None])
                    part = (part[0] ^ part[1])[None]
            total.append(part[0])
            if carries:
                columns.setdefault(place + 1, []).extend(np.concatenate(carries))
            place += 1
        return total, constant

    def top(self, slices: list[np.ndarray], k: int, allowed: np.ndarray) -> np.ndarray:
        """Positions of the k rows with the largest scores, ties by smaller id."""
        sure, rest = allowed ^ allowed, allowed.copy()
        wanted = min(k, int(np.bitwise_count(allowed).sum()))
        for bits in reversed(slices):
            ones = rest & bits
            count = int(np.bitwise_count(ones).sum())
            if count >= wanted:
                rest = ones
            else:
                sure |= ones
                rest &= ~bits
                wanted -= count
        return np.sort(np.concatenate([_positions(sure), _positions(rest)[:wanted]]))


def _positions(bitmap: np.ndarray) -> np.ndarray:
    """Set bits, from the least."""
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * WORD + bit


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    *,
    scale: int = 64,
    block_rows: int = 16_384,
    group_queries: int = 512,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Return query_id, rank, vec_id and score of each query's ``k`` largest integer inner products.

    A component x counts as floor(``scale`` * x). ``queries`` has the columns of
    ``vectors``. Candidates are all rows of ``vectors`` of the query's length but
    those with its id; ties go to the smaller id; a query with fewer candidates
    gets all of them.

    Rows with a null id or vector, or with a null or non-finite component, take no
    part. All others do: scores are compared by as many slices as they need. A
    component whose whole number is 2^61 or more either way, and a score among the
    results that a long can't hold, end the query with an error. Equal rows count each, as
    candidates and as queries of one id (their results then repeat). Other
    columns are not read; no queries or no candidates give no rows.
    """

    def whole(df: DataFrame) -> DataFrame:
        def scaled(x: Column) -> Column:
            return x.cast("double") * F.lit(float(scale))

        large = F.raise_error(F.lit("top_k: a component is too large for a score")).cast("long")
        parts = F.transform(
            vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(float(LARGEST)), F.floor(scaled(x))).otherwise(large)
        )
        fits = F.forall(
            vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
        )
        valid = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fits)
        return valid.select(F.col(key).cast("long").alias("id"), parts.alias("v"), F.size(vector).alias("size"))

    rows, asked = keep(whole(vectors), "vectors"), keep(whole(queries), "queries")
    blocks = max(1, -(-rows.count() // block_rows))
    groups = max(1, -(-asked.count() // group_queries))
    # Both sides need keys of one type: cogrouped rows meet by the hash of the typed key.
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # A block is copied to each group of queries and a group to each block: both are of bounded size.
    left = rows.withColumn("block", block).withColumn("group", every(groups))
    right = asked.withColumn("group", group).withColumn("block", every(blocks))

    def search(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(wanted):
            index = BitSlicedBlock(candidates["id"].to_numpy(), np.stack(candidates["v"]).astype(np.int64))
            for query_id, query in zip(wanted["id"], wanted["v"], strict=True):
                slices, constant = index.scores(query)
                allowed = index.exists.copy()
                first, last = np.searchsorted(index.ids, [query_id, query_id + 1])
                for own in range(first, last):
                    allowed[own // WORD] &= ~np.uint64(1 << (own % WORD))
                top = index.top(slices, k, allowed)
                # Python's whole numbers where a long might not hold the sum of slices.
                kind = np.int64 if len(slices) < 62 and abs(constant) < LONG >> 1 else object
                score = np.full(len(top), constant, kind)
                for place, bits in enumerate(slices):
                    score += (((bits[top // WORD] >> (top % WORD).astype(np.uint64)) & np.uint64(1)).astype(kind)) << place
                if kind is object:
                    if any(not -LONG <= s < LONG for s in score):
                        raise OverflowError(f"top_k: a score of query {query_id} is beyond a long")
                    score = score.astype(np.int64)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": index.ids[top], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ("size", "block", "group")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
