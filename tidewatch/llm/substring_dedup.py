"""Substring dedup: recurring passages are confirmed, compiled into automata and located.

A window is ``window`` consecutive words. It goes if its words also start in a
document with a smaller doc_id.

1. Phrases. Of the 8-word phrases in a window the one with the least hash is the
   window's anchor, so equal windows have equal anchors; about one word in
   twenty starts an anchor. Anchors that occur in two different texts recur. Exact
   copies of a text need nothing more: the first stands for all.
2. Confirmation. All documents are dealt to shards of bounded text. A shard
   counts its windows whose anchor recurs, and sums over the shards find those in
   two documents: recurring passages, owned by the smallest doc_id. Each shard is
   told the owners of its own windows only.
3. Automata. A shard compiles its recurring phrases into one Aho-Corasick
   automaton over words and streams its documents through it once. The windows
   around each occurrence are looked up among the confirmed ones; where the owner
   is a smaller doc_id, their words are removed.

Windows are told apart by 64 bits within a shard's few hundred thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_batch, keep, texts_of, tidy
from tidewatch.llm.words import run_hashes, word_hashes

PHRASE = 8
_POSITION_BITS = 20
_POSITIONS = np.uint64((1 << _POSITION_BITS) - 1)
_LETTER = np.uint64(0xFFFFFFFF)
EMPTY_SHA = sha256(b"").hexdigest()


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every window by its first word, where its anchor phrase starts: the least phrase hash, the leftmost of equals."""
    phrases = run_hashes(hashes, PHRASE)
    span = window - PHRASE + 1
    count = len(phrases) - span + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    out = []
    part = (1 << _POSITION_BITS) - span
    for at in range(0, count, part):
        least = phrases[at : at + part + span - 1] & ~_POSITIONS
        least |= np.arange(len(least), dtype=np.uint64)
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        out.append((least & _POSITIONS).astype(np.int64) + at)
    return np.concatenate(out)


def _profiles(docs: DataFrame, window: int) -> DataFrame:
    """(doc, text_hash, n_words, sha, bytes, anchors) of every row."""
    schema = "doc long, text_hash long, n_words long, sha string, bytes long, anchors array<long>"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, sizes, found = [], [], [], []
            for text in texts_of(batch, "text"):
                words = text.split()
                hashes = word_hashes(text)
                at = np.unique(anchors(hashes, window))
                counts.append(len(words))
                sizes.append(len(text))
                digests.append(sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(run_hashes(hashes, PHRASE)[at]).view(np.int64))
            arrays = [batch.column("doc"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(digests)]
            arrays += [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc", "text_hash", "n_words", "sha", "bytes", "anchors"])

        return step

    return docs.mapInArrow(by_batch(make), schema)


def _spans(starts: np.ndarray, length: int, count: int) -> np.ndarray:
    """Which of ``count`` places lie in a span of ``length`` from one of ``starts``."""
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, np.maximum(starts, 0), 1)
    np.add.at(steps, np.minimum(starts + length, count), -1)
    return np.cumsum(steps[:-1]) > 0


def _shard_windows(stream: DataFrame, window: int) -> DataFrame:
    """What each shard holds: its distinct windows with a recurring anchor (window, least and most doc), and their phrases.

    In the stream, sorted by shard and document, a document's recurring anchors
    come before its text.
    """
    schema = "shard int, window long, least long, most long, letters binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, recurring, windows, docs, phrases = None, None, [], [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            if windows:
                every, by = np.concatenate(windows), np.concatenate(docs)
                order = np.lexsort((by, every))
                every, by = every[order], by[order]
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                last = np.append(first[1:], len(every)) - 1
                nothing = pa.nulls(len(first), pa.binary())
                arrays = [pa.array(np.full(len(first), shard, np.int32)), pa.array(every[first].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(by[first]), pa.array(by[last]), nothing], names)
                none = pa.nulls(len(phrases), pa.int64())
                arrays = [pa.array(np.full(len(phrases), shard, np.int32)), none, none, none]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(phrases.values()), pa.binary())], names)
            windows.clear()
            docs.clear()
            phrases.clear()

        names = ["shard", "window", "least", "most", "letters"]
        for batch in batches:
            rows = zip(
                batch.column("shard").to_pylist(),
                batch.column("doc").to_pylist(),
                batch.column("text_hash").to_pylist(),
                batch.column("recurring"),
                texts_of(batch, "text"),
                strict=True,
            )
            for at_shard, doc, text_hash, anchor_list, text in rows:
                if at_shard != shard:
                    yield from flush()
                    shard = at_shard
                if anchor_list.is_valid:
                    recurring = (doc, text_hash, anchor_list.values.to_numpy(zero_copy_only=False).view(np.uint64))
                elif recurring is not None and recurring[:2] == (doc, text_hash):
                    hashes = word_hashes(text)
                    at = anchors(hashes, window)
                    all_phrases = run_hashes(hashes, PHRASE)
                    hit = np.flatnonzero(np.isin(all_phrases[at], recurring[2]))
                    windows.append(np.unique(run_hashes(hashes, window)[hit]))
                    docs.append(np.full(len(windows[-1]), doc, np.int64))
                    letters = (hashes & _LETTER).astype(np.uint32)
                    for p in np.unique(at[hit]).tolist():
                        phrases[int(all_phrases[p])] = letters[p : p + PHRASE].tobytes()
                    recurring = None
        yield from flush()

    return stream.mapInArrow(tidy(run), schema)


class PhraseAutomaton:
    """A shard's recurring phrases and confirmed windows; a word's letter is the low half of its hash."""

    def __init__(self, phrases: list[bytes], windows: np.ndarray, owners: np.ndarray, window: int) -> None:
        order = np.argsort(windows)
        self.window, self.windows, self.owners = window, windows[order], owners[order]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for letters in phrases:
            self.machine.add_word(tuple(np.frombuffer(letters, np.uint32).tolist()), 1)
        self.machine.make_automaton()

    def removed(self, doc: int, hashes: np.ndarray) -> np.ndarray:
        """Which words lie in a passage of a smaller doc_id."""
        gone = np.zeros(len(hashes), bool)
        count = len(hashes) - self.window + 1
        if count <= 0:
            return gone
        ends = np.fromiter((end for end, _ in self.machine.iter(tuple((hashes & _LETTER).tolist()))), np.int64)
        if not len(ends):
            return gone
        reach = self.window - PHRASE + 1
        near = np.flatnonzero(_spans(ends - self.window + 1, reach, len(hashes))[:count])
        own = run_hashes(hashes, self.window)[near]
        at = np.searchsorted(self.windows, own)
        at[at == len(self.windows)] = 0
        found = near[(self.windows[at] == own) & (self.owners[at] < doc)]
        return _spans(found, self.window, len(hashes)) if len(found) else gone


def _located(stream: DataFrame, window: int) -> DataFrame:
    """Run a stream sorted by shard and kind (0 phrases, 1 confirmed windows, 2 documents) through each shard's automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, phrases, windows, owners, machine, before = None, [], [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
                part, kind = batch.slice(begin, end - begin), int(kinds[begin])
                if int(shards[begin]) != shard:
                    shard, phrases, windows, owners, machine = int(shards[begin]), [], [], [], None
                if kind == 0:
                    phrases.extend(part.column("letters").to_pylist())
                elif kind == 1:
                    windows.append(part.column("window").to_numpy().view(np.uint64))
                    owners.append(part.column("owner").to_numpy())
                elif windows:
                    machine = machine or PhraseAutomaton(phrases, np.concatenate(windows), np.concatenate(owners), window)
                    ids = zip(part.column("doc").to_pylist(), part.column("text_hash").to_pylist(), strict=True)
                    for row, text in zip(ids, texts_of(part, "text"), strict=True):
                        if row != before and (gone := machine.removed(row[0], word_hashes(text))).any():
                            kept = b" ".join(w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g)
                            out.append((*row, int(gone.sum()), sha256(kept).hexdigest(), kept.decode()))
                        before = row  # equal rows have one result
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "text_hash", "removed", "kept_sha", "kept"])

    return stream.mapInArrow(tidy(run), "doc long, text_hash long, removed long, kept_sha string, kept string")


def remove_repeats(
    docs: DataFrame, *, window: int = 50, shard_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return ``key``, text_hash, n_words, n_removed, kept_sha256 and kept_text of every row.

    Words are runs of other characters than space and the controls 9 to 13, taken
    unchanged from the whole text. A word goes if a window of ``window`` words over
    it also starts in a row with a smaller ``key``; windows are judged on the input.
    kept_sha256 is of the kept words joined by one space. kept_text has these where
    words were removed, else null; text_hash (of the text) tells rows with one key apart.

    Null and empty texts have no words. Rows with a null key are returned whole
    and are no source for others. Rows with equal keys are no source for each
    other. Texts under ``window`` words stay whole. Other columns are not read;
    no rows give no rows.
    """
    read = docs.select(
        F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )
    profiles = keep(_profiles(read, window), "profiles")
    long_enough = profiles.filter((F.col("n_words") >= window) & F.col("doc").isNotNull())
    first = keep(long_enough.groupBy("sha").agg(F.min("doc").alias("first")), "first-copies")
    with_first = profiles.join(first, "sha", "left").withColumn(
        "copy", F.coalesce((F.col("n_words") >= window) & (F.col("doc") > F.col("first")), F.lit(False))
    )
    sources = keep(
        with_first.filter((F.col("n_words") >= window) & (F.col("doc") == F.col("first")))
        .select("doc", "text_hash", F.explode("anchors").alias("anchor"))
        .distinct(),
        "anchors",
    )
    recurring = keep(
        sources.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("anchor"),
        "recurring",
    )
    involved = keep(
        sources.join(recurring, "anchor")
        .groupBy("doc", "text_hash")
        .agg(F.collect_list("anchor").alias("recurring")),
        "involved",
    )
    total = profiles.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-total // shard_bytes)))).cast("int").alias("shard")
    texts = read.filter("doc IS NOT NULL AND text IS NOT NULL").select(shard, "doc", "text_hash", "text")
    marked = texts.unionByName(involved.select(shard, "*"), allowMissingColumns=True)
    held = keep(
        _shard_windows(
            marked.repartition("shard").sortWithinPartitions("shard", "doc", "text_hash", F.col("recurring").isNull()),
            window,
        ),
        "shard-windows",
    )
    confirmed = keep(
        held.filter("window IS NOT NULL")
        .groupBy("window")
        .agg(F.min("least").alias("owner"), F.max("most").alias("last"))
        .filter("owner < last")
        .select("window", "owner"),
        "confirmed",
    )
    told = held.join(confirmed, "window").filter("most > owner")
    stream = (
        texts.withColumn("kind", F.lit(2))
        .unionByName(told.select("shard", "window", "owner", F.lit(1).alias("kind")), allowMissingColumns=True)
        .unionByName(
            held.filter("letters IS NOT NULL").select("shard", "letters", F.lit(0).alias("kind")), allowMissingColumns=True
        )
        .repartition("shard")
        .sortWithinPartitions("shard", "kind", "doc", "text_hash")
    )
    located = _located(stream, window)
    return (
        with_first.drop("anchors")
        .join(located, ["doc", "text_hash"], "left")
        .select(
            F.col("doc").alias(key),
            "text_hash",
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept_text"),
        )
    )
