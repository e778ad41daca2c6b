"""Byte-pair tokenizers as deterministic finite-state transducers.

The tokenizer file is compiled into two machines that run as one:

* The splitter has eight states over nine symbols and cuts text into pieces,
  which the merges never cross. A symbol is a character's class together with
  what the split pattern looks ahead for (white space after white space, the
  letters of a contraction), so the machine is deterministic. A transition that
  opens a piece closes the one before it.
* The lexicon's state is the piece read so far. Its transitions are affine maps
  modulo 2^64, ``state * B + value(character)``, and a closing transition emits
  the number (or the ids) of the tokens of the state it leaves. That annotation
  is compiled when a state is first left, by the tokenizer's own merges, and
  kept for the rest of the worker's life in sorted arrays of bounded size.

Text is run in chunks side by side. Each chunk is first run from every state,
which gives its state map; maps are composed by a parallel prefix scan, which
gives each chunk's true first state; a second run emits. The affine maps of the
lexicon compose by a running sum in the same way. A document longer than a block
goes on where a piece opened, so memory is bounded whatever its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex
import tiktoken

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, WHITE_LAST, WHITE, RESET = range(9)
SYMBOLS = 9
# States: next opens a piece; in letters, numbers, others, white space; after a
# leading space; one and two letters of a contraction to come.
OPEN, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, JOINED, ONE_MORE, TWO_MORE = range(8)
STATES = 8
# The contractions of the split pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SEPARATOR, SPECIAL = 0x110000, 0x110001  # beyond all characters: between texts; one special token
CHUNK = 256
TAIL = 16
BLOCK = 1 << 20
MOST_PIECES = 1 << 21
_MULTIPLIER = 0x9E3779B97F4A7C15


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece opens, at state * SYMBOLS + symbol."""
    goes, opens = np.zeros((STATES, SYMBOLS), np.intp), np.ones((STATES, SYMBOLS), bool)
    fresh = {
        LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE,
        SPACE_LAST: JOINED, WHITE_LAST: OPEN, WHITE: IN_WHITE, RESET: OPEN,
    }
    for state in range(STATES):
        for symbol, to in fresh.items():
            goes[state, symbol] = to
    on = [(IN_LETTER, LETTER, IN_LETTER), (IN_NUMBER, NUMBER, IN_NUMBER), (IN_WHITE, WHITE, IN_WHITE)]
    on += [(s, x, IN_OTHER) for s in (IN_OTHER, JOINED) for x in (OTHER, SHORT, LONG)]
    on += [(JOINED, LETTER, IN_LETTER), (JOINED, NUMBER, IN_NUMBER)]
    on += [(ONE_MORE, LETTER, OPEN), (TWO_MORE, LETTER, ONE_MORE)]
    for state, symbol, to in on:
        goes[state, symbol], opens[state, symbol] = to, False
    return goes.ravel(), opens.ravel()


def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other; then the two marks."""
    out = np.full(SPECIAL + 1, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text, at = "".join(map(chr, points)), np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    out[[SEPARATOR, SPECIAL]] = RESET
    return out


def _bytes_of_symbols() -> dict[str, int]:
    """The byte of each printable stand-in that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Compiled from the JSON text of a byte-level BPE tokenizer with the usual split pattern."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or not plain:
            raise ValueError("only plain byte-level BPE tokenizers can be compiled")
        vocab, stand_ins = model["vocab"], _bytes_of_symbols()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids must follow the order of the merges")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(self.specials) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("one plain special token at most")
        ranks = {bytes(stand_ins[c] for c in t): i for t, i in vocab.items() if t not in self.specials}
        self._merge = tiktoken.Encoding("compiled", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.special = next(iter(self.specials), None)
        self.special_id = self.specials.get(self.special, 0)
        self.goes, self.opens = _splitter()
        self.classes = _classes()
        self._reach(BLOCK)
        values = np.arange(1, SPECIAL + 2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        self.values = values * np.uint64(0xD6E8FEB86659FD93)
        self._forget()

    def _reach(self, n: int) -> None:
        """Powers of the multiplier and of its inverse."""
        self.powers, self.inverses = np.full((2, n + 1), _MULTIPLIER, np.uint64)
        self.inverses[:] = pow(_MULTIPLIER, -1, 1 << 64)
        self.powers[0] = self.inverses[0] = 1
        np.cumprod(self.powers, out=self.powers)
        np.cumprod(self.inverses, out=self.inverses)

    def _forget(self) -> None:
        self.states = np.zeros(0, np.uint64)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        symbols = self.classes[points]
        white = symbols == WHITE
        last = white.copy()
        last[:-1] &= ~white[1:] & (symbols[1:] != RESET)
        last[-1:] = False
        symbols[last] = WHITE_LAST
        symbols[last & (points == 32)] = SPACE_LAST
        marks = np.flatnonzero(points[:-1] == 39)
        if len(marks):
            first, second = points[marks + 1], points[np.minimum(marks + 2, len(points) - 1)]
            second = np.where(marks + 2 < len(points), second, SEPARATOR)
            for c in CONTRACTIONS:
                hit = first == ord(c[0])
                if len(c) == 2:
                    hit &= second == ord(c[1])
                symbols[marks[hit]] = SHORT if len(c) == 1 else LONG
        return symbols

    def _maps(self, lanes: np.ndarray) -> np.ndarray:
        """End state of each lane from each first state."""
        maps = np.tile(np.arange(STATES), (lanes.shape[1], 1))
        for column in lanes:
            maps *= SYMBOLS
            maps += column[:, None]
            maps = self.goes.take(maps)
        return maps

    def _opened(self, symbols: np.ndarray) -> np.ndarray:
        """Where pieces open, by chunk maps, their prefix scan and a second run.

        If a chunk's last symbols lead to one state from every state, so does the
        whole chunk; only the others are run in full for their map.
        """
        n = len(symbols)
        chunks = -(-n // CHUNK)
        lanes = np.full(chunks * CHUNK, RESET, np.intp)
        lanes[:n] = symbols
        lanes = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
        maps = self._maps(lanes[-TAIL:])
        split = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
        maps[split] = self._maps(lanes[:, split])
        reach = 1
        while reach < chunks:  # map of chunks i - reach + 1 to i, after those before
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
            reach *= 2
        state = np.zeros(chunks, np.intp)
        state[1:] = maps[:-1, OPEN]
        opened = np.empty((CHUNK, chunks), bool)
        for i, column in enumerate(lanes):
            state *= SYMBOLS
            state += column
            self.opens.take(state, out=opened[i])
            state = self.goes.take(state)
        return opened.T.reshape(-1)[:n]

    def _compile(self, states: np.ndarray, pieces: list[bytes]) -> None:
        """Annotate new lexicon states with their tokens."""
        found = [self._merge(p) for p in pieces]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))])
        at = np.searchsorted(self.states, states)
        self.states = np.insert(self.states, at, states)
        self.starts, self.counts = np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def _emit(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, where its ids start in ``self.ids`` and how many they are."""
        if len(points) > len(self.powers):
            self._reach(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.values[points] * self.powers[: len(points)], out=sums[1:])
        states = (sums[ends] - sums[begins]) * self.inverses[begins]
        distinct, first, back = np.unique(states, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.states, assume_unique=True)
        if len(self.states) + new.sum() > MOST_PIECES:
            self._forget()
            new[:] = True
        if new.any():
            spans = zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._compile(distinct[new], [points[b:e].tobytes().decode("utf-32-le").encode() for b, e in spans])
        at = np.searchsorted(self.states, distinct)[back]
        return self.starts[at], self.counts[at]

    def _parts(self, text: bytes) -> Iterator[np.ndarray]:
        """Code points of a text, special tokens as SPECIAL."""
        parts = text.decode().split(self.special) if self.special else [text.decode()]
        for i, part in enumerate(parts):
            if i:
                yield np.array([SPECIAL], np.uint32)
            if part:
                yield np.frombuffer(part.encode("utf-32-le"), np.uint32)

    def run(self, texts: Iterable[bytes], with_ids: bool) -> Iterator[tuple[int, np.ndarray | None]]:
        """(number of tokens, ids if asked for) of each text, in order. A block is some short texts or a part of a long one."""
        block: list[np.ndarray] = []
        size = 0
        for text in texts:
            for part in (*self._parts(text), np.array([SEPARATOR], np.uint32)):
                block.append(part)
                size += len(part)
            if size >= BLOCK // 2:
                yield from self._run_block(np.concatenate(block), with_ids)
                block, size = [], 0
        if block:
            yield from self._run_block(np.concatenate(block), with_ids)

    def _run_block(self, points: np.ndarray, with_ids: bool) -> Iterator[tuple[int, np.ndarray | None]]:
        """Whole texts, each followed by a separator."""
        total, ids, limit = 0, [], BLOCK
        while len(points):
            used = points[:limit]
            begins = np.flatnonzero(self._opened(self._symbols(used)))
            ends = np.append(begins[1:], len(used))
            if len(used) < len(points):  # the last pieces may depend on what follows
                cut = int(begins[begins <= len(used) - 4][-1])
                if cut == 0:
                    limit *= 2
                    continue
                ends, begins = ends[begins < cut], begins[begins < cut]
                points = points[cut:]
            else:
                points = points[len(used) :]
            limit = BLOCK
            first = used[begins]
            plain, special = first < SEPARATOR, first == SPECIAL
            starts, counts = np.zeros(len(begins), np.int64), special.astype(np.int64)
            if plain.any():
                starts[plain], counts[plain] = self._emit(used, begins[plain], ends[plain])
            upto = np.cumsum(counts)
            if with_ids:
                at = np.arange(upto[-1]) + np.repeat(starts - (upto - counts), counts)
                flat = np.full(len(at), self.special_id, np.uint32)
                known = ~np.repeat(special, counts)
                flat[known] = self.ids[at[known]]
            done = 0
            for end in upto[first == SEPARATOR].tolist():
                if with_ids:
                    ids.append(flat[done:end])
                yield total + end - done, np.concatenate(ids) if with_ids else None
                total, ids, done = 0, [], end
            total += int(upto[-1]) - done
            if with_ids:
                ids.append(flat[done:])


_compiled: dict[int, Transducer] = {}


def compiled(source: str) -> Transducer:
    """One transducer a worker for each tokenizer."""
    if (k := hash(source)) not in _compiled:
        _compiled.clear()
        _compiled[k] = Transducer(source)
    return _compiled[k]
