"""Every operator against brute force on small tables with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import decontamination, langid, packing, sharding, simhash, substring_dedup, token_counts, topk, url_filter, warc
from tidewatch.llm.common import ready
from tidewatch.llm.transducer import Transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, size long, shard int, n_words long, fp long, kind string"


def _words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text) with copies, near copies, shared passages, blanks, nulls and repeated rows."""
    rng = random.Random(5)
    passage, long_text = _words(rng, 80), _words(rng, 3000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (None, passage), (6, "a " * 300), (7, "a " * 120)]
    rows += [(10, passage), (11, _words(rng, 30) + " " + passage + " " + _words(rng, 30)), (12, passage.replace(" ", "\n"))]
    rows += [(13, long_text), (14, long_text + " tail"), (15, "head " + long_text), (16, "Ünï 中文 <|endoftext|> don't  x\r\n")]
    rows += [(20 + i, _words(rng, rng.randrange(1, 200))) for i in range(40)]
    rows += [(100 + i, rows[-1 - i][1]) for i in range(10)]
    return [*rows, rows[-1], (10, passage)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en", 1, 2, 3, 4, "x") for d, t in texts]
    return ready(spark).createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return ready(spark).createDataFrame([], COLUMNS)


def _split(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, empty, texts):
    starts = defaultdict(set)
    for d, t in texts:
        w = _split(t)
        for i in range(len(w) - 49):
            if d is not None:
                starts[tuple(w[i : i + 50])].add(d)
    want = Counter()
    for d, t in texts:
        w = _split(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and min(starts[tuple(w[i : i + 50])]) < d:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.remove_repeats(docs, shard_bytes=5000).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_anchor_positions_agree_across_parts(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64)
    whole = substring_dedup.anchors(hashes, 50)
    phrases = substring_dedup.run_hashes(hashes, substring_dedup.PHRASE)
    assert all(phrases[a] >> 20 == (phrases[i : i + 43] >> 20).min() and i <= a < i + 43 for i, a in enumerate(whole))


def _tiled(item, doc, shortest):
    """Greedy string tiling by comparing every pair of places."""
    used_i, used_d, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < min(shortest, len(item)) or not n:
            return total
        used_i.update(range(i, i + n))
        used_d.update(range(j, j + n))
        total += n


def test_tiles_equal_brute_force_greedy_tiling():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        doc = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        a, b = (np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (item, doc))
        found = decontamination.tiles(a, b, 3)
        assert len({i + k for i, _, n in found for k in range(n)}) == sum(n for _, _, n in found)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in found)
        assert not found or found[0][2] == max(n for _, _, n in found)
        assert (sum(n for _, _, n in found) >= 3) == (_tiled(item, doc, 3) >= 3) or len(item) < 3


def test_leaks_find_reordered_items(spark, docs, empty):
    rng = random.Random(9)
    first, second = _words(rng, 12, 9999), _words(rng, 12, 9999)
    rows = [(1, f"x y {second} z {first.upper()} q"), (2, first[:20]), (3, None), (None, first + " " + second), (4, "")]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{first} {second}", 1), (8, None, 1), (9, " ", 1), (10, "q", 1)], "item_id long, text string, doc long")
    for words in (1_000_000, 10):
        got = decontamination.leaked_items(some, items, block_words=words).select("doc_id", "item_id", "n_tiles", "matched_words")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 7, 2, 24), (1, 10, 1, 1), (None, 7, 1, 24)], key=repr)
    assert decontamination.leaked_items(empty, items).count() == 0
    assert decontamination.leaked_items(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards(docs, empty, texts, shards):
    rows = sharding.shard_by_bytes(docs, shards, piece_rows=7).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in texts)
    total, largest = sum(size(t) for _, t in texts), max(size(t) for _, t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / shards * 1.01 + largest
    assert set(by) <= set(range(shards)) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert sharding.shard_by_bytes(empty).count() == 0


def test_shards_split_a_text_with_many_copies(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("copy of one text").alias("text"))
    sizes = sharding.shard_by_bytes(same, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(sizes) == 8 and max(r.n for r in sizes) < 1.02 * 4000 * 17 / 8


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _reached(values, radius):
    """Smallest id that each (id, value) reaches."""
    root = {i: i for i, _ in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(values):
        for j, b in values[:n]:
            if (a ^ b).bit_count() <= radius:
                one, other = find(i), find(j)
                root[max(one, other)] = min(one, other)
    return {i: find(i) for i, _ in values}


@pytest.mark.parametrize("most", [2048, 2])
def test_simhash_components(docs, empty, texts, most):
    marks = [(d, _fingerprint(t)) for d, t in texts]
    want = _reached(list({m: None for m in marks if m[0] is not None}), 3)
    got = simhash.simhash_components(docs, most=most).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, f"{m:016x}") for d, m in marks)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.simhash_components(empty).count() == 0


def test_trees_lose_no_link_among_close_fingerprints(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = [centre]
    while len(values) < 300:
        values.append(rng.choice(values) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))))
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(dict.fromkeys(values))]
    table = ready(spark).createDataFrame(rows, "node long, fp long")
    for most in (4000, 20):
        edges = simhash.tree_edges(simhash._shards(table, most), 3)
        root = {r.node: r.root for r in simhash.components(edges).collect()}
        assert {i: root.get(i, i) for i, _ in rows} == _reached([(i, v & (1 << 64) - 1) for i, v in rows], 3)


def test_near_duplicates(spark, empty):
    rng = random.Random(4)
    base = _words(rng, 300, 5000).split()
    changed = base.copy()
    changed[100] = "other"
    far = [w if i % 4 else "z" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(far)), (4, " ".join(base).upper()), (5, None), (6, ""), (None, "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, None: None}
    assert simhash.near_duplicates(empty).count() == 0


def _paired(rng, shared, one, other):
    """Two texts of the shared shingles' words and as many further words each."""
    words = _words(rng, shared + 4, 10**6)
    return words + " " + _words(rng, one, 10**6), words + " " + _words(rng, other, 10**6)


def test_near_duplicates_at_the_limit_and_with_repeated_lines(spark):
    """Similarity 0.80 to 0.82, and equal distinct shingles with a line that one text repeats far more often."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        rows += zip((4 * i, 4 * i + 1), _paired(rng, 82 - i % 2, 9 + i % 2, 9), strict=True)
        if i < 20:
            text, line = _words(rng, 300, 10**6), _words(rng, 12, 10**6)
            rows += [(4 * i + 2, f"{text} {line} {line}"), (4 * i + 3, " ".join([text] + [line] * 22))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in rows}


def test_near_duplicates_behind_closer_looking_rivals(spark):
    """Families of texts about 0.75 alike, each with one pair at 0.81 that sketches often rank behind others."""
    rng = random.Random(31)
    rows, want = [], {}
    for family in range(8):
        base = _words(rng, 300, 10**6)
        own = [_words(rng, 49, 10**6).split() for _ in range(60)]
        own[59][:14] = own[30][:14]
        for i, words in enumerate(own):
            doc = 100 * family + i
            rows.append((doc, f"{base} {' '.join(words)}"))
            want[doc] = doc - 29 if i == 59 else doc
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_under_one_shared_template(spark, monkeypatch):
    """150 pairs 0.85 alike among texts that are 0.6 alike by a shared passage; trees are far over BLOCK."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    monkeypatch.setattr(simhash, "HEADS", 4)
    rng = random.Random(77)
    template, rows = _words(rng, 154, 10**6), []
    for i in range(150):
        words = _words(rng, 50, 10**6).split()
        changed = words[:34] + _words(rng, 16, 10**6).split()
        rows += [(2 * i, f"{template} {' '.join(words)}"), (2 * i + 1, f"{template} {' '.join(changed)}")]
    texts = ready(spark).createDataFrame(rows, "doc long, text string")
    trees = simhash._prefix_trees(texts, 5, 0.8).collect()
    members = defaultdict(set)
    for r in trees:
        members[r.tree].add(r.node)
    assert all(any({2 * i, 2 * i + 1} <= m for m in members.values()) for i in range(150))
    assert max(map(len, members.values())) <= 20
    got = simhash.near_duplicates(texts.withColumnRenamed("doc", "doc_id")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in rows}


def test_near_duplicates_of_a_group_larger_than_a_tree(spark, monkeypatch):
    """A third of the rows are near copies of one text; trees are cut to blocks, components are those of brute force."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    monkeypatch.setattr(simhash, "HEADS", 4)
    rng = random.Random(8)
    base, rows = _words(rng, 120, 5000).split(), []
    for i in range(400):
        if i % 3 == 0:
            words = base.copy()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        elif i % 7 == 1:
            words = [*rows[-1][1].split(), "end"] if rows else base
        else:
            words = _words(rng, rng.randrange(3, 60), 5000).split()
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_near_duplicates_start_from_fingerprint_trees(spark, monkeypatch):
    """Two texts whose fingerprints BK-trees link but which share no minimum hash are compared, by their exact similarity."""
    dealt = []
    monkeypatch.setattr(simhash, "tree_edges", lambda shards, radius, real=simhash.tree_edges: dealt.append(radius) or real(shards, radius))
    monkeypatch.setattr(simhash, "_minima", lambda hashes: hashes[:1].repeat(8) ^ np.arange(8, dtype=np.uint64))
    rng = random.Random(6)
    words = _words(rng, 400, 10**6).split()
    changed = sorted(([*words[:k], f"w{n}", *words[k + 1 :]] for k in (0, 399) for n in range(40)), key=lambda w: min(simhash._runs(" ".join(w).encode(), 5)))
    rows = [(i, " ".join(w)) for i, w in enumerate((words, changed[0], changed[-1]))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert dealt == [3] and {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0}


def test_a_shard_yields_joining_links_only():
    """As many links as join its parts, not its pairs; exactly at the limit."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 96).astype(np.uint64)
    near = [np.unique(np.concatenate([base, rng.integers(1, 1 << 62, 4).astype(np.uint64)])) for _ in range(60)]
    far = [np.unique(np.concatenate([base[:84], rng.integers(1, 1 << 62, 16).astype(np.uint64)])) for _ in range(60)]
    nodes, sides = np.arange(60), np.full(60, simhash.OWN)
    assert len(list(simhash._joining(sides, nodes, nodes, near, 0.8))) == 59
    assert not list(simhash._joining(sides, nodes, nodes, far, 0.8))
    assert list(simhash._joining(sides[:2], nodes[:2], nodes[:2], [base[:80], base], 80 / 96)) == [(0, 1)]
    assert not list(simhash._joining(sides[:2], nodes[:2], nodes[:2], [base[:79], base], 80 / 96))


def test_transducer_equals_the_library(monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        machine = Transducer(f.read())
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    bits = ["a", "s", "t", "'", "'re", "'v", " ", "  ", "\n", "\t", "1", "é", "²", "中", "!", "<|endoftext|>", "　", "ll", "\x85", "\x1c", "😀", "Ⅷ", "_"]
    some = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["a" * 9000, " " * 5000 + "x", "ab 'll" * 3000]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    for block in (1 << 20, 2000):
        monkeypatch.setattr("tidewatch.llm.transducer.BLOCK", block)
        got = list(machine.run((t.encode() for t in some), with_ids=True))
        assert [n for n, _ in got] == [len(w) for w in want]
        assert all(g.tolist() == w for (_, g), w in zip(got, want, strict=True))
    monkeypatch.setattr("tidewatch.llm.transducer.MOST_PIECES", 50)
    assert [n for n, _ in machine.run((t.encode() for t in some), with_ids=False)] == [len(w) for w in want]


def test_token_counts(docs, empty, texts):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, token_counts.token_counts(docs, PATH).collect())) == want
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_packing(docs, empty, texts):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, length, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while start < len(ids):
            want[d, piece, start, length, zlib.crc32(ids[start : start + length])] += 1
            start, length, piece = start + length, 1024, piece + 1
    rows = packing.pack_best_fit(docs, PATH, most_open=4, task_pieces=20).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert packing.pack_best_fit(empty, PATH).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.put(9) == (2, 0) and bins.put(8) == (3, 0)  # bin 2 is the fullest and closes
    assert bins.still_open() == {0, 3} and bins.put(2) in ((0, 8), (3, 8))  # both have 2 free


def test_language_model(spark, empty):
    rng = random.Random(6)
    words = {"en": ["the", "and", "of", "with"], "fr": ["été", "que", "où", "leçon"], "de": ["über", "nicht", "schön", "und"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(["en", "fr", "de"] * 60)]
    rows += [(500, None, "en"), (501, "", "fr"), (502, "123 !", "de"), (None, "the and of", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table.filter(~langid.held_out(F.col("doc_id"))), steps=80)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, model).collect()}
    assert sum(got[i][0] == k for i, _, k in rows[:180]) >= 175
    assert [got[i][0] for i in (500, 501, 502)] == ["und"] * 3 and got[None][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(empty, model).count() == 0
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(table, none).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the cat and the dog number {i} went over the hill", "en") for i in range(6000)]
    rows += [(9000 + i, f"le chat noir et le chien {i} sont dans la maison bleue", "fr") for i in range(2)]
    rows += [(9100, "", "xx"), (9101, None, "yy"), (9000, "le chat noir et le chien 0 sont dans la maison bleue", "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, sample=300, steps=120)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(table.filter("doc_id < 100 OR doc_id >= 9000"), model).collect()}
    assert got[9000] == got[9001] == "fr" and {got[i] for i in range(100)} == {"en"}


def test_training_windows_span_whole_texts(spark):
    texts = [b"x", b"y" * 64, b"z" * 65, bytes(range(256)) * 40 + b"end"]
    table = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id int, bytes binary")
    got = {r.id: [bytes(w) for w in r.w] for r in table.select("id", langid._spaced("bytes", 1024).alias("w")).collect()}
    assert got[0] == [texts[0]] and got[1] == [texts[1]] and got[2] == [texts[2][:64], b"z"]
    long = texts[3]
    assert len(got[3]) == 16 and got[3][0] == long[:64] and got[3][-1] == long[-64:]
    assert got[3] == [long[i * (len(long) - 64) // 15 :][:64] for i in range(16)]


def test_network_equals_plain_forward_pass():
    """Byte by byte in plain Python, over a text of more than one group of lanes."""
    network = langid.ByteGRU(2, 3, seed=4)
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 123, 64 * 4096 + 70).astype(np.uint8))
    p = {k: v.astype(float) for k, v in network.params.items()}
    pooled = np.zeros(2)
    for begin in [*range(0, 640, 64), *range(64 * 4095, len(text), 64)]:
        window = text[begin : begin + 64].ljust(64, b" ")
        both = {}
        for way in "fb":
            state, states = np.zeros(3), {}
            for t in range(64) if way == "f" else reversed(range(64)):
                given = p[f"in_{way}"][window[t]]
                reset, update = np.split(np.clip(0.25 * (given[:6] + state @ p[f"gates_{way}"]) + 0.5, 0, 1), 2)
                fresh = np.clip(given[6:] + (reset * state) @ p[f"new_{way}"], -1, 1)
                state = states[t] = update * state + (1 - update) * fresh
            both[way] = states
        for t in range(min(64, len(text) - begin)):
            power = np.exp(np.concatenate([both["f"][t], both["b"][t]]) @ p["out"] + p["out_bias"])
            pooled += power / power.sum()
    kept = text[:640] + text[64 * 4095 :]
    (name, score), = langid.LanguageModel(["a", "b"], network).predict([kept])
    assert name == "ab"[int(pooled.argmax())] and abs(score - pooled.max() / len(kept)) < 1e-4
    whole, = langid.LanguageModel(["a", "b"], network).predict([text])
    parts = [langid.LanguageModel(["a", "b"], network).predict([t])[0] for t in (text[: 64 * 4096], text[64 * 4096 :])]
    share = sum((s if n == whole[0] else 1 - s) * len(t) for (n, s), t in zip(parts, (text[: 64 * 4096], text[64 * 4096 :]), strict=True))
    assert abs(whole[1] - share / len(text)) < 1e-4


def test_gradients_equal_differences():
    network = langid.ByteGRU(3, 4, seed=1)
    for k in network.params:
        network.params[k] = network.params[k].astype(np.float64)
    rng = np.random.default_rng(2)
    lanes, labels, real = rng.integers(0, 256, (12, 5)), rng.integers(0, 3, 5), np.ones((12, 5))
    _, grads = network.gradients(lanes, labels, real)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = network.params[k][at]
        sides = []
        for step in (1e-3, -1e-3):
            network.params[k][at] = kept + step
            sides.append(network.gradients(lanes, labels, real)[0])
        network.params[k][at] = kept
        assert abs((sides[0] - sides[1]) / 2e-3 - g[at]) < 1e-2 * max(1, abs(g[at])), k


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_top_k(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)], 0) for i in range(300)]
    vectors += [(300 + i, [0.5] * 8, 0) for i in range(60)] + [(0, [0.1] * 8, 0)]
    bad = [(900, None, 0), (901, [None] * 8, 0), (902, [float("nan")] * 8, 0), (903, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (904, [1.0] * 3, 0)]
    table = ready(spark).createDataFrame(vectors + bad, "vec_id long, embedding array<float>, block int")
    asked = table.filter("vec_id % 20 = 0 AND vec_id > 0")
    got = topk.top_k(table, asked, 20, block_rows=50, group_queries=7).collect()
    whole = {}
    rows = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in vectors]
    for q, v in rows:
        if q % 20 == 0 and q > 0:
            ranked = sorted((-int(v @ w), i) for i, w in rows if i != q)[:20]
            whole[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in found.items()} == whole
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert topk.top_k(table.limit(0), asked).count() == 0 and topk.top_k(table, asked.limit(0)).count() == 0


def test_top_k_keeps_vectors_with_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, size, 8))]) for i, size in enumerate([0.2, 3e5, 1e7] * 20)]
    rows += [(100, [3e6, -1e6] * 4), (101, [1e16, 0.0] + [0.0] * 6), (102, [0.0] * 8), (103, [float("nan")] * 8)]
    table = ready(spark).createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.filter("vec_id IN (2, 7, 100, 102)")
    want = set()
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i != 103]
    for q, v in whole:
        if q in (2, 7, 100, 102):
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i not in (q, 101))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    small = table.filter("vec_id <> 101")
    assert {tuple(r) for r in topk.top_k(small, asked, 5, block_rows=20).collect()} == want
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(table, asked, 5).collect()


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/a", "allow"), (None, "/", "block"), ("", "/", "block")]
    urls = [None, "", "nothing", "http://", "http://EXAMPLE.com/en/1", "https://www.example.com/en/x?q#f", "http://example.com", "http://xexample.com/en/"]
    urls += ["http://a.b.net/es/", "http://net/es/abc", "x://y://z", "http://com./en/", "http://a-b.com/", "http://u.com/?a://b.net/es/", "http://example.com/en/1"]
    table = spark.createDataFrame([(i if i else None, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = url_filter.judge_urls(table, spark.createDataFrame(rules, "host string, path string, verdict string"), slice_rows=3)

    def judged(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:end].lower(), rest[end:]
            path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
        fits = [r for r in rules if r[0] and ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (r[0].count("."), len(r[1])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    assert Counter(map(tuple, got.collect())) == Counter((i if i else None, *judged(u)) for i, u in enumerate(urls))
    assert url_filter.judge_urls(table.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_warc_round_trip(spark):
    mark = "\r\n\r\nWARC/1.1\r\n"
    htmls = [None, "", mark, "a" + mark * 3, "é" * 9000, "x" * 200_000, "same", "same", "same", "WARC/1.1", "\r\n", "0\r\n\r\n", "WARC/1.1\r" * 2000]
    rows = [(i, f"http://h/{i} \r\nWARC/1.1", h, "d") for i, h in enumerate(htmls)] + [(8, None, "same", "d"), (None, None, "same", "d"), (None, "u", "alone", "d")]
    table = ready(spark).createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    got = warc.archive_round_trip(table, segment_bytes=1000).collect()
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    want = Counter()
    for i, _, h, _ in rows:
        data, to = (h or "").encode(), last.get(h or "")
        revisit = to is not None and to != i
        want[i, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None, None if revisit else data] += 1
    assert Counter((*r[:5], None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_broken_archives_are_refused(spark, tmp_path):
    page = spark.createDataFrame([(1, "u", "x" * 5000)], "page long, url string, html string").select(
        "*", warc.payload_digest(F.col("html")).alias("digest"), F.lit(5000).cast("long").alias("length"), F.lit(None).cast("long").alias("refers")
    )
    warc.write_warc(page, f"{tmp_path}/a", segment_bytes=1000)
    records = warc.read_warc(spark, f"{tmp_path}/a")
    with pytest.raises(Exception, match="lacks segment 2"):
        warc.reassembled(records.filter("coalesce(segment, 0) <> 2")).collect()
    with pytest.raises(Exception, match="no last segment"):
        warc.reassembled(records.filter("total IS NULL")).collect()


def test_pipeline_stages_keep_columns_and_clean_documents(spark, docs, texts):
    sf_dir = "/root/testdata/sf0.001"
    more = docs.withColumn("_doc_id_x", F.lit(1)).withColumn("n_chars", F.length("text").cast("long")).withColumn("component_id", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns
        assert stage(spark, more.limit(0), sf_dir).count() == 0
    near = corpus_pipeline.drop_near_duplicates(spark, more, sf_dir)
    ids = {r.doc_id for r in near.select("doc_id").collect()}
    assert {None, 10, 13, 20} <= ids and not {12, 100} & ids
    cut = {r.doc_id: r for r in corpus_pipeline.drop_repeats(spark, near, sf_dir).collect()}
    assert len(cut[11].text.split()) == 60 and cut[11].n_chars == len(cut[11].text)


def test_leaks_go_with_or_without_a_doc_id(spark):
    sf_dir = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 60").orderBy("item_id").first().text
    rows = [(1, f"say {item} now"), (None, f"and {item} then"), (None, "nothing to see here"), (2, "nor here"), (3, item), (3, "a clean row"), (4, None), (None, None)]
    out = corpus_pipeline.drop_leaks(spark, ready(spark).createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert Counter(map(tuple, out.collect())) == Counter([(None, "nothing to see here"), (2, "nor here"), (4, None), (None, None)])


def test_no_text_is_lost_that_shares_its_doc_id(spark):
    rng = random.Random(8)
    lone, copied, other = (_words(rng, 60) for _ in range(3))
    rows = [(1, lone), (1, copied), (1, copied), (2, copied + " end"), (3, other), (None, copied), (4, None), (5, "")]
    df = ready(spark).createDataFrame([(d, t, "en", 1, 2, 3, 4, "x") for d, t in rows], COLUMNS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == Counter([(1, lone), (1, copied), (3, other), (None, copied), (4, None)])
