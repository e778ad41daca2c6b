"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every byte and
pools the labels' probabilities over all bytes of the whole text. It is trained
in numpy by backpropagation through time on the driver, on a bounded sample of
labelled rows, and sent to the tasks; its size is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import by_batch, ready, texts_of

UNKNOWN = "und"
WINDOW = 64
LANES = 4096


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid."""
    return np.clip(0.25 * x + 0.5, 0.0, 1.0)


class ByteGRU:
    """Two directions of ``hidden`` units; the input matrices are tables with a row for each byte."""

    def __init__(self, classes: int, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes

        def drawn(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.params = {"out": drawn(2 * hidden, classes, scale=0.3), "out_bias": np.zeros(classes, np.float32)}
        for way in "fb":
            self.params[f"in_{way}"] = drawn(256, 3 * hidden, scale=0.5)
            self.params[f"gates_{way}"] = drawn(hidden, 2 * hidden, scale=0.3)
            self.params[f"new_{way}"] = drawn(hidden, hidden, scale=0.3)

    def _states(self, lanes: np.ndarray, way: str, tape: list | None = None) -> np.ndarray:
        """Hidden states (position, lane, unit) of byte lanes (position, lane), read in one direction."""
        table, gates, new = (self.params[f"{k}_{way}"] for k in ("in", "gates", "new"))
        n = self.hidden
        state = np.zeros((lanes.shape[1], n), np.float32)
        out = np.empty((*lanes.shape, n), np.float32)
        for t in range(len(lanes)) if way == "f" else range(len(lanes) - 1, -1, -1):
            given = table[lanes[t]]
            both = given[:, : 2 * n] + state @ gates
            both = _gate(both)
            reset, update = both[:, :n], both[:, n:]
            held = reset * state
            fresh = np.clip(given[:, 2 * n :] + held @ new, -1.0, 1.0)
            if tape is not None:
                tape.append((t, state, both, held, fresh))
            state = fresh + update * (state - fresh)
            out[t] = state
        return out

    def probabilities(self, lanes: np.ndarray) -> np.ndarray:
        """(position, lane, class)."""
        both = np.concatenate([self._states(lanes, "f"), self._states(lanes, "b")], axis=2)
        logits = both @ self.params["out"] + self.params["out_bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, lanes: np.ndarray, labels: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over real positions and its gradients, by backpropagation through time."""
        n, p = self.hidden, self.params
        tapes: dict[str, list] = {"f": [], "b": []}
        states = {way: self._states(lanes, way, tapes[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logits = both @ p["out"] + p["out_bias"]
        logits -= logits.max(axis=2, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(axis=2, keepdims=True)
        lane = np.arange(lanes.shape[1])
        count = max(1, int(real.sum()))
        loss = -float((np.log(probs[:, lane, labels] + 1e-9) * real).sum()) / count
        wrong = probs
        wrong[:, lane, labels] -= 1
        wrong *= (real / count)[:, :, None]
        grads = {"out": np.einsum("tli,tlc->ic", both, wrong, optimize=True), "out_bias": wrong.sum((0, 1))}
        back = wrong @ p["out"].T
        for way, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            g_in = np.zeros_like(p[f"in_{way}"])
            g_gates, g_new = np.zeros_like(p[f"gates_{way}"]), np.zeros_like(p[f"new_{way}"])
            later = np.zeros((lanes.shape[1], n), np.float32)
            for t, state, gates, held, fresh in reversed(tapes[way]):
                reset, update = gates[:, :n], gates[:, n:]
                d = part[t] + later
                d_fresh = d * (1 - update) * ((fresh > -1) & (fresh < 1))
                d_held = d_fresh @ p[f"new_{way}"].T
                g_new += held.T @ d_fresh
                d_gates = np.concatenate([d_held * state, d * (state - fresh)], axis=1)
                d_gates *= 0.25 * ((gates > 0) & (gates < 1))
                g_gates += state.T @ d_gates
                later = d * update + d_held * reset + d_gates @ p[f"gates_{way}"].T
                np.add.at(g_in, lanes[t], np.concatenate([d_gates, d_fresh], axis=1))
            grads |= {f"in_{way}": g_in, f"gates_{way}": g_gates, f"new_{way}": g_new}
        return loss, grads

    def fit(self, lanes: np.ndarray, labels: np.ndarray, real: np.ndarray, *, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam over random batches of windows."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, lanes.shape[1], batch)
            _, grads = self.gradients(lanes[:, pick], labels[pick], real[:, pick])
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            shrink = min(1.0, 1.0 / (size + 1e-9))
            speed = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grads.items():
                g = g * shrink
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                moved = mean[k] / (1 - 0.9**step)
                self.params[k] -= (speed * moved / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def byte_lanes(text: bytes) -> tuple[np.ndarray, int]:
    """The text in windows, one a lane (position, lane), the last filled up with spaces; and the text's length."""
    count = -(-len(text) // WINDOW)
    lanes = np.full(count * WINDOW, 32, np.uint8)
    lanes[: len(text)] = np.frombuffer(text, np.uint8)
    return lanes.reshape(count, WINDOW).T, len(text)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class LanguageModel:
    def __init__(self, languages: list[str], network: ByteGRU | None) -> None:
        self.languages, self.network = languages, network

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, pooled probability) of each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        pooled = np.zeros((len(texts), max(1, len(self.languages))))
        waiting: list[tuple[int, np.ndarray, int]] = []
        width = 0

        def run() -> None:
            nonlocal waiting, width
            if waiting:
                lanes = np.ascontiguousarray(np.concatenate([w[1] for w in waiting], axis=1))
                sums = self.network.probabilities(lanes)
                at = 0
                for number, part, length in waiting:
                    upto = at + part.shape[1]
                    each = sums[:, at:upto].sum(axis=0, dtype=np.float64)
                    if length < part.size:  # the filling doesn't count
                        each[-1] -= sums[length - part.size :, upto - 1].sum(axis=0, dtype=np.float64)
                    pooled[number] += each.sum(axis=0)
                    at = upto
            waiting, width = [], 0

        usable = [bool(self.languages) and has_letter(t.decode()) for t in texts]
        for number, text in enumerate(texts):
            if not usable[number]:
                continue
            for begin in range(0, len(text), WINDOW * LANES):
                lanes, length = byte_lanes(text[begin : begin + WINDOW * LANES])
                waiting.append((number, lanes, length))
                width += lanes.shape[1]
                if width >= LANES:
                    run()
        run()
        for number, text in enumerate(texts):
            if usable[number]:
                best = int(np.argmax(pooled[number]))
                out[number] = (self.languages[best], float(min(1.0, pooled[number, best] / len(text))))
        return out


def train(
    labelled: DataFrame,
    *,
    sample: int = 1200,
    sample_bytes: int = 4096,
    hidden: int = 10,
    steps: int = 240,
    batch: int = 256,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
) -> LanguageModel:
    """Fit on at most ``sample`` labelled rows, drawn by label, and windows from all over each of their texts.

    Labels share the sample evenly: of each label the first rows by a hash of ``key`` are drawn, so that a rare language
    is learned as well. With more than ``sample`` labels, the most frequent are learned. A text gives at most
    ``sample_bytes`` bytes in windows at even distances, the first and the last among them, so that no part of long
    texts is left out. These bounds limit what reaches the driver. Rows with a null key, text or label and texts without
    a byte are not used. Without labelled rows the model knows no language.
    """
    usable = labelled.filter(
        F.col(label).isNotNull() & F.col(key).isNotNull() & (F.octet_length(F.col(text).cast("binary")) > 0)
    ).select(F.col(key).alias("id"), F.col(text).cast("binary").alias("bytes"), F.col(label).alias("label"))
    found = usable.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids"))
    learned = found.orderBy(F.desc("n"), "label").limit(sample).collect()
    languages = sorted(r["label"] for r in learned)
    if not languages:
        return LanguageModel([], None)
    share = sample // len(languages)
    # The first hashes alone reach the window: about eight times a label's share, however many rows it has.
    bounds = [(r["label"], min(2**63 - 1, -(2**63) + int((8 * share + 64) / max(1, r["ids"]) * 2**64))) for r in learned]
    # As Arrow: a list would go through a second set of Python workers, which executors then keep.
    listed = pa.table(dict(zip(("label", "bound"), map(list, zip(*bounds, strict=True)), strict=True)))
    bound = labelled.sparkSession.createDataFrame(listed, f"label {usable.schema['label'].dataType.simpleString()}, bound long")
    # Rows that are equal in key and text are drawn like others; ties of the hash are broken by key and text.
    first = Window.partitionBy("label").orderBy("at", "id", "text_hash")
    ranked = usable.join(F.broadcast(bound), "label").withColumn("at", F.xxhash64("id")).filter("at <= bound")
    drawn = (
        ranked.select("label", "id", "at", F.xxhash64("bytes").alias("text_hash"))
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= share)
    )
    chosen = F.broadcast(drawn.groupBy("label", "id", "text_hash").agg(F.count("*").alias("times")))  # at most ``sample`` rows
    rows = usable.withColumn("text_hash", F.xxhash64("bytes")).join(chosen, ["label", "id", "text_hash"])
    one_each = rows.groupBy("label", "id", "text_hash").agg(F.first("times").alias("times"), F.min(_spaced("bytes", sample_bytes)).alias("windows"))
    fetched = sorted(one_each.collect(), key=lambda r: (r["label"], str(r["id"]), r["text_hash"]))
    lanes, labels, real = [], [], []
    for r in fetched:
        for piece in list(r["windows"]) * r["times"]:
            part, length = byte_lanes(bytes(piece))
            lanes.append(part)
            labels.append(np.full(part.shape[1], languages.index(r["label"])))
            real.append((np.arange(part.size) < length).reshape(part.shape[1], WINDOW).T)
    network = ByteGRU(len(languages), hidden, seed)
    arrays = np.concatenate(lanes, axis=1), np.concatenate(labels), np.concatenate(real, axis=1).astype(np.float32)
    network.fit(*arrays, steps=steps, batch=batch, rate=0.02, seed=seed)
    return LanguageModel(languages, network)


def _spaced(name: str, most: int) -> Column:
    """Windows of a non-empty binary column, at even distances from its first to its last byte, at most ``most`` bytes in all."""
    count = max(1, most // WINDOW)
    size = F.octet_length(name)
    begins = F.when(size <= count * WINDOW, F.transform(F.sequence(F.lit(0), F.ceil(size / WINDOW) - 1), lambda i: i * WINDOW)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"),
            lambda i: F.floor(i * (size - WINDOW) / max(1, count - 1)),
        )
    )
    return F.transform(begins, lambda at: F.substring(F.col(name), (at + 1).cast("int"), F.lit(WINDOW)))


def predict(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, lang_pred, score) of every row's whole text.

    ``und`` with score 0 for null texts, texts without a letter, and when the
    model knows no language. Null and repeated keys are rows of their own; other
    columns are not read; no rows give no rows.
    """
    sent = ready(docs.sparkSession).sparkContext.broadcast(model)
    kind = docs.schema[key].dataType

    def make():
        known = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = known.predict(list(texts_of(batch, "text")))
            arrays = [batch.column("key"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, ["key", "lang_pred", "score"])

        return step

    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(by_batch(make), f"key {kind.simpleString()}, lang_pred string, score double")
        .withColumnRenamed("key", key)
    )


def held_out(key: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
