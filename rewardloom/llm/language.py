"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import packed

HIDDEN = 8  # units per direction
WINDOW = 128  # bytes that one run of the network sees; every byte of a text lies in one window
SAMPLE_DOCUMENTS = 400  # labelled documents per language that training may use, picked by a hash of the id
SAMPLE_WINDOWS = 4  # windows taken from each of them
SAMPLE_BYTES = 64  # bytes of such a window
STEPS, BATCH, RATE, SEED = 200, 256, 0.02, 7
MIN_SCORE = 0.4  # pooled probability under which a document is rejected
UNKNOWN = "und"
BLOCK = 1024  # windows that run side by side


def held_out(doc_id: str = "doc_id") -> Column:
    """One fifth of the documents, by a checksum of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class ByteTagger:
    """Two gated recurrent layers, one per direction, and a softmax over languages at every byte.

    Step of a layer, with x the byte's row of ``table`` (three gates) and h the state before: z, r = sigmoid(x + h U),
    n = tanh(x + r (h U + c)), new state n + z (h - n). A byte's logits are both states times ``out``, plus ``bias``.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng, k = np.random.default_rng(seed), len(languages)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.weights = {
            "table": draw(2, 256, 3 * hidden, scale=0.3),
            "recurrent": draw(2, hidden, 3 * hidden, scale=0.6 / hidden**0.5),
            "inner": np.zeros((2, 1, hidden), np.float32),
            "out": draw(2, hidden, k, scale=0.3),
            "bias": np.zeros(k, np.float32),
        }

    @staticmethod
    def _read(windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table per step, (steps, 2, windows), and which of them are bytes; the second layer reads backwards."""
        steps = int(lengths.max())
        bytes_ = windows[:, :steps].T
        inside = np.arange(steps)[:, None] < lengths
        read = np.stack([bytes_, bytes_[::-1] + 256], axis=1)
        return read, np.stack([inside, inside[::-1]], axis=1).astype(np.float32)[..., None]

    def _run(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """States (steps, 2, windows, hidden); step t of the second layer is byte T - 1 - t. Works in place."""
        w, h, count = self.weights, self.hidden, len(windows)
        read, inside = self._read(windows, lengths)
        padded = lengths.min() < lengths.max()
        half = np.float32(0.5)  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        table = w["table"].reshape(512, -1)
        gate_rows, new_rows = np.ascontiguousarray(table[:, : 2 * h]) * half, np.ascontiguousarray(table[:, 2 * h :])
        gate_step, new_step = np.ascontiguousarray(w["recurrent"][..., : 2 * h]) * half, np.ascontiguousarray(w["recurrent"][..., 2 * h :])
        states, state = np.empty((len(read), 2, count, h), np.float32), np.zeros((2, count, h), np.float32)
        gates, more = np.empty((2, count, 2 * h), np.float32), np.empty((2, count, 2 * h), np.float32)
        n, x = np.empty_like(state), np.empty_like(state)
        for t in range(len(read)):
            np.take(gate_rows, read[t], axis=0, out=gates, mode="clip")
            np.take(new_rows, read[t], axis=0, out=x, mode="clip")
            gates += np.matmul(state, gate_step, out=more)
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            np.matmul(state, new_step, out=n)
            n += w["inner"]
            n *= gates[..., h:]
            n += x
            np.tanh(n, out=n)
            new = states[t]
            np.subtract(state, n, out=new)
            new *= gates[..., :h]
            new += n
            if padded:
                new *= inside[t]
            state = new
        return states

    def _keep(self, windows: np.ndarray, lengths: np.ndarray):
        """The same states, with what backpropagation needs of each step."""
        w, h = self.weights, self.hidden
        read, inside = self._read(windows, lengths)
        table, state, states, kept = w["table"].reshape(512, -1), np.zeros((2, len(windows), h), w["table"].dtype), [], []
        for t in range(len(read)):
            x, u = table[read[t]], np.matmul(state, w["recurrent"])
            gates = 0.5 * np.tanh(0.5 * (x[..., : 2 * h] + u[..., : 2 * h])) + 0.5
            z, r, inner = gates[..., :h], gates[..., h:], u[..., 2 * h :] + w["inner"]
            n = np.tanh(x[..., 2 * h :] + r * inner)
            kept.append((state, z, r, inner, n))
            state = (n + z * (state - n)) * inside[t]
            states.append(state)
        return np.array(states), kept, read, inside

    def _logits(self, states: np.ndarray) -> np.ndarray:
        """(steps, windows, languages) in the order of the bytes."""
        w = self.weights
        return states[:, 0] @ w["out"][0] + (states[:, 1] @ w["out"][1])[::-1] + w["bias"]

    def probabilities(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Language probabilities of every byte, (windows, bytes, languages)."""
        logits = self._logits(self._run(windows, lengths))
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits.transpose(1, 0, 2)

    def gradients(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes and its gradients, by backpropagation through time."""
        w, h = self.weights, self.hidden
        states, kept, read, inside = self._keep(windows, lengths)
        logits = self._logits(states)
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        mask = inside[:, 0]
        chosen = p[:, np.arange(len(labels)), labels]
        loss = float(-(np.log(chosen + 1e-9) * mask[..., 0]).sum() / mask.sum())
        p[:, np.arange(len(labels)), labels] -= 1
        p *= mask / mask.sum()
        both = np.stack([p, p[::-1]], axis=1)
        out = {name: np.zeros_like(value) for name, value in w.items()}
        out["bias"] += p.sum((0, 1))
        for d in (0, 1):
            out["out"][d] = np.tensordot(states[:, d], both[:, d], axes=([0, 1], [0, 1]))
        table, back = out["table"].reshape(512, -1), np.zeros_like(states[0])
        for t in range(len(states) - 1, -1, -1):
            before, z, r, inner, n = kept[t]
            back = (back + np.matmul(both[t], w["out"].transpose(0, 2, 1))) * inside[t]
            dn = back * (1 - z) * (1 - n * n)
            dz = back * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            held = dn * r
            gates = np.concatenate([dz, dr, held], -1)
            np.add.at(table, read[t], np.concatenate([dz, dr, dn], -1))
            out["inner"] += held.sum(1, keepdims=True)
            out["recurrent"] += np.matmul(before.transpose(0, 2, 1), gates)
            back = back * z + np.matmul(gates, w["recurrent"].transpose(0, 2, 1))
        return loss, out

    def fit(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> list[float]:
        """Adam over random batches; the losses."""
        rng, losses = np.random.default_rng(seed), []
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            some = rng.integers(0, len(windows), batch)
            loss, found = self.gradients(windows[some], lengths[some], labels[some])
            losses.append(loss)
            rate = RATE * (1 - step / (steps + 1)) + 1e-4
            for name, g in found.items():
                np.clip(g, -0.2, 0.2, out=g)
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                self.weights[name] -= (rate * move).astype(np.float32)
        return losses

    def labels(self, text: str) -> list[str]:
        """A language for every byte of a text."""
        windows, lengths, _ = cut_windows([text.encode("utf-8")])
        found = self.probabilities(windows, lengths).argmax(-1)
        return [self.languages[k] for row, n in zip(found, lengths) for k in row[:n]]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities over all bytes of each text, (texts, languages)."""
        windows, lengths, owner = cut_windows(texts)
        total = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(-lengths, kind="stable")  # windows of a length run together, so few are padded
        for at in range(0, len(order), BLOCK):
            some = order[at : at + BLOCK]
            p = self.probabilities(windows[some], lengths[some])
            if lengths[some[-1]] < p.shape[1]:
                p = p * (np.arange(p.shape[1]) < lengths[some][:, None])[..., None]
            np.add.at(total, owner[some], p.sum(1, dtype=np.float64))
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def cut_windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (count, size) padded with zeros, their lengths, and the text each belongs to."""
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    joined = b"".join(t.ljust(n * size, b"\0") for t, n in zip(texts, counts.tolist()))
    lengths = np.full(len(owner), size, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    lengths[last] = sizes[counts > 0] - (counts[counts > 0] - 1) * size
    return np.frombuffer(joined, np.uint8).reshape(-1, size).astype(np.int64), lengths, owner


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS, size: int = SAMPLE_BYTES) -> ByteTagger | None:
    """Learn from text and non-null ``lang`` of documents that are not held out; None where there are none.

    The sample is bounded: ``documents`` per language, the smallest by a hash of their id, and ``windows`` pieces of
    ``size`` bytes from each. Everything else uses all data.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("count")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * documents / n))])
    last = F.greatest(F.length("text") - size + 1, F.lit(1))
    start = lambda k: (F.pmod(F.xxhash64("doc_id", k), last) + 1).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda k: F.substr(F.col("text"), start(k), F.lit(size)))
    rows = labelled.withColumn("_place", place).where(F.col("_place") < F.element_at(share, F.col("lang")))
    # A row per id: an id that stands many times is one document, and sends one row however often it stands.
    rows = rows.groupBy("lang", "_place", "doc_id").agg(F.min(pieces).alias("pieces")).collect()
    languages = sorted(counts)
    texts, labels, used = [], [], dict.fromkeys(languages, 0)
    for row in sorted(rows, key=lambda r: (r["_place"], r["lang"], r["pieces"])):
        if used[row["lang"]] < documents:
            used[row["lang"]] += 1
            texts += [p.encode("utf-8")[:size] for p in row["pieces"]]
            labels += [languages.index(row["lang"])] * len(row["pieces"])
    labels = np.array(labels)
    cut, lengths, owner = cut_windows(texts, size)
    labels = labels[owner]
    weight = 1.0 / np.bincount(labels, minlength=len(languages))[labels]  # languages count alike
    rng = np.random.default_rng(SEED)
    some = rng.choice(len(labels), len(labels), p=weight / weight.sum())
    model = ByteTagger(languages)
    model.fit(cut[some], lengths[some], labels[some])
    return model


def language_column(model: ByteTagger | None, text: Column) -> Column:
    """struct<lang, score> of a text: the language with the largest pooled probability, or 'und' and 0."""

    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            some = [k for k, t in enumerate(batch) if t and model and any(map(str.isalpha, t))]
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                found = model.pooled([batch.iloc[k].encode("utf-8", "surrogatepass") for k in part])
                best = found.argmax(1)
                langs[part] = [model.languages[k] for k in best]
                scores[part] = found[np.arange(len(part)), best].clip(0, 1).round(6)
            yield pd.DataFrame({"lang": langs, "score": scores})

    # Annotations are strings here, so the kind of function is named.
    tag.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(tag, "lang string, score double")(text)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; texts are tagged where they lie, nothing is shuffled.

    Null text or a text without a letter: 'und', score 0. No labelled rows: every text is 'und'. Null id: held out.
    Repeated rows: same values. Empty table: empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = language_column(train(rows), F.col("text"))
    tagged = rows.select("doc_id", held_out().alias("held_out"), "text").withColumn("_found", found)
    return tagged.select("doc_id", "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is recognised with at least ``min_score``, columns unchanged; cases as for ``predict``."""
    labelled = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = docs.select(packed(docs))  # the text stands once in a row that waits for its language
    tagged = rows.withColumn("_found", language_column(train(labelled), F.col("_row.text").cast("string")))
    kept = (F.col("_found.lang") != UNKNOWN) & (F.col("_found.score") >= min_score)
    return tagged.where(kept).select("_row.*")
