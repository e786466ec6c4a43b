"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each text in windows, forward and backward, gives every byte position a distribution over the languages
and pools the positions of a document to its probabilities. It is trained in numpy by backpropagation through time on a
documented, bounded sample; all bytes of every text are read when it predicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

HIDDEN = 8
WINDOW = 128
#: Windows that run side by side.
LANES = 1024
UNKNOWN = "und"


@dataclass
class Network:
    """Weights: per direction the bytes' gate inputs (3H x 256) and the recurrence (3H x H), and the output layer."""

    languages: list[str]
    inputs: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    output: np.ndarray
    bias: np.ndarray


def _steps(direction: int, length: int):
    return range(length) if direction == 0 else range(length - 1, -1, -1)


def _forward(net: Network, text: np.ndarray, keep: bool = False):
    """States (T, 2H, B) of both directions for bytes (T, B); with ``keep`` also what the gradients need.

    Gates: r and z are logistic, written as tanh of half the input, c = tanh(Wx + r * Uh), h' = c + z * (h - c).
    """
    length, lanes = text.shape
    h = HIDDEN
    states = np.empty((length, 2 * h, lanes), np.float32)
    saved: tuple[list, list] = ([], [])
    for d in (0, 1):
        w, u = net.inputs[d], net.recurrent[d]
        state = np.zeros((h, lanes), np.float32)
        x = np.empty((3 * h, lanes), np.float32)
        a = np.empty((3 * h, lanes), np.float32)
        gates = np.empty((2 * h, lanes), np.float32)
        for t in _steps(d, length):
            np.take(w, text[t], axis=1, out=x, mode="clip")
            np.matmul(u, state, out=a)
            np.add(x[:2 * h], a[:2 * h], out=gates)
            np.multiply(gates, 0.5, out=gates)
            np.tanh(gates, out=gates)
            np.multiply(gates, 0.5, out=gates)
            np.add(gates, 0.5, out=gates)
            r, z = gates[:h], gates[h:]
            c = x[2 * h:]
            np.add(c, r * a[2 * h:], out=c)
            np.tanh(c, out=c)
            if keep:
                saved[d].append((t, state, r.copy(), z.copy(), c.copy(), a[2 * h:].copy()))
            new = states[t, d * h:(d + 1) * h]
            np.subtract(state, c, out=new)
            np.multiply(new, z, out=new)
            np.add(new, c, out=new)
            state = new
    return (states, saved) if keep else states


def positions(net: Network, text: np.ndarray) -> np.ndarray:
    """Probabilities (T, languages, B) of every position."""
    logits = np.matmul(net.output, _forward(net, text))
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _gradients(net: Network, text: np.ndarray, target: np.ndarray, real: np.ndarray):
    """Loss and gradients of the mean cross-entropy over real positions; ``target`` (B) is each lane's language."""
    states, saved = _forward(net, text, keep=True)
    length, lanes = text.shape
    h, k = HIDDEN, len(net.languages)
    logits = np.matmul(net.output, states) + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    total = max(1, int(real.sum()))
    loss = -float((np.log(p[:, target, np.arange(lanes)] + 1e-9) * real).sum()) / total
    p[:, target, np.arange(lanes)] -= 1
    p *= (real / total)[:, None, :]
    d_output = np.einsum("tkb,thb->kh", p, states, optimize=True)
    d_states = np.matmul(net.output.T, p)
    d_inputs, d_recurrent = [], []
    for d in (0, 1):
        u = net.recurrent[d]
        dw, du = np.zeros((256, 3 * h), np.float32), np.zeros_like(u)
        back = np.zeros((h, lanes), np.float32)
        for t, state, r, z, c, uc in reversed(saved[d]):
            g = d_states[t, d * h:(d + 1) * h] + back
            dc = g * (1 - z) * (1 - c * c)
            dz = g * (state - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            into = np.concatenate([dr, dz, dc])
            through = np.concatenate([dr, dz, dc * r])
            du += through @ state.T
            back = g * z + u.T @ through
            np.add.at(dw, text[t], into.T)
        d_inputs.append(dw.T)
        d_recurrent.append(du)
    return loss, [*d_inputs, *d_recurrent, d_output, p.sum(axis=(0, 2))]


def train(texts: list[tuple[bytes | list[bytes], str]], steps: int = 400, lanes: int = 128, length: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """A network from (text, language) pairs by Adam on random windows, languages in equal shares; a list holds pieces of one text."""
    languages = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(seed)
    h, k = HIDDEN, len(languages)
    init = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(languages, (init(3 * h, 256), init(3 * h, 256)), (init(3 * h, h), init(3 * h, h)), init(k, 2 * h), np.zeros(k, np.float32))
    pieces = lambda t: [np.frombuffer(x, np.uint8) for x in (t if isinstance(t, list) else [t])]
    by_language = [[pieces(t) for t, lang in texts if lang == name and t and t != [b""]] for name in languages]
    pick = [i for i, own in enumerate(by_language) if own]
    if k < 2 or not pick:
        return net
    weights = [*net.inputs, *net.recurrent, net.output, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        batch, real = np.zeros((length, lanes), np.uint8), np.zeros((length, lanes), np.float32)
        target = np.array([pick[i % len(pick)] for i in range(lanes)])
        for i, lang in enumerate(target.tolist()):
            own = by_language[lang][rng.integers(len(by_language[lang]))]
            own = own[rng.integers(len(own)) if len(own) > 1 else 0]
            a = int(rng.integers(max(1, len(own) - length + 1)))
            piece = own[a:a + length]
            batch[:len(piece), i] = piece
            real[:len(piece), i] = 1
        _, grads = _gradients(net, batch, target, real)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        for i, (w, g) in enumerate(zip(weights, grads)):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            w -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict_texts(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pooled probabilities of each text: the mean over all its byte positions; zeros for an empty text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(n), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[rows] + within * WINDOW
    length = np.minimum(offsets[rows + 1] - begin, WINDOW)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    out = np.zeros((n, len(net.languages)))
    for a in range(0, len(rows), LANES):
        some = slice(a, min(a + LANES, len(rows)))
        at = begin[some][None, :] + np.arange(WINDOW)[:, None]
        real = np.arange(WINDOW)[:, None] < length[some][None, :]
        text = np.where(real, padded[at], 0)
        p = positions(net, text)
        p *= real[:, None, :]
        pooled = p.sum(axis=0, dtype=np.float64).T
        np.add.at(out, rows[some], pooled)
    return out / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, training: Column | None = None, per_language: int = 300, max_bytes: int = 4000, column: str = "text", id_column: str = "doc_id",
        lang_column: str = "lang", **settings) -> Network:
    """A network from at most ``per_language`` texts of each language among ``training`` rows (a condition on ``id``), in the
    order of a hash of their ids; of each such text at most ``max_bytes`` bytes, a bound on the training sample alone. Of a
    longer text these are windows as long as those of the training, at places drawn over the whole text by the id's hash."""
    use = F.lit(True) if training is None else training
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{lang_column}`").cast("string").alias("lang"), F.col(f"`{column}`").cast("string").alias("text"))
    rows = rows.where(use).where("lang is not null and text is not null and id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id")
    some = rows.join(F.broadcast(chosen), "id", "left_semi").select("id", "lang", F.xxhash64("id").alias("seed"), F.col("text").cast("binary").alias("text"))
    length = settings.get("length", 64)

    def draw(batches):
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                own = [_pieces(v.as_buffer(), s, length, max_bytes) for v, s in zip(part.column(3), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(own, pa.list_(pa.binary()))], ["id", "lang", "seed", "pieces"])

    kind = some.schema["id"].dataType.simpleString()
    drawn = some.mapInArrow(draw, f"id {kind}, lang string, seed long, pieces array<binary>")
    found = drawn.orderBy("lang", "seed", "id", "pieces").toArrow()
    return train([(own, lang) for own, lang in zip(found["pieces"].to_pylist(), found["lang"].to_pylist())], **settings)


def _pieces(text, seed: int, length: int, most: int) -> list[bytes]:
    """The text if it has at most ``most`` bytes, else windows of it with so many bytes in all."""
    data = memoryview(text)
    if len(data) <= most:
        return [bytes(data)]
    length = min(length, most)
    starts = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF).integers(len(data) - length + 1, size=most // length)
    return [bytes(data[a:a + length]) for a in starts.tolist()]


def predict(docs: DataFrame, net: Network, column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the likeliest language and its pooled probability, rounded to six digits.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no language was learned. Columns
    named like the outputs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(part):
        model = shared.value
        index = part.schema.get_field_index
        letters = np.asarray(part.column(index("_letters")).to_pylist(), bool)
        if not model.languages:
            return [pa.array([UNKNOWN] * part.num_rows), pa.array(np.zeros(part.num_rows))]
        p = predict_texts(model, *common.text_bytes(part.column(index(column))))
        best = p.argmax(axis=1)
        names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
        return [pa.array(names, pa.string()), pa.array(np.where(letters, np.clip(np.round(p.max(axis=1), 6), 0, 1), 0.0))]

    source = docs.withColumn(column, F.col(f"`{column}`").cast("string"))
    source = source.withColumn("_letters", F.coalesce(F.col(f"`{column}`").rlike(r"\p{L}"), F.lit(False)))
    return common.append(source, column, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work, using=["_letters"])
