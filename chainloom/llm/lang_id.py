"""Language ID (operator 1): a bidirectional gated recurrent network over bytes.

Texts are read in windows of WINDOW bytes, and the state begins anew in each, so all windows run side by
side and every byte has context from both of its sides within its window. Two gated recurrent layers run over each window,
one from either end; their states at a byte give that byte's label distribution, and a document's distribution
is the mean over all its bytes. The network is trained in numpy by backpropagation through time, on
windows from a bounded sample of labelled rows (`sample_rows` rows, `per_row` windows each, taken at
hashed places by smallest seeded hash of doc_id, so reruns agree), with every position labelled by its
row's language and languages weighted to count alike. Prediction reads every byte of every text.

Rows whose crc32(doc_id) mod 4 is 2 are held out of training, and so are rows with a null id or
label. Defined results: a null text or one without a letter is `und` with score 0, and so is every
text when no row can be learned from; repeated rows get equal results; an empty table gives an empty
result; only doc_id, text and (for training) lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .runtime import map_batches, smallest, string_column, table

WINDOW = 64
HIDDEN = 8
PAD = 256
UNKNOWN = "und"
#: Windows that run at once.
WIDTH = 2048


@dataclass
class Network:
    """Weights by direction: inputs (257, 3h), recurrent (3h, h); outputs (c, 2h + 1). Gates are in
    the order update, reset, candidate; a padding byte keeps the state."""

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    outputs: np.ndarray
    labels: list[str]

    @property
    def hidden(self) -> int:
        return self.recurrent[0].shape[1]


def _pass(x: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, out: np.ndarray, backward: bool, keep: list | None = None) -> None:
    """States of one direction for windows x (time, n) into out (time, h, n)."""
    steps, n = x.shape
    k = recurrent.shape[1]
    h = np.zeros((k, n), np.float32)
    g, w = np.empty((3 * k, n), np.float32), np.empty((k, n), np.float32)
    for s in range(steps - 1, -1, -1) if backward else range(steps):
        e = inputs[x[s]].T
        np.matmul(recurrent, h, out=g)
        gates, c = g[: 2 * k], g[2 * k :]
        gates += e[: 2 * k]
        gates *= 0.5  # the logistic function by tanh
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        own = c.copy() if keep is not None else None
        c *= gates[k:]
        c += e[2 * k :]
        np.tanh(c, out=c)
        np.subtract(h, c, out=w)
        w *= gates[:k]
        if keep is not None:
            keep.append((s, h, gates.copy(), c.copy(), own))
        h = out[s]
        np.add(w, c, out=h)


def _states(x: np.ndarray, net: Network, keep: list | None = None) -> np.ndarray:
    out = np.empty((2, x.shape[0], net.hidden, x.shape[1]), np.float32)
    for d in (0, 1):
        _pass(x, net.inputs[d], net.recurrent[d], out[d], bool(d), keep[d] if keep else None)
    return out


def _probabilities(states: np.ndarray, net: Network) -> np.ndarray:
    """(time, c, n)"""
    k = net.hidden
    p = np.matmul(net.outputs[:, :k], states[0])
    p += np.matmul(net.outputs[:, k : 2 * k], states[1])
    p += net.outputs[:, 2 * k :]
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def _gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, net: Network) -> tuple[list[np.ndarray], float]:
    """Gradients of the weighted mean loss by position, through time."""
    k, keep = net.hidden, [[], []]
    states = _states(x, net, keep)
    p = _probabilities(states, net)
    mask = (x != PAD) * weight
    mask = (mask / max(mask.sum(), 1e-9)).astype(np.float32)
    n = np.arange(x.shape[1])
    loss = float(-(np.log(np.maximum(p[:, y, n], 1e-9)) * mask).sum())
    p[:, y, n] -= 1
    p *= mask[:, None, :]
    d_out = np.concatenate([np.einsum("tcn,thn->ch", p, states[0]), np.einsum("tcn,thn->ch", p, states[1]), p.sum((0, 2))[:, None]], 1)
    grads = []
    for d in (0, 1):
        d_in, d_rec = np.zeros_like(net.inputs[d]), np.zeros_like(net.recurrent[d])
        back = np.matmul(net.outputs[:, d * k : (d + 1) * k].T, p)  # (time, h, n)
        dh = np.zeros((k, x.shape[1]), np.float32)
        for s, h, gates, c, own in reversed(keep[d]):
            dh = dh + back[s]
            z, r = gates[:k], gates[k:]
            dc = dh * (1 - z) * (1 - c * c)
            dg = np.concatenate([dh * (h - c) * z * (1 - z), dc * own * r * (1 - r), dc])
            np.add.at(d_in, x[s], dg.T)
            dg[2 * k :] *= r
            d_rec += dg @ h.T
            dh = dh * z + net.recurrent[d].T @ dg
        d_in[PAD] = 0
        grads += [d_in, d_rec]
    return [*grads, d_out.astype(np.float32)], loss


def train(
    windows: np.ndarray,
    y: np.ndarray,
    labels: list[str],
    hidden: int = HIDDEN,
    epochs: int = 4,
    batch: int = 256,
    rate: float = 0.02,
    seed: int = 1,
) -> Network:
    """windows (time, n) of bytes and PAD, y their label numbers. Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    net = Network(
        [draw(257, 3 * hidden), draw(257, 3 * hidden)],
        [draw(3 * hidden, hidden), draw(3 * hidden, hidden)],
        draw(len(labels), 2 * hidden + 1),
        labels,
    )
    for w in net.inputs:
        w[PAD] = 0
        w[PAD, :hidden] = 60  # the update gate is 1
    weights = [net.inputs[0], net.recurrent[0], net.inputs[1], net.recurrent[1], net.outputs]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    count = np.bincount(y, minlength=len(labels))
    by_class = len(y) / np.maximum(count, 1) / len(labels)
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            own = order[i : i + batch]
            grads, _ = _gradient(windows[:, own], y[own], by_class[y[own]].astype(np.float32), net)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            for w, g, a, b in zip(weights, grads, m, v, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= rate * (1 - step / (total + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (time, n) of the texts of a block, and the text of each."""
    at = at - at[0]
    count = -(-np.diff(at) // WINDOW)
    home = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    begin = at[home] + (np.arange(len(home)) - first[home]) * WINDOW
    place = begin[None, :] + np.arange(WINDOW)[:, None]
    inside = place < at[home + 1][None, :]
    padded = np.append(data, 0).astype(np.int16)
    return np.where(inside, padded[np.minimum(place, len(data))], PAD), home


def predict(column: pa.Array, net: Network) -> np.ndarray:
    """Mean label distribution (n, c) of each text; zeros for an empty one."""
    data, at = kernel.buffers(column)
    out = np.zeros((len(column), len(net.labels)))
    for i, j in kernel.blocks(at):
        windows, home = _cut(data[at[i] : at[j]], at[i : j + 1])
        for a in range(0, len(home), WIDTH):
            x = windows[:, a : a + WIDTH]
            p = _probabilities(_states(x, net), net)
            p *= (x != PAD)[:, None, :]
            np.add.at(out, i + home[a : a + WIDTH], p.sum(0).T)
    return out / np.maximum(np.diff(at), 1)[:, None]


def fit(docs: DataFrame, sample_rows: int = 4000, per_row: int = 3, seed: int = 1, **options) -> Network | None:
    """A network from a bounded sample of the rows that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), string_column(docs, "lang").alias("lang"), string_column(docs, "text").alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null and pmod(crc32(cast(id as binary)), 4) <> 2")
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    parts = [F.substring("text", (F.pmod(F.xxhash64("id", F.lit(k + 100 * seed)), room) + 1).cast("int"), F.lit(WINDOW)).alias(f"w{k}") for k in range(per_row)]
    rows = rows.select("id", F.xxhash64("id", F.lit(seed)).alias("h"), "lang", *parts)
    rows = smallest(rows, "h", sample_rows, "id", "lang", *[f"w{k}" for k in range(per_row)]).collect()
    texts = [(r[f"w{k}"].encode()[:WINDOW], r.lang) for r in rows for k in range(per_row) if r[f"w{k}"]]
    if not texts:
        return None
    labels = sorted({lang for _, lang in texts})
    x = np.full((WINDOW, len(texts)), PAD, np.int16)
    for n, (text, _) in enumerate(texts):
        x[: len(text), n] = np.frombuffer(text, np.uint8)
    return train(x, np.array([labels.index(lang) for _, lang in texts]), labels, seed=seed, **options)


def language_id(docs: DataFrame, sample_rows: int = 4000, per_row: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    net = fit(docs, sample_rows, per_row)
    text = string_column(docs, "text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        F.when(text.rlike(r"\p{L}"), text).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        known = batch.column(2).is_valid().to_numpy(zero_copy_only=False) if net else np.zeros(n, bool)
        p = predict(batch.column(2), net) if net else np.zeros((n, 1))
        best = p.argmax(1)
        lang = [net.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        score = np.where(known, np.clip(p.max(1), 0, 1), 0.0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
