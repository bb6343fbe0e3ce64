"""Language of texts by a bidirectional gated recurrent network over bytes.

Each byte's input is a row of a table; two gated recurrent layers read a segment of the text from
either end; at every position their states give the languages' chances.  A document's chances are
the mean over all its positions.  The network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.sampling import hash_limit

HIDDEN = 8
#: Bytes of a segment when texts are labelled; whole texts are cut into such segments.
SEGMENT = 128
#: The fit: at most about this many documents, as many of each language, segments of so many bytes, batches and their size.
FIT_DOCUMENTS, FIT_BYTES, FIT_STEPS, FIT_BATCH = 3000, 48, 160, 256

Weights = dict[str, np.ndarray]


def new_weights(languages: int, hidden: int, chance: np.random.Generator) -> Weights:
    """Per direction: input table (256 x 3h), recurrent matrix (h x 3h); then the output layer."""
    out: Weights = {}
    for side in ("f", "b"):
        out[f"x{side}"] = chance.normal(0, 0.3, (256, 3 * hidden))
        out[f"u{side}"] = chance.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
    out["w"] = chance.normal(0, 0.3, (2 * hidden, languages))
    out["c"] = np.zeros(languages)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_layer(table: np.ndarray, recurrent: np.ndarray, data: np.ndarray, keep: list | None = None):
    """States (time x batch x h) of one layer over ``data`` (time x batch), in its order.

    Gates: z how much of the old state stays, r how much of it the new one sees.
    """
    h = recurrent.shape[0]
    state = np.zeros((data.shape[1], h), dtype=table.dtype)
    states = np.empty((*data.shape, h), dtype=table.dtype)
    for t, codes in enumerate(data):
        a, b = table[codes], state @ recurrent
        gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
        if keep is not None:
            keep.append((codes, state, z, r, new, b[:, 2 * h :]))
        state = new + z * (state - new)
        states[t] = state
    return states


def layer_gradient(recurrent: np.ndarray, keep: list, upper: np.ndarray):
    """Gradients of the table and the recurrent matrix from those of all states."""
    h = recurrent.shape[0]
    d_table, d_recurrent = np.zeros((256, 3 * h)), np.zeros_like(recurrent)
    back = np.zeros_like(upper[0])
    for t in range(len(keep) - 1, -1, -1):
        codes, before, z, r, new, seen = keep[t]
        d = upper[t] + back
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * seen * r * (1 - r)
        d_in = np.concatenate([d_z, d_r, d_new], axis=1)
        d_seen = np.concatenate([d_z, d_r, d_new * r], axis=1)
        np.add.at(d_table, codes, d_in)
        d_recurrent += before.T @ d_seen
        back = d * z + d_seen @ recurrent.T
    return d_table, d_recurrent


def position_chances(weights: Weights, data: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    """Chances of the languages at every position of ``data`` (time x batch)."""
    kf, kb = keep or (None, None)
    forward = run_layer(weights["xf"], weights["uf"], data, kf)
    backward = run_layer(weights["xb"], weights["ub"], data[::-1], kb)[::-1]
    h = forward.shape[2]
    logits = forward @ weights["w"][:h] + backward @ weights["w"][h:] + weights["c"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    if keep is not None:
        keep[0].append(forward)
        keep[1].append(backward)
    return logits


def gradients(weights: Weights, data: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross entropy over all positions and its gradients."""
    keep: tuple[list, list] = ([], [])
    chances = position_chances(weights, data, keep)
    forward, backward = keep[0].pop(), keep[1].pop()
    time, batch, _ = chances.shape
    loss = -np.log(chances[:, np.arange(batch), label] + 1e-12).mean()
    d = chances.copy()
    d[:, np.arange(batch), label] -= 1
    d /= time * batch
    h = forward.shape[2]
    flat = d.reshape(-1, d.shape[2])
    out = {"c": flat.sum(axis=0)}
    out["w"] = np.concatenate(
        [forward.reshape(-1, h).T @ flat, np.ascontiguousarray(backward).reshape(-1, h).T @ flat]
    )
    out["xf"], out["uf"] = layer_gradient(weights["uf"], keep[0], d @ weights["w"][:h].T)
    out["xb"], out["ub"] = layer_gradient(weights["ub"], keep[1], (d @ weights["w"][h:].T)[::-1])
    return float(loss), out


def adam(weights: Weights, gradient: Weights, memory: dict, rate: float) -> None:
    """One step of adaptive moments, in place."""
    memory["n"] = n = memory.get("n", 0) + 1
    for name, g in gradient.items():
        m, v = memory.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        memory[name] = m, v
        weights[name] -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)


def fit_network(texts: Sequence[bytes], labels: np.ndarray, languages: int, seed: int = 3) -> Weights:
    """Weights learned from texts and the numbers of their languages."""
    chance = np.random.default_rng(seed)
    weights = new_weights(languages, HIDDEN, chance)
    usable = [i for i, t in enumerate(texts) if t]
    if languages < 2 or not usable:
        return weights
    memory: dict = {}
    # Rare languages are drawn as often as the square root of their share tells.
    share = np.bincount(labels[usable], minlength=languages).astype(float)
    odds = 1 / np.sqrt(share[labels[usable]])
    drawn = chance.choice(usable, (FIT_STEPS, FIT_BATCH), p=odds / odds.sum())
    for step, batch in enumerate(drawn):
        data = np.full((FIT_BYTES, len(batch)), 32, dtype=np.uint8)
        for column, i in enumerate(batch.tolist()):
            start = int(chance.integers(0, max(1, len(texts[i]) - FIT_BYTES + 1)))
            part = np.frombuffer(texts[i][start : start + FIT_BYTES], np.uint8)
            data[: len(part), column] = part
        _, gradient = gradients(weights, data, labels[batch])
        adam(weights, gradient, memory, 0.03 * (1 - step / FIT_STEPS) + 0.002)
    return weights


def text_chances(weights: Weights, texts: Sequence[bytes], at_once: int = 2048) -> np.ndarray:
    """Mean chances over all positions of every text (texts x languages); 0 for an empty one."""
    small = {k: v.astype(np.float32) for k, v in weights.items()}
    languages = len(weights["c"])
    total = np.zeros((len(texts), languages))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    edge = np.concatenate([[0], np.cumsum(pieces)])
    begin = (np.arange(edge[-1]) - edge[owner]) * SEGMENT
    offset = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts) + b" " * SEGMENT, np.uint8)
    start, length = offset[owner] + begin, np.minimum(size[owner] - begin, SEGMENT)
    order = np.argsort(length, kind="stable")  # segments of like lengths together
    for i in range(0, len(order), at_once):
        part = order[i : i + at_once]
        longest = int(length[part].max())
        block = data[start[part][None, :] + np.arange(longest)[:, None]]
        inside = np.arange(longest)[:, None] < length[part][None, :]
        block = np.where(inside, block, 32)  # blanks behind the end of a text
        chances = position_chances(small, block)
        sums = (chances * inside[:, :, None]).sum(axis=0)
        np.add.at(total, owner[part], sums)
    return total / np.maximum(size, 1)[:, None]


def held_out(folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is never learned from; a null doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify_language(docs: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred and score, by the whole text.

    Learned from documents with a lang and outside the held-out fold, of which about ``most`` are
    drawn by a hash of doc_id, the same number for every lang (all of a lang that has fewer), so a
    rare lang is learned in a table of any size.  Only their text and lang are used.  A null text, or one without
    a letter, is ``und`` with score 0, as is every text when there is nothing to learn from; one
    lang alone is the answer for all.  Repeated rows are labelled alike, an empty table gives no
    rows.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    known = known.where(F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    quota = max(1, most // max(1, len(counts)))
    limits = json.dumps({lang: hash_limit(quota, n) for lang, n in counts.items()})
    limit = F.from_json(F.lit(limits), "map<string, bigint>")[F.col("lang")]
    drawn = known.where(F.xxhash64("doc_id") <= limit)
    # The fit's windows come from anywhere in a text: four slices from hashed places of it.
    slices = F.expr(
        "array_join(transform(sequence(0, 3), i -> substring(text, 1 + cast(pmod(xxhash64(doc_id, i), "
        "greatest(length(text) - 200, 1)) as int), 200)), ' ')"
    )
    rows = drawn.select("lang", F.encode(slices, "utf-8").alias("t")).collect()
    languages = sorted({r.lang for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    labels = np.array([number[r.lang] for r in rows], dtype=np.int64)
    weights = fit_network([bytes(r.t) for r in rows], labels, len(languages)) if rows else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            start = 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and held < 2_000_000:
                    held += len(texts[stop])
                    stop += 1
                part = texts[start:stop]
                told = [bool(languages) and any(map(str.isalpha, t)) for t in part]
                lang, score = ["und"] * len(part), [0.0] * len(part)
                if any(told):
                    chances = text_chances(weights, [t.encode() for t in part])
                    best = chances.argmax(axis=1)
                    for i in np.flatnonzero(told).tolist():
                        lang[i] = languages[best[i]]
                        score[i] = min(1.0, float(chances[i, best[i]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)),
                        batch.column(1).slice(start, len(part)),
                        pa.array(lang, pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )
                start = stop

    narrow = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
