"""Quality classifier: a factorisation machine (operator 10).

Features of a text: its lower-cased words, hashed to 8192 places, weighted by 1 + log(count) and scaled to length 0.5; and statistics of
its structure (length, shares of signs, capitals, digits, bars, exclamation marks, lines, distinct words, mean word length), each as one of
16 steps. The score is the logistic of a bias, a weight for each feature, and for each pair of features the product of their low-rank factors,
computed in linear time: the sum over pairs is half of (square of the sum - sum of the squares), factor by factor.

The fit is made on a bounded sample of labelled rows (``sample``, by hash of the key); scoring covers every whole text.

Defined results: null and empty texts get a score from their structure alone; rows whose label is null teach nothing; a table without usable
labels gives the prior 0.5; repeated rows get equal scores; other columns are never inputs, and pass through ``score`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, col, lower_ascii, packed, unpacked, with_row

WORDS, STEPS = 8192, 16
#: Labelled rows to fit on at most, rank, passes over the sample and steps at least, rows in a step.
SAMPLE, RANK, PASSES, LEAST_STEPS, BATCH = 6000, 6, 12, 1000, 128

_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[ord(c) for c in "#*$%&<>@^~="]] = True
_STATISTICS = 10
SIZE = WORDS + _STATISTICS * STEPS


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts: document, feature, value; sorted by document."""
    words = Words(lower_ascii(data), bounds)
    pair, count = np.unique(words.doc * WORDS + (words.hashes() % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    doc, feature = pair // WORDS, pair % WORDS
    value = 1 + np.log(count)
    n_docs = len(bounds) - 1
    norm = np.sqrt(np.bincount(doc, value**2, n_docs))
    value = 0.5 * value / norm[doc]

    start, end = bounds[:-1], bounds[1:]

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return (total[end] - total[start]).astype(float)

    size, n = (end - start).astype(float), words.n.astype(float)
    one = np.maximum(n, 1)
    distinct = np.bincount(doc, minlength=n_docs)
    letters = np.maximum(size - share(data == 32), 1)
    stats = [
        np.log2(1 + n),
        np.log2(1 + size) - 2,
        16 * np.sqrt(np.minimum(1, share(_SIGNS[data]) / (4 * one))),
        16 * share((data >= 65) & (data <= 90)) / letters,
        16 * np.sqrt(share((data >= 48) & (data <= 57)) / letters),
        16 * np.sqrt(np.minimum(1, share(data == ord("|")) / one)),
        16 * np.sqrt(np.minimum(1, share(data == ord("!")) / (2 * one))),
        16 * np.sqrt(np.minimum(1, share(data == 10) / one)),
        16 * distinct / np.maximum(np.minimum(n, 400), 1),
        letters / one,
    ]
    steps = np.clip(np.column_stack(stats), 0, STEPS - 1).astype(np.int64) + WORDS + STEPS * np.arange(_STATISTICS)
    doc = np.concatenate([doc, np.repeat(np.arange(n_docs), _STATISTICS)])
    feature = np.concatenate([feature, steps.ravel()])
    value = np.concatenate([value, np.ones(steps.size)])
    order = np.argsort(doc, kind="stable")
    return doc[order], feature[order], value[order]


@dataclass
class Machine:
    """bias, weights (SIZE) and factors (SIZE x rank)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.weights[feature] * value, n)
        for f in range(self.factors.shape[1]):
            x = self.factors[feature, f] * value
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x**2, n))
        return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, bounds, _ in chunks(batch, "__text"):
            doc, feature, value = features(data, bounds)
            cuts = pa.array(np.searchsorted(doc, np.arange(len(rows) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column("order"), rows.column("label"), pa.ListArray.from_arrays(cuts, pa.array(feature, pa.int16())), pa.ListArray.from_arrays(cuts, pa.array(value, pa.float32()))], names=["order", "label", "feature", "value"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, seed: int = 1) -> Machine:
    """Learns from at most sample of the labelled rows for which usable holds. Only the label column of labels is read beside the key."""
    chosen = labels.where(usable & col(label).isNotNull()).select(col(key).alias("__key"), col(label).cast("int").alias("label")).orderBy(F.xxhash64("__key"), "__key", "label").limit(sample)
    rows = docs.select(col(key).alias("__key"), F.coalesce(col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__key").select(F.xxhash64("__key", "label", "__text").alias("order"), "label", "__text")
    # Features, not texts, go to the driver, and no more rows than the bound even if keys repeat.
    got = rows.mapInArrow(_featured, "order long, label int, feature array<smallint>, value array<float>").orderBy("order").limit(2 * sample).toArrow().combine_chunks().sort_by("order")
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    y = got.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        if len(y):
            machine.bias = 4.0 if y[0] else -4.0
        return machine
    lists = got.column("feature").combine_chunks()
    offsets = lists.offsets.to_numpy()
    feature, value = lists.values.to_numpy().astype(np.int64), got.column("value").combine_chunks().values.to_numpy()
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh the same
    # steps by AdaGrad
    g_bias, g_weights, g_factors = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
    for _ in range(max(PASSES, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            size = offsets[part + 1] - offsets[part]
            doc = np.repeat(np.arange(len(part)), size)
            place = np.repeat(offsets[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            j, x = feature[place], value[place]
            v = machine.factors[j] * x[:, None]
            total = np.stack([np.bincount(doc, v[:, f], len(part)) for f in range(RANK)], axis=1)
            square = np.stack([np.bincount(doc, v[:, f] ** 2, len(part)) for f in range(RANK)], axis=1)
            z = machine.bias + np.bincount(doc, machine.weights[j] * x, len(part)) + 0.5 * (total**2 - square).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
            d_weights = np.bincount(j, error[doc] * x, SIZE)
            slope = error[doc, None] * x[:, None] * (total[doc] - v)
            touched, inverse = np.unique(j, return_inverse=True)
            d_factors = np.stack([np.bincount(inverse, slope[:, f], len(touched)) for f in range(RANK)], axis=1) + 1e-5 * machine.factors[touched]
            g_bias += error.sum() ** 2
            machine.bias -= 0.1 * error.sum() / np.sqrt(g_bias)
            g_weights += d_weights**2
            machine.weights -= 0.2 * d_weights / np.sqrt(g_weights)
            g_factors[touched] += d_factors**2
            machine.factors[touched] -= 0.05 * d_factors / np.sqrt(g_factors[touched])
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a double from 0 to 1 under the given name, whose column, if there is one, it replaces."""
    names = [c for c in docs.columns if c.lower() != name.lower()]
    state = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))  # bounded by SIZE and rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine(*state.value)
        for batch in batches:
            for rows, data, bounds, _ in chunks(batch):
                z = fitted.logit(*features(data, bounds), len(rows))
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["row", "score"])

    rows = packed(docs, col(text).alias("text"))
    return rows.mapInArrow(run, with_row(rows, "score double")).select(*unpacked(names), F.col("score").alias(name))
