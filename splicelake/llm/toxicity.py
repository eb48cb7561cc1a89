"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from splicelake.llm.labelled import labelled_sample
from splicelake.llm.tokenizer import slices

#: Features are hashed to this many bits.
BITS = 20
#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
REMEMBERED = 400_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _PUNCTUATION, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_PUNCTUATION))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Features:
    """Hashed features of texts: words, pairs of neighbours, and pairs with one word between.

    Words are lower-cased (A-Z) and end at ASCII white space or punctuation.
    """

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint64(64 - bits), _Hashes()

    def of(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Feature of each occurrence, and the number of the text that it is in, both unordered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [(t or "").encode().translate(_FOLD).split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
        doc = np.repeat(np.arange(len(words)), n)
        found, where = [h * np.uint64(0x9E3779B97F4A7C15)], [doc]
        for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            if len(h) > gap:
                same = doc[gap:] == doc[:-gap]
                mixed = (h[:-gap] * np.uint64(odd)) ^ (h[gap:] >> np.uint64(29)) + h[gap:]
                found.append((mixed * np.uint64(0x9E3779B97F4A7C15))[same])
                where.append(doc[gap:][same])
        return (np.concatenate(found) >> self.shift).astype(np.int64), np.concatenate(where)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates and L1, one document at a time; feature values are 1."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = float(_sigmoid(w.sum() + self.bias())) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        bias = self.bias()
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * bias
        self.bias_n += g * g


def _sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    """The features whose weights are not 0, at most 2 ** bits of them."""

    bits: int
    at: np.ndarray
    weight: np.ndarray
    bias: float


def fit(
    docs: DataFrame, labels: DataFrame, *, only: Column | None = None, target: str = "toxic", rows: int = TRAIN_ROWS,
    bits: int = BITS, epochs: int = 6, l1: float = 4.0, l2: float = 0.1, alpha: float = 1.0,
) -> Model:
    """Fits on up to ``rows`` labelled documents, whole texts; ``only`` keeps labels out of training.

    Executors turn texts into sorted distinct features; one task, whose input ``rows`` bounds, learns from them in an
    order that hashed ids decide. Without labelled rows every weight is 0 and every score one half.
    """

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for part in slices(texts):
                at, doc = features.of(part)
                key = np.unique((doc << bits) | at)
                ends = np.searchsorted(key, np.arange(1, len(part) + 1) << bits)
                key = (key & ((1 << bits) - 1)).astype("<u4")
                out += [key[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["_order", "_label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(at, "<u4"), label) for b in batches for label, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = Ftrl(1 << bits, alpha=alpha, l1=l1, l2=l2)
        for _ in range(epochs):
            for at, label in held:
                model.learn(at, label)
        at = np.flatnonzero(np.abs(model.z) > model.l1)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(model.weights(at), model.bias()), pa.float64())], ["at", "weight"])

    sample = labelled_sample(docs, labels, target, rows, only).select("text", "_order", "_label")
    held = sample.mapInArrow(featurize, "_order long, _label int, at binary").repartition(1).sortWithinPartitions("_order", "_label", "at")
    found = held.select("_label", "at").mapInArrow(learn, "at long, weight double").toPandas().sort_values("at")
    bias = float(found["weight"].iloc[0]) if len(found) else 0.0
    return Model(bits, found["at"].to_numpy()[1:], found["weight"].to_numpy()[1:], bias)


def score(docs: DataFrame, model: Model, *, out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1. A feature counts once a text, however often it is there.

    Null and empty texts get the model's prior. Repeated rows are scored alike; an empty table gives an empty one; a
    column named ``out`` is replaced. The whole text is scored, whatever its length.
    """
    docs = docs.drop(out)
    text_at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << model.bits)
        weight[model.at] = model.weight
        features = Features(model.bits)
        for batch in batches:
            sums = []
            for part in slices(batch.column(text_at).to_pylist()):
                at, doc = features.of(part)
                used = weight[at] != 0
                key = np.unique((doc[used] << model.bits) | at[used])
                sums.append(np.bincount(key >> model.bits, weight[key & ((1 << model.bits) - 1)], len(part)))
            p = _sigmoid(np.concatenate([*sums, np.zeros(0)]) + model.bias)
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)
