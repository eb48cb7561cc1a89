"""Quality rules: document statistics, and gradient-boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from splicelake.llm.labelled import labelled_sample

#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
WINDOW, MIN_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature -> 0, or -1 where a greater value may only lower the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines": -1, "repeated": -1, "digits": 0, "capitals": 0,
    "punctuation": 0, "distinct_words": 0, "line_words": 0, "stop_marks": 0, "long_words": 0,
}
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS, np.uint8)
_PUNCTUATION = np.frombuffer(b"!\"'(),-./:;?[]_`{}~^@+=\\", np.uint8)
_STOP = np.frombuffer(b".!?", np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of BASE and the values of FEATURES, of the whole text. Null is an empty text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(count[0x80:0xC0].sum())
    chars = points - int(count[_SPACE].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    place: dict[bytes, int] = {}
    ids = [place.setdefault(w, len(place)) for w in words]
    if n > WINDOW and len(place) < n:
        a = np.array(ids, np.uint64)
        windows = n - WINDOW + 1
        h = np.zeros(windows, np.uint64)
        for k in range(WINDOW):
            h = (h + a[k : k + windows] + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        if again.any():
            edge = np.zeros(n + 1, np.int64)
            edge[:windows] += again
            edge[WINDOW : WINDOW + windows] -= again
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    symbols = int(count[_SYMBOL].sum())
    one, c = max(n, 1), max(chars, 1)
    long_words = sum(len(w) > 12 for w in place)
    return (
        [n, chars, symbols, len(lines) - len(set(lines)), repeated],
        [
            float(np.log1p(n)), chars / one, symbols / one, (len(lines) - len(set(lines))) / max(len(lines), 1), repeated / one,
            float(count[48:58].sum()) / c, float(count[65:91].sum()) / c, float(count[_PUNCTUATION].sum()) / c, len(place) / one,
            n / max(len(lines), 1), float(count[_STOP].sum()) / one, long_words / max(len(place), 1),
        ],
    )


@dataclass(frozen=True)
class Trees:
    """Boosted trees as flat node arrays. A leaf is its own child on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.value[node].sum(1) + self.prior)))


def boost(
    x: np.ndarray, y: np.ndarray, monotone: Sequence[int], *, trees: int = 80, depth: int = 4, rate: float = 0.1,
    bins: int = 64, l2: float = 1.0, least: float = 20.0,
) -> Trees:
    """Boosted trees for the logistic loss over binned features.

    A split on a feature of sign s must give its children values in that order, and each child's values stay on its side
    of the middle of the two, so scores are monotonic in that feature. Without rows of both labels there are no splits.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, m), np.int64)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    prior = float(np.log(p / (1 - p)))
    total = np.full(n, prior)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees if n and 0 < y.sum() < n else 1):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, q * (1 - q)

        def grow(rows: np.ndarray, low: float, high: float, level: int) -> int:
            at = len(nodes)
            sum_g, sum_h = g[rows].sum(), h[rows].sum()  # noqa: B023
            value = float(np.clip(-sum_g / (sum_h + l2), low, high))
            nodes.append([0, 0.0, at, at, rate * value])
            best = (1e-9, 0, 0, 0.0, 0.0)
            if level < depth:
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    size = len(edges[j]) + 1
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], size))[:-1]  # noqa: B023
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], size))[:-1]  # noqa: B023
                    vl = np.clip(-gl / (hl + l2), low, high)
                    vr = np.clip(-(sum_g - gl) / (sum_h - hl + l2), low, high)
                    loss = lambda G, H, v: G * v + 0.5 * (H + l2) * v * v
                    gain = loss(sum_g, sum_h, value) - loss(gl, hl, vl) - loss(sum_g - gl, sum_h - hl, vr)
                    gain[(hl < least / 4) | (sum_h - hl < least / 4) | (monotone[j] * (vr - vl) < 0)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            gain, j, k, vl, vr = best
            if gain > 1e-9:
                goes = code[rows, j] <= k
                middle = (vl + vr) / 2
                bounds = ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle)) if monotone[j] < 0 else ((low, high),) * 2
                nodes[at][:2] = [j, float(edges[j][k])]
                nodes[at][2] = grow(rows[goes], *bounds[0], level + 1)
                nodes[at][3] = grow(rows[~goes], *bounds[1], level + 1)
            else:
                total[rows] += rate * value
            return at

        roots.append(grow(np.arange(n), -np.inf, np.inf, 0))
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), depth, prior)


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fits on up to ``rows`` labelled documents. Executors make the statistics; the driver gets these few numbers of the
    sampled rows only. Documents that fail the base rules are no examples for the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array([_fails(b) for b, _ in found], pa.bool_()), pa.array([f for _, f in found], pa.list_(pa.float64()))], ["_order", "_label", "failed", "x"])

    sample = labelled_sample(docs, labels, target, rows).select("text", "_order", "_label")
    held = sample.mapInArrow(run, "_order long, _label int, failed boolean, x array<double>").where("not failed").toPandas()
    held = held.assign(_key=[tuple(v) for v in held["x"]]).sort_values(["_order", "_label", "_key"])
    x = np.array(held["x"].tolist(), float).reshape(len(held), len(FEATURES))
    return boost(x, held["_label"].to_numpy(float), list(FEATURES.values()))


def _fails(base: Sequence[int]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MOST_REPEATED * base[0]


def judge(docs: DataFrame, trees: Trees, *, least: float = 0.5) -> DataFrame:
    """``docs`` with the counts of BASE, ``base_failed``, ``quality`` (0 to 1) and ``kept``.

    A document is kept if it passes the base rules (10 words or more; at most a fifth of its words in windows of five
    words that come again) and scores ``least`` or more. Null and empty texts have no words, so they fail. Columns of
    these names are replaced; other columns pass through; repeated rows are judged alike; an empty table gives an empty
    one.
    """
    docs = docs.drop(*BASE, "base_failed", "quality", "kept")
    at = docs.columns.index("text")
    more = [*(StructField(name, LongType()) for name in BASE), StructField("base_failed", BooleanType()), StructField("quality", DoubleType()), StructField("kept", BooleanType())]
    schema = StructType([*docs.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(at).to_pylist()]
            base = np.array([b for b, _ in found], np.int64).reshape(len(found), len(BASE))
            failed = np.array([_fails(b) for b, _ in found], bool)
            quality = trees.score(np.array([f for _, f in found], float).reshape(len(found), len(FEATURES)))
            added = [*(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= least))]
            yield pa.record_batch([*batch.columns, *added], names=schema.names)

    return docs.mapInArrow(run, schema)
