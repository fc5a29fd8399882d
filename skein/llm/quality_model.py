"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and so has every chosen pair of features. The tables
are learnt by cyclic boosting: one feature after the other, round upon round, a shallow tree on that
feature's bins (two cuts) moves its table a little towards the remaining error; then the same over the
pairs that a first pass finds to interact most (one cut on the one feature, one on the other in each
half). A score is the sum of one entry of each table, so scoring is binning and adding.

The model is fitted on the driver on a bounded sample of labelled rows (TRAIN_ROWS, those of least
hash), features are measured over all whole texts.

Defined results: a null or empty text has features of 0 and gets a score like any other; labels that
name a document more than once count by majority, ties as good; without labels, or with one class
only, every score is the share of good labels (0.5 without any); an empty table gives no rows; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import crc_mod, long_rows, written
from skein.llm.quality_rules import _Numbers, repeat_words

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
FEATURES = ["words", "word_length", "symbols", "upper", "marks", "digits", "bars", "repeated_lines", "repeated_words", "distinct", "short_words", "line_length", "odd_ends", "top_word", "sentence_length", "entropy", "accents", "top_three"]
_CONT, _SPACE = bytes(range(0x80, 0xC0)), b" \t\n\x0b\x0c\r"
_KINDS = [b"#*$%&<>{}[]~^_=+\\@", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789", b"|"]
_ODD_END = re.compile(rb"[^\w\s.,;:!?'\")\x80-\xff](?=\s|$)")


def features(text: bytes) -> list[float]:
    words = text.split()  # on the six ASCII separators
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    size = len(text) - len(text.translate(None, _CONT))
    chars = len(text.translate(None, _CONT + _SPACE))
    kinds = [(len(text) - len(text.translate(None, k))) / chars for k in _KINDS]
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.sort(np.bincount(ids))[::-1]
    p = counts / n
    return [
        np.log1p(n), chars / n, *kinds,
        1 - len(set(lines)) / len(lines), repeat_words(ids) / n, len(counts) / n,
        sum(len(w) <= 3 for w in words) / n, np.log1p(chars / len(lines)), len(_ODD_END.findall(text)) / n,
        p[0], n / (1 + text.count(b".") + text.count(b"!") + text.count(b"?")),
        float(-(p * np.log2(p)).sum() / np.log2(max(2, min(n, 512)))), size / chars, float(p[:3].sum()),
    ]


def _cuts(g: np.ndarray, h: np.ndarray, cuts: int, smooth: float) -> np.ndarray:
    """Leaf values over the bins of a tree with so many cuts, each where it gains most."""
    edges, values = [0, len(g)], np.zeros(len(g))
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                left, right = (sg[k] - sg[a]) ** 2 / (sh[k] - sh[a] + smooth), (sg[b] - sg[k]) ** 2 / (sh[b] - sh[k] + smooth)
                gain = left + right - (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + smooth)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), int(k[at])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    for a, b in zip(edges, edges[1:], strict=False):
        values[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + smooth)
    return values


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """Leaf values over a grid, and the gain: the best cut on one axis, then one on the other in each half."""
    out, most = np.zeros_like(g), 0.0
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(1, len(a)):
            halves = [_cuts(a[s].sum(0), b[s].sum(0), 1, smooth) for s in (slice(0, k), slice(k, None))]
            gain = sum(float((v * a[s].sum(0)).sum()) for v, s in zip(halves, (slice(0, k), slice(k, None)), strict=True))
            if gain > most:
                grid = np.vstack([np.tile(halves[0], (k, 1)), np.tile(halves[1], (len(a) - k, 1))])
                out, most = (grid.T if turn else grid), gain
    return out, most


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 1 / (1 + np.exp(-self.intercept)))
        b = self.bins(x)
        total = self.intercept + sum(t[b[:, j]] for j, t in enumerate(self.tables))
        for i, j, table in self.pairs:
            total = total + table[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, pair_rounds: int = 12, n_pairs: int = 6, rate: float = 0.15, smooth: float = 2.0) -> Model:
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < mean < 1:
        return Model(float(np.log((mean + 1e-6) / (1 - mean + 1e-6))), [], [], [], 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coarse = bins // 8
    model = Model(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse)
    b, total = model.bins(x), np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _cuts(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), 2, smooth)
            table += step
            total += step[b[:, j]]
    c = b // coarse
    shape = [int(len(e) // coarse + 1) for e in edges]

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = c[:, i] * shape[j] + c[:, j]
        return tuple(np.bincount(at, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h))

    g, h = slopes()
    gains = [(_pair_tree(*grids(i, j, g, h), smooth)[1], i, j) for i in range(len(edges)) for j in range(i)]
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _pair_tree(*grids(i, j, *slopes()), smooth)[0]
            table += step
            total += step[c[:, i], c[:, j]]
    return model


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and f, the features of the whole text."""

    def run(batches):
        import pyarrow as pa

        from skein.llm.tokens import slices

        for part in slices(batches):
            rows = [features(t or b"") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "f"])

    long_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, f array<double>")


def scored(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted; learns from rows whose crc_mod isn't ``held``."""
    rows = written(measured(docs), "features")
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), mod) != held))
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    sample = rows.join(F.broadcast(marks), "doc_id").select("doc_id", "f", "good").orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(TRAIN_ROWS).toPandas()
    x = np.array(sample["f"].tolist(), float).reshape(-1, len(FEATURES))
    model = fit(x, sample["good"].to_numpy(float))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            f = batch.column("f").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.score(f)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", (crc_mod(F.col("doc_id"), mod) == held).alias("held_out"), "f").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
