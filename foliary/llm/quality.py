"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gives ``len(FEATURES)`` numbers, computed on the whole text. Each
feature is cut into at most ``BINS`` bins. Boosting goes round the features in
turn; each step fits a tree of depth two on one feature's bins to the logistic
loss and adds a fraction of it to that feature's lookup table. Then the pairs of
features that explain most of what is left get tables of their own in the same
way. A score is the sigmoid of the sum of the looked-up bins.

The model is fitted on the driver from at most about ``SAMPLE`` labelled rows;
features and scores are computed for all documents where they lie.

Edge cases: a null text counts as empty and is scored like any other; rows that
are equal in doc_id, text and label count once in the fit, different ones under
one doc_id each; labels other than 0 and 1 are ignored; without labels of both
kinds every score is the share of label 1 (0.5 if none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import shared
from foliary.llm.labels import bounded, bounded_rows, held_out, training_rows

#: Bound of the labelled rows that the model is fitted on.
SAMPLE = 40_000
BINS = 32
ROUNDS = 150
PAIRS = 8
PAIR_ROUNDS = 60
RATE = 0.1
THRESHOLD = 0.3
CHUNK_BYTES = 2_000_000
FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "space", "newline", "bang", "bar", "stop", "comma", "symbol", "high",
    "word_mean", "word_spread", "distinct_words", "capital_words", "symbol_words", "short_words", "long_words", "top_word",
    "log_lines", "distinct_lines", "line_mean", "ended_lines",
)
_CLASSES = np.full(256, 8, np.uint8)  # 8: symbols
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[0x20, 0x09]] = 3
_CLASSES[[0x0A, 0x0D]] = 4
_CLASSES[ord("!")] = 5
_CLASSES[ord("|")] = 6
_CLASSES[[ord(c) for c in ".?:"]] = 7
_CLASSES[[ord(c) for c in ",;'\"()-"]] = 9
_CLASSES[0x80:] = 10


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int):
    """Distinct keys of each document, and the count of its most frequent one."""
    with np.errstate(over="ignore"):
        own = shared.mix64(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, index, count = np.unique(own, return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc[index], count)
    return np.bincount(doc[index], minlength=n), top


def features_of(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of features for each of some texts laid end to end."""
    n = len(offsets) - 1
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    size = np.diff(offsets)
    buffer = np.full(len(data) + n, 0x0A, np.uint8)
    owner = np.repeat(np.arange(n), size)
    buffer[np.arange(len(data)) + owner] = data
    kinds = _CLASSES[data]
    count = np.bincount(owner * 11 + kinds, minlength=11 * n).reshape(n, 11)
    hashes = shared.RollingHash(buffer)
    bounds = offsets + np.arange(n + 1)

    white = (_CLASSES[buffer] == 3) | (_CLASSES[buffer] == 4)
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(bounds, start, "right") - 1
    words = np.bincount(doc, minlength=n)
    length = (end - start).astype(np.float64)
    total, squares = np.bincount(doc, length, n), np.bincount(doc, length**2, n)

    def inside(mask):
        prefix = np.concatenate([[0], np.cumsum(mask)])
        return prefix[end] - prefix[start]

    wide = _CLASSES[buffer]
    upper, lower, symbol = inside(wide == 1), inside(wide == 0), inside((wide == 8) | (wide == 5))
    per_word = lambda mask: np.bincount(doc, mask, n) / np.maximum(words, 1)
    distinct, top = _distinct(hashes.of(start, end), doc, n)

    line_end = np.flatnonzero(buffer == 0x0A)
    line_start = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(bounds, line_start, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    distinct_lines, _ = _distinct(hashes.of(line_start, line_end), line_doc, n)
    ended = np.isin(_CLASSES[buffer[line_end - 1]], (5, 7)) if len(line_end) else np.zeros(0)
    share = lambda i: count[:, i] / np.maximum(size, 1)
    mean = total / np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), share(1), share(2), share(3), share(4), share(5), share(6), share(7), share(9), share(8), share(10),
        mean, np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0)), distinct / np.maximum(words, 1),
        per_word((upper > 1) & (lower == 0)), per_word(symbol > 0), per_word(length <= 2), per_word(length >= 15), top / np.maximum(words, 1),
        np.log1p(lines), distinct_lines / np.maximum(lines, 1), np.bincount(line_doc, line_end - line_start, n) / np.maximum(lines, 1), np.bincount(line_doc, ended, n) / np.maximum(lines, 1),
    ]).astype(np.float32)


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, x: the features of every document's whole text, and a hash of doc_id and text."""

    def run(batches):
        for batch in batches:
            offsets, data, _ = shared._string_buffers(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
                x = features_of(offsets[at : to + 1], data)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), batch.column("row_key").slice(at, to - at), values], names=["doc_id", "row_key", "x"])
                at = to

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, x array<float>")


# ---------------------------------------------------------------------- model


def _best_cut(g: np.ndarray, h: np.ndarray):
    """(gain, cut) of the best split of a row of bins; the cut is the first bin of the right side."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1.0) + (all_g - left_g) ** 2 / (all_h - left_h + 1.0) - all_g**2 / (all_h + 1.0)
    if not len(gain):
        return 0.0, 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return g.sum() / (h.sum() + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over bins, as a value for each bin."""
    out = np.empty(len(g))
    _, cut = _best_cut(g, h)
    for a, b in ((0, cut), (cut, len(g))):
        if a < b:
            _, inner = _best_cut(g[a:b], h[a:b])
            for c, d in ((a, a + inner), (a + inner, b)):
                if c < d:
                    out[c:d] = _leaf(g[c:d], h[c:d])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree over a grid: one cut along an axis, then one along the other on each side."""
    best = (-1.0, np.zeros(g.shape))
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        _, cut = _best_cut(gg.sum(1), hh.sum(1))
        value, gain = np.zeros(gg.shape), 0.0
        for a, b in ((0, cut), (cut, len(gg))):
            if a < b:
                row_g, row_h = gg[a:b].sum(0), hh[a:b].sum(0)
                _, inner = _best_cut(row_g, row_h)
                for c, d in ((0, inner), (inner, gg.shape[1])):
                    if c < d:
                        value[a:b, c:d] = _leaf(row_g[c:d], row_h[c:d])
                        gain += row_g[c:d].sum() ** 2 / (row_h[c:d].sum() + 1.0)
        if gain > best[0]:
            best = (gain, value if axis == 0 else value.T)
    return best


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE):
        width = x.shape[1]
        share = y.mean() if len(y) else 0.5
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.base = float(np.log(share / (1 - share))) if 0 < share < 1 else None
        self.constant = float(share)
        if self.base is None:
            return
        bins = self._bins(x)
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            for j in range(width):
                g, h = self._gradients(margin, y)
                n = len(self.tables[j])
                step = rate * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
                self.tables[j] += step
                margin += step[bins[j]]
        g, h = self._gradients(margin, y)
        gains = []
        for i in range(width):
            for j in range(i + 1, width):
                shape = (len(self.tables[i]), len(self.tables[j]))
                cell = bins[i] * shape[1] + bins[j]
                gain, _ = _pair_tree(*(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (g, h)))
                gains.append((gain, i, j))
        gains.sort(key=lambda t: (-t[0], t[1], t[2]))
        self.pairs = [(i, j) for _, i, j in gains[:pairs]]
        self.pair_tables = [np.zeros((len(self.tables[i]), len(self.tables[j]))) for i, j in self.pairs]
        for _ in range(pair_rounds):
            for table, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
                g, h = self._gradients(margin, y)
                cell = bins[i] * table.shape[1] + bins[j]
                _, value = _pair_tree(*(np.bincount(cell, w, table.size).reshape(table.shape) for w in (g, h)))
                table += rate * value
                margin += rate * value.ravel()[cell]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    @staticmethod
    def _gradients(margin, y):
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is None:
            return np.full(len(x), self.constant)
        bins = self._bins(x)
        margin = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            margin += table[b]
        for table, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
            margin += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-margin))


def train(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fit the model on a bounded sample of the labelled rows that aren't held out."""
    rows = bounded(training_rows(labels, "quality").distinct(), sample)
    known = bounded_rows(features.join(rows, "doc_id").select("doc_id", "row_key", "x", "y"), sample, "row_key", "y").toPandas()
    if not len(known):
        return AdditiveModel(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(known["x"].to_numpy()).astype(np.float32), known["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y, known["doc_id"].to_numpy()))  # sums don't depend on how the rows arrived
    return AdditiveModel(x[order], y[order])


def score(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, row_key, score of every row of features."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)) if batch.num_rows else np.zeros((0, len(FEATURES)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(model.score(x))], names=["doc_id", "row_key", "score"])

    return features.mapInArrow(run, "doc_id long, row_key long, score double")


def scores_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, row_key, score of every document."""
    features = shared.materialise(text_features(docs))
    return score(features, train(features, labels, sample))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scores = scores_of(docs, labels, sample)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
