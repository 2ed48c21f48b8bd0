"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (label 1) are the positives; all other text, whatever its
label, is unlabelled. A text is the set of its words and of their first four,
five and six bytes, hashed into ``2**BUCKET_BITS`` buckets, each at the levels
it reaches: present, twice, four times, one in ``DENSE`` words.

1. Counts over a bounded sample of the positives give candidate features;
   how many documents hold each candidate is counted over the whole corpus.
   Of the candidates that are commoner among the positives by more than chance
   over all candidates allows, the ``FEATURES`` clearest are kept.
2. ``MODELS`` linear classifiers are trained in numpy, each on the positives
   and its own part of the unlabelled sample, with the non-negative estimator of
   the risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second
   term is negative in a batch, its gradient is reversed. The prior is the share
   of label 1 among the labels that aren't held out.
3. Every whole text is scored by the mean of the classifiers.

Edge cases: null and empty texts have no features and score by the bias alone;
rows that are equal in doc_id and text count once in the fit; labels other than 0
and 1 are ignored; without positives every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import shared
from foliary.llm.labels import bounded, bounded_rows, held_out, training_rows

#: Bounds of the positives and of the unlabelled rows that the classifiers are fitted on.
POSITIVES = 6_000
UNLABELLED = 18_000
BUCKET_BITS = 20
FEATURES = 3_000
LEAST_POSITIVES = 3
TIMES = (1, 2, 4)
DENSE = (200, 60)
LEVELS = len(TIMES) + len(DENSE)
MODELS = 3
EPOCHS = 30
THRESHOLD = 0.5
CHUNK_BYTES = 2_000_000
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def buckets_of(offsets: np.ndarray, data: np.ndarray):
    """(document, bucket) of every word and word beginning of some texts laid end to end; repeats included."""
    n = len(offsets) - 1
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    buffer = np.zeros(len(data) + n, np.uint8)
    buffer[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    inside = np.concatenate([[False], _WORD[buffer], [False]])
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(offsets + np.arange(n + 1), start, "right") - 1
    hashes = shared.RollingHash(buffer)
    docs, keys = [doc], [hashes.of(start, end)]
    for size in (4, 5, 6):
        long = np.flatnonzero(end - start > size)
        docs.append(doc[long])
        keys.append(hashes.of(start[long], start[long] + size) ^ np.uint64(0x5851F42D4C957F2D * size & (1 << 64) - 1))
    bucket = (np.concatenate(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.concatenate(docs), bucket, np.bincount(doc, minlength=n)


def levels_of(doc: np.ndarray, bucket: np.ndarray, words: np.ndarray, wanted: np.ndarray | None):
    """Distinct (document, feature) pairs in order; ``wanted`` numbers the features to keep (-1: none)."""
    if wanted is not None:
        some = (wanted.reshape(LEVELS, -1) >= 0).any(axis=0)[bucket]
        doc, bucket = doc[some], bucket[some]
    pair, count = np.unique(doc << BUCKET_BITS | bucket, return_counts=True)
    doc, bucket = pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)
    reached = [count >= t for t in TIMES] + [count * d >= words[doc] for d in DENSE]
    docs = np.concatenate([doc[r] for r in reached])
    features = np.concatenate([bucket[r] + (level << BUCKET_BITS) for level, r in enumerate(reached)])
    if wanted is not None:
        features = wanted[features].astype(np.int64)
        docs, features = docs[features >= 0], features[features >= 0]
    order = np.lexsort((features, docs))
    return docs[order], features[order]


def _chunks(batch):
    offsets, data, _ = shared._string_buffers(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, *buckets_of(offsets[at : to + 1], data)
        at = to


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))


def _sets(texts: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    """The features of each text that ``chosen`` numbers, in the order of doc_id, for a bounded number of texts."""

    def run(batches):
        for batch in batches:
            for at, to, doc, bucket, words in _chunks(batch):
                doc, feature = levels_of(doc, bucket, words, chosen)
                ends = np.searchsorted(doc, np.arange(to - at + 1))
                sets = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(sets, pa.binary())], names=["doc_id", "features"])

    rows = texts.mapInArrow(run, "doc_id long, features binary").toPandas().sort_values(["doc_id", "features"])
    return [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["features"]]


def _document_counts(texts: DataFrame, candidate: np.ndarray | None, least: int = 1) -> np.ndarray:
    """Texts that hold each feature (each candidate only, if given), where they are ``least`` at least."""
    size = LEVELS << BUCKET_BITS
    listed = np.flatnonzero(candidate) if candidate is not None else np.zeros(0, np.int64)
    number = None
    if candidate is not None:
        number = np.full(size, -1, np.int32)
        number[listed] = np.arange(len(listed))
    width = size if candidate is None else len(listed)

    def run(batches):
        total = np.zeros(width, np.int32)
        for batch in batches:
            for _, _, doc, bucket, words in _chunks(batch):
                np.add.at(total, levels_of(doc, bucket, words, number)[1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["feature", "n"])

    rows = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    out = np.zeros(size, np.int64)
    at = rows["feature"].to_numpy()
    out[at if candidate is None else listed[at]] = rows["n"].to_numpy()
    return out


class PuClassifier:
    """Mean of linear classifiers trained with the non-negative positive-unlabelled risk."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, models: int = MODELS, epochs: int = EPOCHS):
        self.weights = [self._fit(positive, unlabelled[m::models] or unlabelled, width, prior, epochs, m) for m in range(models)]

    @staticmethod
    def _fit(positive, unlabelled, width, prior, epochs, seed):
        rng = np.random.default_rng(seed)
        w, m1, m2 = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
        w[-1] = np.log(prior / (1 - prior))
        batches = max(1, (len(positive) + len(unlabelled)) // 512)
        step = 0
        for _ in range(epochs):
            p_parts = np.array_split(rng.permutation(len(positive)), batches)
            u_parts = np.array_split(rng.permutation(len(unlabelled)), batches)
            for pi, ui in zip(p_parts, u_parts, strict=True):
                if not len(pi) or not len(ui):
                    continue
                _, grad = PuClassifier.risk(w, [positive[i] for i in pi], [unlabelled[i] for i in ui], prior)
                grad[:-1] += 1e-5 * w[:-1]
                step += 1
                m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
                w -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return w

    @staticmethod
    def risk(w, positive, unlabelled, prior):
        """The non-negative risk of some sets, and the direction to descend: its gradient, or, where its second term is negative, that term's reversed."""
        zp, rows_p, cols_p = PuClassifier._margin(w, positive)
        zu, rows_u, cols_u = PuClassifier._margin(w, unlabelled)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        if negative >= 0:
            gp, gu = (prior * (sp - 1) - prior * sp) / len(zp), su / len(zu)
        else:  # step back from the negative risk
            gp, gu = prior * sp / len(zp), -su / len(zu)
        grad = np.zeros(len(w))  # sums of no rows at all come as integers
        grad += np.bincount(cols_p, gp[rows_p], len(w))
        grad += np.bincount(cols_u, gu[rows_u], len(w))
        grad[-1] = gp.sum() + gu.sum()
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, negative), grad

    @staticmethod
    def _margin(w, sets):
        size = np.array([len(x) for x in sets])
        cols = np.concatenate(sets).astype(np.int64) if size.sum() else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(sets)), size)
        return np.bincount(rows, w[cols], len(sets)) + w[-1], rows, cols

    def score(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents from their distinct (document, feature) pairs."""
        return np.mean([1 / (1 + np.exp(-(np.bincount(doc, w[feature], n) + w[-1]))) for w in self.weights], axis=0)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """(numbers of the kept buckets, classifier); None without positives."""
    known = training_rows(labels, "toxic")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    prior = min(max(counts[1] / sum(counts.values()), 1e-4), 0.9)
    toxic = known.where("y = 1").select("doc_id").distinct()
    sample = bounded(toxic, positives)
    # at most about `positives` ids: their size is bounded
    confirmed = bounded_rows(_texts(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")), positives, "doc_id", "text")
    n_positive = confirmed.count()
    if not n_positive:
        return None
    in_positive = _document_counts(confirmed, None, min(LEAST_POSITIVES, n_positive))
    candidate = in_positive > 0
    n_docs = docs.count()
    share_u = (_document_counts(_texts(docs), candidate) + 0.5) / (n_docs + 1)
    # evidence that a bucket is commoner among positives, against the number of buckets tried
    expected = share_u * n_positive
    gain = np.where(candidate & (in_positive > expected), in_positive * np.log(np.maximum(in_positive, 1) / expected) - in_positive + expected, 0.0)
    best = np.lexsort((np.arange(len(gain)), -gain))[:FEATURES]
    best = best[gain[best] > np.log(max(1, candidate.sum())) + 1]
    chosen = np.full(LEVELS << BUCKET_BITS, -1, np.int32)
    chosen[best] = np.arange(len(best))
    rest = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    p = _sets(confirmed, chosen)
    u = _sets(bounded_rows(_texts(bounded(rest, unlabelled, n_docs)), unlabelled, "doc_id", "text"), chosen) or [np.zeros(0, np.int64)]
    return chosen, PuClassifier(p, u, len(best), prior)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every document's whole text."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    chosen, classifier = model

    def run(batches):
        for batch in batches:
            for at, to, doc, bucket, words in _chunks(batch):
                values = classifier.score(*levels_of(doc, bucket, words, chosen), to - at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(values)], names=["doc_id", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scores = score(docs, train(docs, labels))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
