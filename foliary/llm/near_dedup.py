"""MinHash near-dedup by improved consistent weighted sampling.

A document is its word shingles (``WORDS`` consecutive words, lower-cased), each
weighing its number of occurrences times the mean inverse document frequency of
its words, counted over all documents in a hashed table of fixed size. Weights
by word, not by shingle, keep what copies share from growing cheap as a group of
copies grows.

1. Documents with the same words are copies: one key, and one signature of
   ``BANDS * ROWS`` consistent weighted samples.
2. Keys that agree on a whole band share a bucket. Buckets are dealt into chunks
   of about ``CHUNK`` keys, the bucket's least key being in all of them. Chunks
   estimate similarity from the signatures and name the edges of a maximum
   spanning forest, and each key's nearest, at ``LOWEST`` or more: as many pairs
   as keys, not all pairs of a bucket.
3. Named pairs are verified by exact weighted Jaccard similarity of their sets.
4. Buckets whose keys aren't all linked by then are compared whole: every two
   keys of different components that share a band and are estimated at
   ``LOWEST`` or more are verified, too, unless links found meanwhile join them.
   Buckets are cut into blocks of about ``BLOCK`` keys and every two blocks meet
   in a task. So no pair that shares a band is left out but by its estimate.
5. Connected components of the verified pairs are the classes; a class is known
   by its smallest doc_id.

A band of ``ROWS`` at the threshold 0.8 agrees with chance 0.41, one of the
``BANDS`` with chance 0.999.

Edge cases: null texts, empty texts and texts without words are copies of each
other; texts of fewer words than a shingle are one shingle; a null doc_id is the
largest; equal rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import shared
from foliary.llm.components import components
from foliary.llm.decontaminate import terms_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
LOWEST = 0.6
CHUNK = 64
#: Keys of a block of a bucket that is compared whole, and bytes of sets a call holds about: those of one meeting of two blocks.
BLOCK = 256
SET_BYTES = 2_000_000
#: Buckets of the hashed table of document frequencies.
TERM_BITS = 18
CHUNK_BYTES = 2_000_000
_NULL_ID = (1 << 63) - 1
_LEVELS = 4096


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def _chunks(batch):
    offsets, data, nulls = shared._string_buffers(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, *terms_of(offsets[at : to + 1], data, nulls[at:to])
        at = to


def word_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket of words, over all documents."""

    def run(batches):
        total = np.zeros(1 << TERM_BITS, np.int64)
        n = 0
        for batch in batches:
            for at, to, terms, words in _chunks(batch):
                doc = np.repeat(np.arange(to - at), words)
                pair = np.unique(doc << TERM_BITS | (terms >> np.uint64(64 - TERM_BITS)).astype(np.int64))
                total += np.bincount(pair & ((1 << TERM_BITS) - 1), minlength=len(total))
                n += to - at
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["bucket", "n"])

    rows = _texts(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros((1 << TERM_BITS) + 1)
    count[rows["bucket"]] = rows["n"]
    return (1 + np.log((1 + count[-1]) / (1 + count[:-1]))).astype(np.float32)


def shingle_sets(terms: np.ndarray, words: np.ndarray, weights: np.ndarray, size: int):
    """Distinct shingles of some documents in order of (document, shingle): document, shingle, weight."""
    n = len(words)
    first = np.concatenate([[0], np.cumsum(words)])
    rolling = shared.RollingHash(terms)
    weight = np.concatenate([[0], np.cumsum(weights[(terms >> np.uint64(64 - TERM_BITS)).astype(np.int64)].astype(np.float64))])
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(n), count)
    start = first[doc] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(start + size, first[doc + 1])
    shingle = rolling.of(start, end)
    value = (weight[end] - weight[start]) / (end - start)
    order = np.lexsort((shingle, doc))
    doc, shingle, value = doc[order], shingle[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(doc)))
    return doc[heads], shingle[heads], (value[heads] * times).astype(np.float32)


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of equal shares, by bisection."""
    p = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


class WeightedSampler:
    """Consistent weighted samples of weighted sets (Ioffe's scheme)."""

    def __init__(self, samples: int):
        self.gamma = _gamma_table().astype(np.float32)
        self.log_gamma = np.log(_gamma_table()).astype(np.float32)
        self.odd = np.random.default_rng(5).integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, starts: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A row of samples (64-bit) for each set; sets are runs that begin at ``starts``."""
        out = np.zeros((len(starts), len(self.odd)), np.uint64)
        log_weight = np.log(weight)
        size = np.diff(np.append(starts, len(shingle)))
        owner = np.repeat(np.arange(len(starts)), size)
        with np.errstate(over="ignore"):
            for k, odd in enumerate(self.odd):
                u = shingle * odd
                u ^= u >> np.uint64(29)
                u *= np.uint64(0xBF58476D1CE4E5B9)
                r = self.gamma[(u >> np.uint64(52)).astype(np.intp)]
                c = self.log_gamma[((u >> np.uint64(40)) & np.uint64(_LEVELS - 1)).astype(np.intp)]
                beta = ((u >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
                t = np.floor(log_weight / r + beta)
                log_a = c - r * (t - beta + 1)
                least = np.minimum.reduceat(log_a, starts)
                hit = np.flatnonzero(log_a == least[owner])
                pick = hit[np.unique(owner[hit], return_index=True)[1]]
                out[:, k] = shared.mix64(shingle[pick] + t[pick].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        return out


def signatures(docs: DataFrame, weights: np.ndarray, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, key, bands, signature of every document; a document without words has no bands."""
    sampler = WeightedSampler(bands * rows)

    def run(batches):
        for batch in batches:
            for at, to, terms, n_words in _chunks(batch):
                doc, shingle, weight = shingle_sets(terms, n_words, weights, words)
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                sample = sampler.of(starts, shingle, weight) if len(starts) else np.zeros((0, bands * rows), np.uint64)
                band = np.zeros((len(sample), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(rows):
                        band = shared.mix64(band * np.uint64(31) + sample[:, i::rows])
                full = np.full(to - at, -1)
                full[doc[starts]] = np.arange(len(starts))
                short = sample.astype(np.uint32)
                bands_of = [band[i].astype(np.int64).tolist() if i >= 0 else [] for i in full]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), batch.column("text_key").slice(at, to - at), pa.array(_keys(terms, n_words), pa.binary()), pa.array(bands_of, pa.list_(pa.int64())), pa.array([short[i].tobytes() if i >= 0 else b"" for i in full], pa.binary())], names=["doc_id", "text_key", "key", "bands", "signature"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_key long, key binary, bands array<long>, signature binary")


def _keys(terms: np.ndarray, words: np.ndarray) -> list[bytes]:
    """128-bit name of each document's words."""
    first = np.concatenate([[0], np.cumsum(words)])
    a, b = (shared.RollingHash(terms, which).of(first[:-1], first[1:]) for which in (0, 1))
    return [x.tobytes() + y.tobytes() for x, y in zip(a, b, strict=True)]


def _forest(signature: np.ndarray, lowest: float) -> set[tuple[int, int]]:
    """Edges of a maximum spanning forest of estimated similarities, and each row's nearest, at ``lowest`` or more."""
    n = len(signature)
    near = np.array([(signature == row).mean(axis=1) for row in signature])
    np.fill_diagonal(near, -1)
    pairs = {tuple(sorted((i, int(j)))) for i, j in enumerate(near.argmax(axis=1)) if near[i, j] >= lowest}
    best, owner, inside = near[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        best[inside] = -2
        j = int(best.argmax())
        if best[j] >= lowest:
            pairs.add(tuple(sorted((j, int(owner[j])))))
        inside[j] = True
        better = near[j] > best
        owner[better], best[better] = j, near[j][better]
    return pairs


def candidate_pairs(keys: DataFrame, lowest: float = LOWEST, chunk: int = CHUNK) -> DataFrame:
    """a, b: pairs of keys (key, bands, signature) to verify."""
    spark = keys.sparkSession
    member = keys.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = member.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("key").alias("leader")).where("n > 1")
    members = member.join(buckets, ["band", "hash"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    placed = members.select("band", "hash", "key", F.pmod(F.xxhash64("key", "band"), chunks).cast("int").alias("chunk"), (F.col("key") == F.col("leader")).alias("leads"), chunks.alias("chunks"))
    # the leader goes to every chunk of its bucket
    every = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    placed = placed.select("band", "hash", "key", F.explode(every).alias("chunk"))
    placed = shared.materialise(placed.join(keys.select("key", "signature"), "key"))
    parts = max(spark.sparkContext.defaultParallelism, -(-placed.count() // 20_000))
    schema = shared._arrow_schema("a binary, b binary")

    def run(_, table):
        table = table.sort_by([("band", "ascending"), ("hash", "ascending"), ("chunk", "ascending"), ("key", "ascending")])
        name = table.column("key").to_pylist()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(name), -1)
        columns = [table.column(c).to_numpy() for c in ("band", "hash", "chunk")]
        new = np.ones(len(name), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        heads = np.append(np.flatnonzero(new), len(name))
        size = np.diff(heads)
        two = heads[:-1][size == 2]
        two = two[(signature[two] == signature[two + 1]).mean(axis=1) >= lowest] if len(two) else two
        found = {(name[i], name[i + 1]) for i in two}
        for a, b in zip(heads[:-1][size > 2], heads[1:][size > 2], strict=True):
            found |= {(name[a + i], name[a + j]) for i, j in _forest(signature[a:b], lowest)}
        found = sorted(found)
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=schema)

    part = F.pmod(F.xxhash64("band", "hash", "chunk"), F.lit(parts)).alias("part")
    return placed.select("band", "hash", "chunk", "key", "signature", part).groupBy("part").applyInArrow(run, "a binary, b binary").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is ``threshold`` or more."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                keep[i] = similarity(x, y) >= threshold
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(chosen), b.filter(chosen)], names=["a", "b"])

    with_b = pairs.join(sets.select(F.col("key").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _meetings(members: DataFrame) -> DataFrame:
    """``members`` (band, hash, key, n, ...) with x, y, side: a row for every meeting of two blocks of a bucket that holds the key."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("key", "band"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "n")


def _open_pairs(table, lowest: float):
    """For every meeting in ``table``: row numbers and estimates of the pairs to verify, each in the first band that the two share."""
    label = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)[1]
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(table.num_rows, -1)
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    band, side = table.column("band").to_numpy(), table.column("side").to_numpy()
    columns = [table.column(c).to_numpy() for c in ("band", "hash", "x", "y")]
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    heads = np.append(np.flatnonzero(new), len(order))
    within = columns[2] == columns[3]
    for start, end in zip(heads[:-1], heads[1:], strict=True):
        rows = order[start:end]
        alone = within[rows[0]]
        left, right = (rows, rows) if alone else (rows[side[rows] == 0], rows[side[rows] == 1])
        for at, i in enumerate(left):
            others = right[at + 1 :] if alone else right
            others = others[label[others] != label[i]]
            near = (signature[others] == signature[i]).mean(axis=1)
            others, near = others[near >= lowest], near[near >= lowest]
            first = ~(bands[others][:, : band[i]] == bands[i][: band[i]]).any(axis=1)
            if first.any():
                yield i, others[first], near[first]


def further_links(keys: DataFrame, labels: DataFrame, sets_of, threshold: float, lowest: float = LOWEST) -> DataFrame:
    """a, b: links between components (``labels``: node, label) that share a bucket; ``sets_of`` gives key, set of a table of keys."""
    spark = keys.sparkSession
    cores = spark.sparkContext.defaultParallelism
    member = keys.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("key", F.coalesce("label", "key").alias("label"), F.posexplode("bands").alias("band", "hash"))
    # two keys in a bucket have been verified already
    buckets = member.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 AND low <> high").select("band", "hash", "n")
    members = shared.materialise(member.join(buckets, ["band", "hash"]).join(keys.select("key", "bands", "signature"), "key"))

    def dealt(table, parts):
        return table.withColumn("part", F.pmod(F.xxhash64("band", "hash", "x", "y"), F.lit(parts))).groupBy("part")

    def involved(_, table):
        rows = set()
        for i, others, _ in _open_pairs(table, lowest):
            rows.add(int(i))
            rows.update(others.tolist())
        return table.take(pa.array(sorted(rows), pa.int64())).select(["band", "hash", "key"])

    meetings = _meetings(members)
    parts = max(cores, -(-meetings.count() // 5_000))
    wanted = dealt(meetings, parts).applyInArrow(involved, "band int, hash long, key binary").distinct()
    wanted = shared.materialise(wanted.select(F.col("band"), F.col("hash"), F.col("key")))
    sizes = wanted.groupBy("band", "hash").agg(F.count("*").alias("n"))
    again = members.drop("n").join(wanted, ["band", "hash", "key"], "left_semi").join(sizes, ["band", "hash"])
    sets = shared.materialise(sets_of(wanted.select("key").distinct()))
    held = _meetings(again).join(sets, "key")
    parts = max(cores, -(-(held.agg(F.sum(F.length("set"))).first()[0] or 0) // SET_BYTES))
    schema = shared._arrow_schema("a binary, b binary")

    def link(_, table):
        label, key, packed = (table.column(c).to_pylist() for c in ("label", "key", "set"))
        root, found = {}, []

        def top(x):
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for i, others, near in _open_pairs(table, lowest):
            for j in others[np.argsort(-near, kind="stable")]:
                a, b = top(label[i]), top(label[j])
                if a != b and similarity(packed[i], packed[j]) >= threshold:
                    root[a] = b
                    found.append((key[i], key[j]))
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=schema)

    return dealt(held, parts).applyInArrow(link, "a binary, b binary")


def pack_set(shingle: np.ndarray, weight: np.ndarray) -> bytes:
    """A set by its shingles' 64-bit hashes (in order) and its weights."""
    return shingle.astype(np.uint64).tobytes() + weight.astype(np.float32).tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    n, m = len(a) // 12, len(b) // 12
    x, y = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m)
    wx, wy = np.frombuffer(a, np.float32, n, 8 * n).astype(np.float64), np.frombuffer(b, np.float32, m, 8 * m).astype(np.float64)
    place = np.minimum(np.searchsorted(y, x), m - 1) if m else np.zeros(n, np.int64)
    same = y[place] == x if m else np.zeros(n, bool)
    both = np.minimum(wx[same], wy[place[same]]).sum()
    total = wx.sum() + wy.sum() - both
    return float(both / total) if total else 1.0


def labelled(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, key, class_key of every document; a class is known by its least key."""
    weights = word_weights(docs)
    signed = shared.materialise(signatures(docs, weights, words, bands, rows))
    keys = shared.materialise(signed.where(F.size("bands") > 0).groupBy("key").agg(F.min_by(F.struct("bands", "signature"), "doc_id").alias("s"), F.min("doc_id").alias("doc_id")).select("key", "doc_id", "s.bands", "s.signature"))
    pairs = shared.materialise(candidate_pairs(keys))

    def sets(batches):
        for batch in batches:
            want = batch.column("want").to_pylist()
            for at, to, terms, n_words in _chunks(batch):
                doc, shingle, weight = shingle_sets(terms, n_words, weights, words)
                bounds = np.searchsorted(doc, np.arange(to - at + 1))
                out = {}
                for i, key in enumerate(_keys(terms, n_words)):
                    if key == want[at + i]:
                        out[key] = pack_set(shingle[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["key", "set"])

    def sets_of(some):
        wanted = keys.select("key", "doc_id").join(some, "key")
        texts = _texts(docs).join(wanted.select("doc_id", F.col("key").alias("want")), "doc_id").mapInArrow(sets, "key binary, set binary")
        # rows with equal doc_id and text give a set each
        return texts.dropDuplicates(["key"])

    # written, so that joins on a hot key can be split
    links = shared.materialise(_verify(pairs, shared.materialise(sets_of(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())), threshold))
    labels = components(links)
    more = shared.materialise(further_links(keys, labels, sets_of, threshold))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = signed.select("doc_id", "text_key", "key").join(labels.select(F.col("node").alias("key"), "label"), "key", "left")
    return shared.materialise(named.select("doc_id", "text_key", "key", F.coalesce("label", "key").alias("class_key")))


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, key: every document's class (the smallest doc_id in it)."""
    named = labelled(docs, words, threshold, bands, rows)
    least = shared.materialise(named.groupBy("class_key").agg(F.min("doc_id").alias("class_id")))
    return named.join(least, "class_key").select("doc_id", "class_id", "key")


def keep_of_class(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, for one row of each class: that of the smallest doc_id, then of the least hash of its text; of equal rows one.

    Classes are told apart by their words, so unrelated texts under one doc_id, or under null, are all kept.
    """
    named = labelled(docs)
    by = shared.free_names(docs, "id", "text_key")
    chosen = shared.materialise(named.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("s")).select(F.col("s.doc_id").alias(by[0]), F.col("s.text_key").alias(by[1])))
    keys = dict(zip(by, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))), strict=True))
    kept = docs.withColumns(keys).join(chosen, by, "left_semi")
    rows = named.select(F.col("doc_id").alias(by[0]), F.col("text_key").alias(by[1])).join(chosen, by, "left_semi")
    # rows of equal doc_id and text
    if rows.groupBy(*by).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(by)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return found.select(real("doc_id"), real("class_id"), (F.col("doc_id") == F.col("class_id")).alias("keep"))
