"""Benchmark decontamination through a positional inverted index of the training text.

The index is a table in the shared folder, one row per block of documents:
the block's terms (sorted 64-bit hashes), the postings of each term (word
positions, as gaps), and the block's documents with their numbers of words.
Queries are windows of consecutive benchmark words. A search

1. sums the postings of the queries' terms over all blocks;
2. in each block, keeps the queries whose terms it all has, takes the postings
   of each query's rarest term, and intersects them with the other terms'
   lists, offset by the distance of the words, from the rarest to the most
   common (exact phrases), or looks for every other term within ``slop`` words
   (proximity).

Benchmarks larger than ``SHARD_BYTES`` are split by item into shards of about
that size, searched one after the other over the index, so what a task holds of
the queries is bounded; the corpus side is never collected or broadcast.

Words: A-Z are lower-cased, and a word is a run of ASCII digits, a-z and
characters from U+0080 on. Edge cases: null texts have no words; items of no
words have no windows, shorter ones than ``window`` are one window; equal
documents and items count each for itself; an item without an id is named
``null``; an empty benchmark hits nothing, an empty corpus gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm import shared

WINDOW = 10
#: UTF-8 bytes of benchmark text searched at once.
SHARD_BYTES = 4_000_000
#: UTF-8 bytes of text per index row.
INDEX_BYTES = 2_000_000
INDEX = "block string, doc_ids array<long>, n_words array<int>, terms binary, ends binary, gaps binary"
MATCHES = "block string, doc int, item_id string, start int, length int"
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(offsets: np.ndarray, data: np.ndarray, nulls: np.ndarray):
    """Hash of each word of consecutive texts in turn, and the words of each text."""
    n = len(offsets) - 1
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    buffer = np.zeros(len(data) + n, np.uint8)  # NUL isn't a word character: it parts the texts
    buffer[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = _LOWER[data]
    inside = np.concatenate([[False], _WORD[buffer], [False]])
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(offsets + np.arange(n + 1), start, "right") - 1
    return shared.RollingHash(buffer).of(start, end), np.bincount(doc, minlength=n)


def _runs(sizes: np.ndarray, limit: int):
    """Cut consecutive texts into runs of about ``limit`` bytes."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield at, to
        at = to


def build_index(docs: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Write the positional index of ``docs`` (doc_id, text) to the shared folder."""
    schema = shared._arrow_schema(INDEX)

    def index(batches):
        import hashlib

        for batch in batches:
            offsets, data, nulls = shared._string_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in _runs(np.diff(offsets), index_bytes):
                terms, n_words = terms_of(offsets[a : b + 1], data, nulls[a:b])
                order = np.argsort(terms, kind="stable")
                ordered = terms[order]
                first = np.ones(len(order), bool)
                first[1:] = ordered[1:] != ordered[:-1]
                ends = np.append(np.flatnonzero(first)[1:], len(order)).astype(np.int32) if len(order) else np.zeros(0, np.int32)
                gaps = np.diff(order, prepend=0)
                gaps[first] = order[first]
                # the name of a block: its documents and words
                name = hashlib.blake2b(np.array([a], np.int64).tobytes() + str(ids[a:b]).encode() + terms.tobytes(), digest_size=16).hexdigest()
                yield pa.RecordBatch.from_pydict({"block": [name], "doc_ids": [ids[a:b]], "n_words": [n_words.astype(np.int32)], "terms": [ordered[first].tobytes()], "ends": [ends.tobytes()], "gaps": [gaps.astype(np.int32).tobytes()]}, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.materialise(rows.mapInArrow(index, INDEX))


class _Postings:
    """One row of the index, decoded."""

    def __init__(self, terms: bytes, ends: bytes, gaps: bytes, n_words):
        self.terms = np.frombuffer(terms, np.uint64)
        self.ends = np.frombuffer(ends, np.int32).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        gap = np.frombuffer(gaps, np.int32).astype(np.int64)
        total = np.cumsum(gap)
        self.count = self.ends - self.begins
        before = np.concatenate([[0], total])[self.begins] if len(gap) else self.begins
        self.at = total - np.repeat(before, self.count)
        # (term, position) in one sorted column
        self.key = (np.repeat(np.arange(len(self.terms)), self.count) << 32) | self.at
        self.first_word = np.concatenate([[0], np.cumsum(n_words)])

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in this block, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[place] == terms, place, -1)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_word, at, "right") - 1

    def spread(self, number: np.ndarray):
        """All postings of some terms: index into ``number`` and position."""
        count = self.count[number]
        who = np.repeat(np.arange(len(number)), count)
        return who, self.at[np.repeat(self.begins[number], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]


class Queries:
    """Windows of benchmark items: distinct term sequences and the items that hold them."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        found: dict[bytes, set[str]] = {}
        for name, terms in items:
            size = min(window, len(terms))
            for i in range(len(terms) - size + 1 if size else 0):
                found.setdefault(terms[i : i + size].tobytes(), set()).add(name)
        self.items = [sorted(v) for v in found.values()]
        self.size = np.array([len(k) // 8 for k in found], np.int64)
        self.width = int(self.size.max()) if found else 0
        self.terms = np.zeros((len(found), self.width), np.uint64)
        for i, k in enumerate(found):
            self.terms[i, : len(k) // 8] = np.frombuffer(k, np.uint64)
        self.used = np.arange(self.width)[None, :] < self.size[:, None]
        self.vocabulary = np.unique(self.terms[self.used])
        self.order = None

    def rank(self, frequency: dict[int, int]):
        """Put each window's words in the order of rarity; unknown words first."""
        count = np.array([frequency.get(int(t), 0) for t in self.vocabulary], np.int64)
        rare = np.full(self.terms.shape, np.iinfo(np.int64).max)
        rare[self.used] = count[np.searchsorted(self.vocabulary, self.terms[self.used])]
        self.order = np.argsort(rare, axis=1, kind="stable")


def match(postings: _Postings, queries: Queries, slop: int | None):
    """(query, first word, words) of each occurrence in a block."""
    none = np.zeros(0, np.int64)
    if not len(queries.size) or not len(postings.terms):
        return none, none, none
    number = postings.find(queries.terms)
    alive = np.flatnonzero(((number >= 0) | ~queries.used).all(axis=1))
    if not len(alive):
        return none, none, none
    order = queries.order[alive]
    lead = order[:, 0]
    who, at = postings.spread(number[alive, lead])
    query = alive[who]
    low = at - lead[who] if slop is None else at
    high = low.copy()
    lead_at = at
    for k in range(1, queries.width):
        column = queries.order[query, k]
        live = k < queries.size[query]
        term = number[query, column]
        if slop is None:
            wanted = low + column
            key = (term.astype(np.int64) << 32) | np.maximum(wanted, 0)
            place = np.minimum(np.searchsorted(postings.key, key), len(postings.key) - 1)
            ok = ~live | ((postings.key[place] == key) & (low >= 0))
        else:
            base = term.astype(np.int64) << 32
            place = np.searchsorted(postings.key, base | lead_at)
            options = []
            for shift in (-1, 0):
                p = np.clip(place + shift, 0, len(postings.key) - 1)
                here = postings.key[p] & 0xFFFFFFFF
                good = (postings.key[p] >> 32 == term) & (np.abs(here - lead_at) <= slop) & (postings.doc_of(here) == postings.doc_of(lead_at))
                options.append((good, here))
            (g0, h0), (g1, h1) = options
            near = np.where(g0 & (~g1 | (np.abs(h0 - lead_at) <= np.abs(h1 - lead_at))), h0, h1)
            ok = ~live | g0 | g1
            low, high = np.where(live & ok, np.minimum(low, near), low), np.where(live & ok, np.maximum(high, near), high)
        query, low, high, lead_at = query[ok], low[ok], high[ok], lead_at[ok]
    length = queries.size[query] if slop is None else high - low + 1
    ok = (low >= 0) & (low + length <= postings.first_word[-1])
    query, low, length = query[ok], low[ok], length[ok]
    ok = postings.doc_of(low) == postings.doc_of(low + length - 1)
    return query[ok], low[ok], length[ok]


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Occurrences of the benchmark's windows: block, doc (number in its block), item_id, start, length.

    ``slop`` None: exact phrases; else windows whose words all lie within so
    many words of their rarest one, in any order.
    """
    spark = index.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = max(1, math.ceil(shared.text_bytes(items) / shard_bytes))
    found = spark.createDataFrame([], MATCHES)
    for shard in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows = []
        for row in part.toLocalIterator():
            data = np.frombuffer(row.text.encode(), np.uint8)
            rows.append((row.item_id, terms_of(np.array([0, len(data)], np.int64), data, np.zeros(1, bool))[0]))
        queries = Queries(rows, window)
        queries.rank(_frequencies(index, queries.vocabulary))
        found = found.unionByName(_occurrences(index, queries, slop))
    return found


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Postings of each query term over all blocks."""

    def count(batches):
        for batch in batches:
            total = np.zeros(len(vocabulary), np.int64)
            for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                have = np.frombuffer(terms, np.uint64)
                if len(have) and len(vocabulary):
                    place = np.minimum(np.searchsorted(have, vocabulary), len(have) - 1)
                    total += np.where(have[place] == vocabulary, np.diff(np.frombuffer(ends, np.int32), prepend=0)[place], 0)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = index.select("terms", "ends").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r.term]): r.n for r in rows}


def _occurrences(index: DataFrame, queries: Queries, slop: int | None) -> DataFrame:
    schema = shared._arrow_schema(MATCHES)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                postings = _Postings(row["terms"], row["ends"], row["gaps"], np.array(row["n_words"], np.int64))
                query, start, length = match(postings, queries, slop)
                doc = postings.doc_of(start)
                start = start - postings.first_word[doc]
                out = {"block": [], "doc": [], "item_id": [], "start": [], "length": []}
                for q, d, s, n in zip(query.tolist(), doc.tolist(), start.tolist(), length.tolist(), strict=True):
                    for item in queries.items[q]:
                        for k, v in zip(out, (row["block"], d, item, s, n), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return index.select("block", "n_words", "terms", "ends", "gaps").mapInArrow(run, MATCHES)


def report(index: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "d")).select("block", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    spans = matches.groupBy("block", "doc", "start", "length").agg(F.collect_set("item_id").alias("items"))
    # words covered: each span adds what lies beyond the furthest end so far
    by_doc = Window.partitionBy("block", "doc").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("length")).over(by_doc), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", "reached"))
    hits = spans.withColumn("fresh", fresh).groupBy("block", "doc").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return docs.join(hits, ["block", "doc"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact-phrase contamination of each document by the benchmark's windows."""
    index = build_index(docs)
    return report(index, search(index, benchmark, window))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
