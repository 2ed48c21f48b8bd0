"""Exact substring dedup on bytes with a run-length compressed index.

Every byte covered by a ``length``-byte string that also starts anywhere else,
in another document or the same one, is removed. Strings never cross documents
and are judged on the input.

Routing. Each ``length``-byte string is known by its anchor: the leftmost of
its ``ANCHOR``-byte substrings with the smallest hash. Consecutive strings with
one anchor form a segment (at most ``2 * length - ANCHOR`` bytes), so equal
strings have equal anchors and lie in segments of the same anchor.

1. Blocks ask which whole segments occur twice and which anchors have several
   different segments. A segment that occurs twice as a whole is settled: all
   its strings repeat.
2. The different segments of such anchors (of settled ones, one copy) go to the
   bucket of their anchor. A bucket indexes its segments: it sorts their
   suffixes, takes the Burrows-Wheeler transform, keeps its runs with text
   positions sampled at the run ends, measures matches at those samples only,
   and streams them along the text: the match length at a position is at least
   the one before it less one, with equality wherever the position is inside a
   run. Starts with a match of ``length`` bytes are marked.
3. The block applies the marks.

An anchor with more than ``HOT`` different segments (a passage that a third of
all documents hold) would make an unbounded bucket. The strings of its
segments are asked about one by one as 128-bit fingerprints instead, which are
merged in each block and spread over slices by their own hash.

Fingerprints are pairs of 64-bit hashes: of 10^14 different strings (100 TB), two
share one with a chance of about 10^-11.

Edge cases: a null or short text is kept whole; repeated rows repeat each
other's strings; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliary.llm import shared

LENGTH = 400
ANCHOR = 64
#: Segments of one anchor beyond which its strings are asked about one by one.
HOT = 512
#: Bytes of text per index bucket, about, counted over the whole corpus.
BUCKET_BYTES = 2_000_000
PER_SLICE = 250_000
_PLACE_BITS = 28
_MIXED, _HOT, _TWICE, _OWNER, _MARKS, _STRINGS = range(6)
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_ASK = "g int, kind int, block int, n int, data binary"


# ------------------------------------------------------------------ the index


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling over those still tied."""
    n, step = len(symbols), 7
    wide = np.concatenate([symbols.astype(np.uint64), np.zeros(step, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(step):
        key = (key << np.uint64(9)) | wide[i : n + i]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _first_of_equal(key[order])
    tied = _tied(order, rank)
    while step < depth and len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = (rank[tied].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(both, kind="stable")
        tied, both = tied[order], both[order]
        group = _first_of_equal(both >> np.uint64(32))
        fresh = (both[group] >> np.uint64(32)).astype(np.int64) + _first_of_equal(both) - group
        rank[tied] = fresh
        tied = _tied(tied, rank)
        step *= 2
    return np.argsort(rank, kind="stable")


def _first_of_equal(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _tied(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of suffixes in sorted order, those whose rank another one shares."""
    ranks = rank[order]
    same = np.zeros(len(ranks) + 1, bool)
    same[1:-1] = ranks[1:] == ranks[:-1]
    return order[same[1:] | same[:-1]]


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of separated texts, with both text positions at each run border."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, depth: int):
        n = len(data) + len(lengths)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.symbols = np.zeros(n, np.uint16)  # 0 separates
        self.symbols[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data.astype(np.uint16) + 1
        order = suffix_order(self.symbols, depth)
        before = np.where(order > 0, self.symbols[order - 1], 0)
        border = np.ones(n, bool)
        border[1:] = (before[1:] != before[:-1]) | (before[1:] == 0) | (before[:-1] == 0)
        border[0] = False
        heads = np.flatnonzero(border)
        self.runs = len(heads) + 1
        self.above, self.below = order[heads - 1], order[heads]

    def matching_statistics(self, limit: int) -> np.ndarray:
        """At each position, the longest match (up to ``limit``) with any other position."""
        lengths = self._matches(limit)
        at = np.zeros(len(self.symbols), np.int64)
        np.maximum.at(at, self.above, lengths)
        np.maximum.at(at, self.below, lengths)
        place = np.arange(len(at))
        return np.maximum.accumulate(at + place) - place

    def _matches(self, limit: int) -> np.ndarray:
        a, b = self.above.copy(), self.below.copy()
        length = np.zeros(len(a), np.int64)
        wide = np.concatenate([self.symbols, np.zeros(8, np.uint16)])
        words = np.lib.stride_tricks.sliding_window_view(wide, 4)
        packed = (words[:, 0].astype(np.uint64) << np.uint64(48)) | (words[:, 1].astype(np.uint64) << np.uint64(32)) | (words[:, 2].astype(np.uint64) << np.uint64(16)) | words[:, 3]
        alive = np.arange(len(a))
        last = len(self.symbols)
        for _ in range(0, limit, 4):
            here, there = a[alive] + length[alive], b[alive] + length[alive]
            inside = (here < last) & (there < last)
            alive, here, there = alive[inside], here[inside], there[inside]
            same = packed[here] == packed[there]
            rest = alive[~same]
            for k in range(4):  # the last, unequal word
                x, y = a[rest] + length[rest], b[rest] + length[rest]
                ok = (np.maximum(x, y) < last) & (wide[np.minimum(x, last)] == wide[np.minimum(y, last)])
                rest = rest[ok]
                length[rest] += 1
            alive = alive[same]
            length[alive] += 4
            if not len(alive):
                break
        return length


def repeated_starts(data: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """For texts laid end to end: for each text in turn, whether the string at each of its starts occurs elsewhere."""
    longest = int(lengths.max())  # streaming a match needs it in full, from its sample on
    index = RunLengthIndex(data, lengths, longest)
    found = index.matching_statistics(longest) >= length
    count = np.maximum(lengths - length + 1, 0)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return found[np.repeat(index.starts, count) + offset]


# ------------------------------------------------------------------- segments


class _Segments:
    """The segments of a block: first string, number of strings, anchor hash, fingerprint."""

    def __init__(self, block, length: int, anchor: int):
        data = block.data
        self.data, self.length = data, length
        self.hash = shared.RollingHash(data)
        self.hash2 = shared.RollingHash(data, 1)
        empty = np.zeros(0, np.int64)
        self.first, self.count, self.anchor, self.hi, self.lo = empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(data) < length:
            return
        small = self.hash.windows(anchor)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        place = np.arange(len(small), dtype=np.uint64)
        least = _sliding_min((small & ~mask) | place, length - anchor + 1)
        owner = (least & mask).astype(np.int64)
        end = np.repeat(block.offsets[1:], np.diff(block.offsets))
        start = np.flatnonzero(np.arange(len(owner)) + length <= end[: len(owner)])
        if not len(start):
            return
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(start) != 1) | (owner[start[1:]] != owner[start[:-1]])
        heads = np.flatnonzero(new)
        self.first = start[heads]
        self.count = np.diff(np.append(heads, len(start)))
        self.anchor = shared.mix64(small[owner[self.first]])  # a least hash is a small number: spread it again
        last = self.first + self.count - 1 + length
        self.hi = self.hash.of(self.first, last)
        self.lo = self.hash2.of(self.first, last)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """Starts of the strings of some segments, in turn."""
        return np.repeat(self.first[rows], self.count[rows]) + _within(self.count[rows])


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: block-wise prefix and suffix minima."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class _Keys:
    """Distinct (hi, lo) keys of a block in order, how often each occurs, and which key each item has."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, weight: np.ndarray | None = None):
        order = np.lexsort((lo, hi))
        first = np.ones(len(hi), bool)
        first[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        self.hi, self.lo = hi[order][first], lo[order][first]
        self.item = order[first]
        self.which = np.empty(len(hi), np.int64)
        self.which[order] = np.cumsum(first) - 1
        self.count = np.bincount(self.which, weights=weight, minlength=len(self.hi)).astype(np.int64)

    def rows(self, kind: int, block_id: int, slice_bits: int, rows: dict, more: np.ndarray | None = None):
        piece = (self.hi >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(self.hi), np.int64)
        for g, a, b in shared.cut(piece):
            rows["g"].append(g)
            rows["kind"].append(kind)
            rows["block"].append(block_id)
            rows["n"].append(b - a)
            second = self.lo[a:b] if more is None else more[a:b]
            rows["data"].append(self.hi[a:b].tobytes() + np.minimum(self.count[a:b], 255).astype(np.uint8).tobytes() + second.tobytes())


def _rows() -> dict:
    return {"g": [], "kind": [], "block": [], "n": [], "data": []}


class _Anchors:
    """The anchors of a block: how many different segments each has, and the least fingerprint among them."""

    def __init__(self, segments, whole: _Keys):
        owner = segments.anchor[whole.item]
        self.keys = _Keys(owner, np.zeros(len(owner), np.uint64))
        self.least = np.full(len(self.keys.hi), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(self.least, self.keys.which, whole.hi)
        self.of = self.keys.which[whole.which]  # the anchor of each segment


def count_keys(kind: int, table, hot: int = HOT) -> dict[int, list[bytes]]:
    """A slice's answers to every row, by kind of reply."""
    sizes = table.column("n").to_pylist()
    blobs = table.column("data").to_pylist()
    hi = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(blobs, sizes, strict=True)])
    count = np.concatenate([np.frombuffer(d, np.uint8, n, 8 * n) for d, n in zip(blobs, sizes, strict=True)])
    second = np.concatenate([np.frombuffer(d, np.uint64, n, 9 * n) for d, n in zip(blobs, sizes, strict=True)])
    keys = _Keys(hi, np.zeros(len(hi), np.uint64) if kind == _MIXED else second, count)
    total = keys.count[keys.which]
    if kind == _MIXED:
        least = np.full(len(keys.hi), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, keys.which, second)
        odd = np.bincount(keys.which, weights=(second != least[keys.which]) | (count > 1), minlength=len(least))
        flags = {_MIXED: odd[keys.which] > 0, _HOT: total > hot}
    else:
        owner = np.zeros(len(hi), bool)
        owner[_first_rows(keys.which, len(keys.hi))] = True
        flags = {kind: total >= 2} | ({_OWNER: owner} if kind == _TWICE else {})
    ends = np.cumsum(sizes)
    return {k: [shared.bits(f[e - s : e]) for s, e in zip(sizes, ends, strict=True)] for k, f in flags.items()}


def _first_rows(which: np.ndarray, n: int) -> np.ndarray:
    first = np.full(n, len(which), np.int64)
    np.minimum.at(first, which, np.arange(len(which)))
    return first


# ------------------------------------------------------------------- operator


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, block_bytes: int = shared.BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, per_slice: int = PER_SLICE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    if not 8 <= anchor < length:
        raise ValueError("an anchor has 8 bytes at least and is shorter than the strings")
    total = shared.text_bytes(docs)
    blocks = shared.deal_blocks(docs, shared.block_count(total, block_bytes), block_bytes)
    key_bits = shared.slices_for(2 * total / (length - anchor), per_slice)
    string_bits = shared.slices_for(total / 8, per_slice)
    buckets = max(1, -(-total // bucket_bytes))

    def asked(block_id, block):
        segments, rows = _Segments(block, length, anchor), _rows()
        whole = _Keys(segments.hi, segments.lo)
        anchors = _Anchors(segments, whole)
        anchors.keys.rows(_MIXED, block_id, key_bits, rows, anchors.least)
        whole.rows(_TWICE, block_id, key_bits, rows)
        return rows

    def reply(table, kind, g, counts, data):
        size = table.num_rows
        return pa.table({"block": table.column("block"), "kind": pa.array([kind] * size, pa.int32()), "slice": pa.array([g] * size, pa.int32()), "n": counts, "data": pa.array(data, pa.binary())})

    def counted(key, table):
        kind, g = key[0].as_py(), key[1].as_py()
        # owners are chosen by block number, whatever order the rows came in
        table = table.sort_by("block")
        return pa.concat_tables([reply(table, k, g, table.column("n"), data) for k, data in count_keys(kind, table, hot).items()])

    def sorted_out(segments, replies):
        """Settled segments; those to index, by bucket; the strings of hot anchors' segments, and their keys."""
        whole = _Keys(segments.hi, segments.lo)
        anchors = _Anchors(segments, whole)
        mixed, crowded = (shared.replies_in_order(replies, k, len(anchors.keys.hi))[anchors.of] for k in (_MIXED, _HOT))
        settled, owner = (shared.replies_in_order(replies, k, len(whole.hi)) for k in (_TWICE, _OWNER))
        settled = settled[whole.which]
        sent = np.zeros(len(settled), bool)  # of equal segments one, in one block
        sent[whole.item[owner]] = True
        to_index = np.flatnonzero(mixed & sent & ~crowded)
        bucket = (segments.anchor[to_index] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        one_by_one = np.flatnonzero(mixed & sent & crowded)
        starts = segments.strings(one_by_one)
        weight = np.repeat(np.where(settled[one_by_one], 2, 1), segments.count[one_by_one])
        keys = _Keys(segments.hash.of(starts, starts + length), segments.hash2.of(starts, starts + length), weight)
        return np.flatnonzero(settled), to_index[order], bucket[order], starts, keys

    def opened(block_id, block, replies):
        segments, rows = _Segments(block, length, anchor), _rows()
        _, to_index, bucket, _, keys = sorted_out(segments, replies)
        for g, a, b in shared.cut(bucket):
            mine = to_index[a:b]
            sizes = segments.count[mine] + length - 1
            text = segments.data[np.repeat(segments.first[mine], sizes) + _within(sizes)]
            rows["g"].append(g)
            rows["kind"].append(_MARKS)
            rows["block"].append(block_id)
            rows["n"].append(b - a)
            rows["data"].append(sizes.astype(np.int32).tobytes() + text.tobytes())
        keys.rows(_STRINGS, block_id, string_bits, rows)
        return rows

    def resolved(key, table):
        kind, g = key[0].as_py(), key[1].as_py()
        if kind == _STRINGS:
            return reply(table, kind, g, table.column("n"), count_keys(kind, table)[kind])
        sizes, texts = [], []
        for data, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True):
            sizes.append(np.frombuffer(data, np.int32, n).astype(np.int64))
            texts.append(np.frombuffer(data, np.uint8, len(data) - 4 * n, 4 * n))
        found = repeated_starts(np.concatenate(texts), np.concatenate(sizes), length)
        strings = [int((s - length + 1).sum()) for s in sizes]
        ends = np.cumsum(strings)
        return reply(table, kind, g, pa.array(strings, pa.int32()), [shared.bits(found[e - s : e]) for s, e in zip(strings, ends, strict=True)])

    def keep(block_id, block, replies):
        segments = _Segments(block, length, anchor)
        settled, to_index, _, starts, keys = sorted_out(segments, replies)
        cover = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(cover, segments.first[settled], 1)
        np.add.at(cover, segments.first[settled] + segments.count[settled] - 1 + length, -1)
        indexed = segments.strings(to_index)
        found = indexed[shared.replies_in_order(replies, _MARKS, len(indexed))]
        hot_found = starts[shared.replies_in_order(replies, _STRINGS, len(keys.hi))[keys.which]]
        for at in (found, hot_found):
            cover += np.bincount(at, minlength=len(cover)).astype(np.int32)
            cover -= np.bincount(at + length, minlength=len(cover)).astype(np.int32)
        gone = np.cumsum(cover)[:-1] > 0
        rows = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i in range(len(block)):
            a, b = block.offsets[i], block.offsets[i + 1]
            removed = gone[a:b]
            kept = block.data[a:b][~removed].tobytes()
            rows["doc_id"].append(block.ids[i])
            rows["n_bytes"].append(int(b - a))
            rows["n_removed"].append(int(removed.sum()))
            rows["n_spans"].append(int(removed[:1].sum()) + int((removed[1:] & ~removed[:-1]).sum()))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["kept"].append(kept)
        return rows

    counts = shared.ask(blocks, asked, _ASK).groupBy("kind", "g").applyInArrow(counted, shared.REPLY)
    marks = shared.answer(blocks, counts, opened, _ASK).groupBy("kind", "g").applyInArrow(resolved, shared.REPLY)
    return shared.answer(blocks, counts.unionByName(marks), keep, OUT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
