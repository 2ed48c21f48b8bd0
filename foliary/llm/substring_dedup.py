"""Substring dedup on word windows with a count-min prefilter.

A window is ``window`` consecutive words of one document. A word is removed if
a window that covers it also starts in a document with a smaller doc_id.

1. Every block of documents counts its windows in a count-min sketch of
   ``DEPTH`` rows and about four counters per window. A block sends only the
   counters it touched, to the slice of the sketch they lie in; a slice merges
   the blocks' sketches by addition and answers which counters reached two.
   A sketch never underestimates, so a window that occurs twice always passes.
2. Only windows whose every counter reached two are sent, as 128-bit
   fingerprints with the block's smallest doc_id, to be grouped by them: of 10^13
   different windows, two share one with a chance of about 10^-13.
3. The block applies the exact answers to its text.

The sketch grows with the corpus and is spread over slices of fixed size:
nothing is broadcast or collected, and a window that a third of all documents
hold reaches its slice once per block.

Edge cases: a null text has no words; a null doc_id counts as larger than every
other; repeated doc_ids don't make each other "smaller"; texts under ``window``
words are kept whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import shared

WINDOW = 13
DEPTH = 2
#: Counters of one sketch slice, as a power of two.
SLICE_BITS = 22
#: Fingerprints that one slice of the exact pass receives, about.
PER_SLICE = 1_000_000
_NULL_ID = (1 << 63) - 1
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Windows:
    """The windows of a block: two hashes, the document and the first word of each."""

    def __init__(self, block, window: int):
        n = len(block)
        # one white byte after each document keeps words apart
        size = len(block.data) + n
        buffer = np.full(size, 0x20, np.uint8)
        shift = np.repeat(np.arange(n), np.diff(block.offsets))
        buffer[np.arange(len(block.data)) + shift] = block.data
        white = _WHITE[buffer]
        edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        bounds = block.offsets + np.arange(n + 1)
        self.doc = np.searchsorted(bounds, start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=n)
        self.first_word = np.concatenate([[0], np.cumsum(self.n_words)])
        words = len(start)
        valid = np.zeros(0, bool)
        if words >= window:
            valid = self.doc[: words - window + 1] == self.doc[window - 1 :]
        self.at = np.flatnonzero(valid)
        hashes = []
        for which in (0, 1):
            spelled = shared.RollingHash(buffer, which).of(start, end)
            hashes.append(shared.RollingHash(spelled, which).windows(window)[self.at])
        self.hi, self.lo = hashes


def _pack_counters(low: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted counters of a slice as gaps, with a flag for each that this block alone counts twice."""
    gaps = np.diff(low, prepend=np.int64(0))
    kind = np.uint16 if not len(gaps) or gaps.max() < 1 << 16 else np.uint32
    return bytes([kind().itemsize]) + shared.bits(more) + gaps.astype(kind).tobytes()


def _unpack_counters(data: bytes, n: int):
    flags = (n + 7) // 8
    more = shared.unbits(data[1 : 1 + flags], n)
    gaps = np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, n, 1 + flags)
    return np.cumsum(gaps.astype(np.int64)), more


def _counters(hi: np.ndarray, row: int, width_bits: int):
    """The sketch counter of each window in one row: position, then unique positions, inverse, counts."""
    seeded = shared.mix64(hi ^ np.uint64(0xA5A5_0000_0000_0001 * (row + 1) & (1 << 64) - 1))
    return np.unique((seeded >> np.uint64(64 - width_bits)).astype(np.int64), return_inverse=True, return_counts=True)


def _sketch_rows(windows, block_id: int, width_bits: int, slice_bits: int):
    rows = {"g": [], "block": [], "n": [], "data": []}
    for row in range(DEPTH):
        unique, _, count = _counters(windows.hi, row, width_bits)
        for piece, a, b in shared.cut(unique >> slice_bits):
            rows["g"].append((row << (width_bits - slice_bits)) + piece)
            rows["block"].append(block_id)
            rows["n"].append(b - a)
            rows["data"].append(_pack_counters(unique[a:b] & ((1 << slice_bits) - 1), count[a:b] > 1))
    return rows


def _repeated(windows, replies, width_bits: int) -> np.ndarray:
    """Windows that every row of the sketch estimates at two or more."""
    out = np.ones(len(windows.hi), bool)
    for row in range(DEPTH):
        unique, inverse, _ = _counters(windows.hi, row, width_bits)
        out &= shared.replies_in_order(replies, row, len(unique))[inverse]
    return out


class _Exact:
    """A block's estimated windows, distinct, sorted by fingerprint, with the smallest doc_id of each."""

    def __init__(self, windows, passed: np.ndarray, ids: np.ndarray):
        pick = np.flatnonzero(passed)
        hi, lo, doc = windows.hi[pick], windows.lo[pick], ids[windows.doc[windows.at[pick]]]
        order = np.lexsort((doc, lo, hi))
        hi, lo, doc = hi[order], lo[order], doc[order]
        first = np.ones(len(hi), bool)
        first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        self.hi, self.lo, self.least = hi[first], lo[first], doc[first]
        which = np.cumsum(first) - 1
        self.at, self.which, self.doc = windows.at[pick][order], which, doc


def _ids(block) -> np.ndarray:
    return np.array([_NULL_ID if x is None else x for x in block.ids], np.int64)


def _exact_rows(exact, block_id: int, bits: int):
    rows = {"g": [], "block": [], "n": [], "data": []}
    pieces = exact.hi >> np.uint64(64 - bits) if bits else np.zeros(len(exact.hi), np.uint64)
    for piece, a, b in shared.cut(pieces.astype(np.int64)):
        docs, index = np.unique(exact.least[a:b], return_inverse=True)
        kind = np.uint16 if len(docs) < 1 << 16 else np.uint32
        rows["g"].append(piece)
        rows["block"].append(block_id)
        rows["n"].append(b - a)
        rows["data"].append(np.array([len(docs)], np.int64).tobytes() + docs.tobytes() + exact.hi[a:b].tobytes() + exact.lo[a:b].tobytes() + index.astype(kind).tobytes())
    return rows


def _read_exact(data: bytes, n: int):
    k = int(np.frombuffer(data, np.int64, 1)[0])
    docs = np.frombuffer(data, np.int64, k, 8)
    at = 8 + 8 * k
    hi, lo = np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.uint64, n, at + 8 * n)
    return hi, lo, docs[np.frombuffer(data, np.uint16 if k < 1 << 16 else np.uint32, n, at + 16 * n)]


_ASK = "g int, block int, n int, data binary"


def dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = shared.BLOCK_BYTES, slice_bits: int = SLICE_BITS, per_slice: int = PER_SLICE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space)."""
    total = shared.text_bytes(docs)
    blocks = shared.deal_blocks(docs, shared.block_count(total, block_bytes), block_bytes)
    n = max(1.0, total / 6)  # windows, about; sizes the sketch only
    width_bits = max(slice_bits, int(np.ceil(np.log2(4 * n))))
    exact_bits = shared.slices_for(n / 2, per_slice)

    def sketch(block_id, block):
        return _sketch_rows(_Windows(block, window), block_id, width_bits, slice_bits)

    def merge(key, table):
        counts, replies = np.zeros(1 << slice_bits, np.uint8), []
        parts = [_unpack_counters(d, k) for d, k in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
        for low, more in parts:
            counts[low] = np.minimum(counts[low] + 1 + more, 2)
        for low, _ in parts:
            replies.append(shared.bits(counts[low] >= 2))
        g, size = key[0].as_py(), table.num_rows
        row, piece = g >> (width_bits - slice_bits), g & ((1 << (width_bits - slice_bits)) - 1)
        return pa.table({"block": table.column("block"), "kind": pa.array([row] * size, pa.int32()), "slice": pa.array([piece] * size, pa.int32()), "n": table.column("n"), "data": pa.array(replies, pa.binary())})

    def candidates(block_id, block, replies):
        windows = _Windows(block, window)
        return _exact_rows(_Exact(windows, _repeated(windows, replies, width_bits), _ids(block)), block_id, exact_bits)

    def group(key, table):
        sizes = table.column("n").to_pylist()
        parts = [_read_exact(d, k) for d, k in zip(table.column("data").to_pylist(), sizes, strict=True)]
        hi, lo, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((doc, lo, hi))
        first = np.ones(len(hi), bool)
        a, b = order[1:], order[:-1]
        first[1:] = (hi[a] != hi[b]) | (lo[a] != lo[b])
        least = doc[order][first][np.cumsum(first) - 1]
        smaller = np.empty(len(hi), bool)
        smaller[order] = least < doc[order]
        ends = np.cumsum(sizes)
        out = [shared.bits(smaller[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
        size = table.num_rows
        return pa.table({"block": table.column("block"), "kind": pa.array([DEPTH] * size, pa.int32()), "slice": pa.array([key[0].as_py()] * size, pa.int32()), "n": table.column("n"), "data": pa.array(out, pa.binary())})

    def keep(block_id, block, replies):
        windows = _Windows(block, window)
        exact = _Exact(windows, _repeated(windows, replies, width_bits), _ids(block))
        smaller = shared.replies_in_order(replies, DEPTH, len(exact.hi))
        gone = smaller[exact.which] | (exact.doc > exact.least[exact.which])
        cover = np.zeros(windows.first_word[-1] + 1, np.int64)
        np.add.at(cover, exact.at[gone], 1)
        np.add.at(cover, exact.at[gone] + window, -1)
        stays = np.cumsum(cover)[:-1] == 0
        rows = {"doc_id": block.ids, "n_words": windows.n_words, "n_removed": [], "kept_sha256": [], "kept": []}
        for i in range(len(block)):
            flags = stays[windows.first_word[i] : windows.first_word[i + 1]]
            words = block.raw(i).split()
            removed = len(flags) - int(flags.sum())
            kept = b" ".join(compress(words, flags.tolist()) if removed else words)
            rows["n_removed"].append(removed)
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["kept"].append(kept.decode())
        return rows

    estimates = shared.ask(blocks, sketch, _ASK).groupBy("g").applyInArrow(merge, shared.REPLY)
    exact = shared.answer(blocks, estimates, candidates, _ASK).groupBy("g").applyInArrow(group, shared.REPLY)
    return shared.answer(blocks, estimates.unionByName(exact), keep, OUT)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
