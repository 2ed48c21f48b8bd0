"""Substring dedup by bytes and by words, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foliary.llm import substring_dedup, suffix_dedup


def by_bytes(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(b[j : j + length] for b in texts for j in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if starts[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"hot": 3, "block_bytes": 5_000, "bucket_bytes": 4_000, "per_slice": 50}])
def test_bytes(docs, rows, options):
    got = [tuple(r) for r in suffix_dedup.dedup(docs, length=80, anchor=16, **options).drop("kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_bytes(rows, 80)))


def test_index_against_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(rng.randint(1, 12))]
        length = rng.randint(2, 12)
        everywhere = Counter(t[j : j + length] for t in texts for j in range(len(t) - length + 1))
        expected = [everywhere[t[j : j + length]] > 1 for t in texts for j in range(len(t) - length + 1)]
        got = suffix_dedup.repeated_starts(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), length)
        assert got.tolist() == expected


def test_index_is_run_length_compressed():
    text = np.frombuffer(b"the same sentence again and again. " * 40, np.uint8)
    index = suffix_dedup.RunLengthIndex(text, np.array([len(text)]), len(text))
    assert index.runs < len(text) / 10


def by_words(rows, window):
    order = [((1 << 63) - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in order:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (raw, _), (i, w) in zip(rows, order, strict=True):
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((raw, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4_000, "slice_bits": 10, "per_slice": 100}])
def test_words(docs, rows, options):
    got = [tuple(r) for r in substring_dedup.dedup(docs, **options).drop("kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_words(rows, 13)))


def test_empty_tables(no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0
    assert substring_dedup.dedup(no_docs).count() == 0


def test_a_block_does_not_depend_on_the_order_of_its_parts(spark, docs):
    from foliary.llm import shared

    dealt = shared.deal_blocks(docs.repartition(5), 2).collect()
    for block in {r.block for r in dealt}:
        parts = [bytes(r.part) for r in dealt if r.block == block]
        assert len(parts) > 1
        one, other = shared.unpack_block(parts), shared.unpack_block(parts[::-1])
        assert one.ids == other.ids
        for name in ("data", "offsets", "nulls"):
            assert getattr(one, name).tolist() == getattr(other, name).tolist()


def test_equal_rows_share_out_over_blocks(spark):
    """Half of all rows are one row, without a doc_id; another is repeated with an id; longer ones stay single."""
    from foliary.llm import shared

    rng = random.Random(5)
    own = [(i, "".join(rng.choice("abcdefgh ") for _ in range(300))) for i in range(300)]
    rows = own + [(None, own[0][1])] * 300 + [(None, None)] * 500 + [(7, "again " * 200)] * 40 + [(8, "long " * 4_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    most, held = 5_000, {}
    for r in shared.deal_blocks(docs, 60, most).collect():
        held.setdefault(r.block, []).append(bytes(r.part))
    blocks = [shared.unpack_block(parts) for parts in held.values()]
    found = Counter((i, None if block.nulls[k] else block.raw(k).decode()) for block in blocks for k, i in enumerate(block.ids))
    assert found == Counter(rows)
    copies = [sum(i is None for i in block.ids) for block in blocks]
    assert max(copies) < 250 and sum(c > 0 for c in copies) > 15
    got = [tuple(r) for r in suffix_dedup.dedup(docs, length=80, anchor=16, block_bytes=most).drop("kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_bytes(rows, 80)))
    got = [tuple(r) for r in substring_dedup.dedup(docs, block_bytes=most).drop("kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_words(rows, 13)))


def test_anchors_spread_over_slices():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 200_000).astype(np.uint8)

    class Text:
        ids, offsets = [1], np.array([0, len(data)])

    Text.data = data
    slices = np.bincount((suffix_dedup._Segments(Text, 400, 64).anchor >> np.uint64(61)).astype(int), minlength=8)
    assert slices.max() < 2 * slices.mean()
