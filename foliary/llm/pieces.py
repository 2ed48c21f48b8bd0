"""SentencePiece encoding and decoding as a relational lattice.

A text, with a leading space and its spaces as U+2581, is cut into words where
no piece of the model can join two neighbouring characters. Distinct words are
encoded once:

1. every substring of up to the longest piece is exploded and equi-joined to the
   piece table: the edges of the word's lattice;
2. the edges are grouped by word;
3. a higher-order ``aggregate`` folds them: for a unigram model Viterbi's best
   path; for a BPE model (such as ``piece_bpe_32k.model``) the best path is not
   what the model means, so the fold takes the edges from the best score on (the
   leftmost first on ties) and joins the two neighbours that make up an edge.
   The joins of a trained model come in the order of their scores, so one pass
   is what merging the best pair again and again gives.

Blocks of documents send their distinct words to slices of the word space and
receive their pieces; words over ``LONG`` characters, more than a mask has bits
for, and words with pieces of equal scores, whose joins have no fixed order, are
joined with a heap in Python by the same rule.
Characters that aren't pieces become their UTF-8 bytes' pieces, or the unknown
piece without byte fallback.

Decoding looks ids up in the piece table and joins their bytes in order.

Edge cases: a null text has null ids, an empty one none; U+2581 in a text counts
as a space; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 48
#: UTF-8 bytes of text per slice of the word space, about.
SLICE_BYTES = 6_000_000
#: Characters hashed at a time.
HASH_CHARS = 250_000
#: Pieces up to which the piece table is broadcast.
BROADCAST_PIECES = 1_000_000


# ---------------------------------------------------------------------- model


def _varint(data: bytes, at: int):
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """Fields of a protocol-buffer message: number and value."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 1:
            value, at = data[at : at + 8], at + 8
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif tag & 7 == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("unknown wire type")
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What encoding needs of a model: scored pieces, ids of byte pieces, the unknown piece, and the kind."""

    pieces: list[tuple[str, float, int]]
    byte_ids: list[int] | None
    unknown: int
    kind: str
    texts: list[str]
    add_space: bool = True
    joins: set[tuple[str, str]] = field(default_factory=set)

    def __post_init__(self):
        self.joins = {(a, b) for p, _, _ in self.pieces for a, b in zip(p, p[1:])}
        self.longest = max((len(p) for p, _, _ in self.pieces), default=1)

    @staticmethod
    def read(spark: SparkSession, path: str) -> PieceModel:
        """Read a ``.model`` file with Spark's reader, so that it may be in any store."""
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
        pieces, kind, unknown, fallback, add_space, extra = [], 1, 0, False, True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                score = np.frombuffer(f.get(2, bytes(4)), "<f4")[0]
                pieces.append((f[1].decode(), float(score), f.get(3, 1)))
            elif number == 2:
                f = dict(_fields(value))
                kind, unknown, fallback = f.get(3, 1), f.get(40, 0), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                add_space, extra = bool(f.get(3, 1)), bool(f.get(4, 1))
                if f.get(2) or extra:
                    raise ValueError("only models that don't normalise the text are supported")
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        normal = [(p, s, i) for i, (p, s, t) in enumerate(pieces) if t == 1]
        if any(p[i] != SPACE and p[i + 1] == SPACE for p, _, _ in normal for i in range(len(p) - 1)):
            raise ValueError("pieces that go on over a space aren't supported")
        by_text = {p: i for i, (p, _, t) in enumerate(pieces) if t == 6}
        byte_ids = [by_text[f"<0x{b:02X}>"] for b in range(256)] if fallback else None
        return PieceModel(normal, byte_ids, unknown, "unigram" if kind == 1 else "bpe", [p for p, _, _ in pieces], add_space)


class Cutter:
    """Cuts texts into words, between characters that no piece joins, and knows the ids of pieces."""

    def __init__(self, model: PieceModel):
        chars = sorted({c for pair in model.joins for c in pair})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        joins = np.zeros((self.width, self.width), bool)
        for a, b in model.joins:
            joins[self.number[ord(a)], self.number[ord(b)]] = True
        self.joins = joins.ravel()
        self.add_space = model.add_space
        # a character by itself: its piece, or -1 - its code point
        self.single = -1 - np.arange(0x110000, dtype=np.int32)
        for p, _, i in model.pieces:
            if len(p) == 1:
                self.single[ord(p)] = i
        longer = [(p, i) for p, _, i in model.pieces if len(p) > 1]
        points = np.frombuffer("".join(p for p, _ in longer).encode("utf-32-le"), np.uint32)
        size = np.array([len(p) for p, _ in longer], np.int64)
        hashes = self.hashes(points, self.number[points], np.cumsum(size) - size, np.cumsum(size))
        order = np.argsort(hashes)
        self.piece_hash, self.piece_id = hashes[order], np.array([i for _, i in longer], np.int32)[order]

    def hashes(self, points: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs in ascending order that don't overlap, about ``HASH_CHARS`` characters at a time: a run's hash doesn't depend on its place."""
        table = shared.mix64(np.arange(1, self.width + 1, dtype=np.uint64))
        out = np.empty(len(start), np.uint64)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_CHARS, "right")))
            own, first = slice(start[a], end[b - 1]), start[a]
            symbols = table[kind[own]]
            odd = np.flatnonzero(kind[own] == 0)
            symbols[odd] = shared.mix64(points[own][odd].astype(np.uint64) + np.uint64(1 << 40))
            out[a:b] = shared.RollingHash(symbols, mixed=True).of(start[a:b] - first, end[a:b] - first)
            a = b
        return out

    def ids(self, points: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Ids of the pieces that begin at ``heads``."""
        start = np.flatnonzero(heads)
        end = np.append(start[1:], len(points)) if len(start) else start
        out = self.single[points[start]]
        long = np.flatnonzero(end - start > 1)
        out[long] = self.piece_id[np.searchsorted(self.piece_hash, self.hashes(points, self.number[points], start[long], end[long]))]
        return out

    def words(self, block):
        """Code points of all texts, their numbers, the bounds of their words, and the number of words of each text."""
        texts = [block.raw(i).decode().replace(" ", SPACE) for i in range(len(block))]
        texts = [(SPACE if self.add_space and t else "") + t for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        kind = self.number[points]
        cut = np.ones(len(points) + 1, bool)
        if len(points):
            np.logical_not(self.joins[kind[:-1] * self.width + kind[1:]], out=cut[1:-1])
        cut[ends] = True
        bounds = np.flatnonzero(cut) if len(points) else np.zeros(1, np.int64)
        counts = np.diff(np.searchsorted(bounds, np.concatenate([[0], ends])))
        return points, kind, bounds, counts


class _Words:
    """Distinct words of a block, in order of (slice, first characters), and the word at each place."""

    def __init__(self, cutter: Cutter, block, bits: int):
        points, kind, bounds, self.counts = cutter.words(block)
        start, end = bounds[:-1], bounds[1:]
        hashes = cutter.hashes(points, kind, start, end)
        distinct, index, which = np.unique(hashes, return_index=True, return_inverse=True)
        start, end = start[index], end[index]
        piece = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
        # words that begin alike stand together, which compresses better
        head = np.zeros(len(distinct), np.uint64)
        for i in range(4):
            more = start + i < end
            head = (head << np.uint64(16)) | np.where(more, kind[np.minimum(start + i, max(len(kind) - 1, 0))], 0).astype(np.uint64) if len(kind) else head
        order = np.lexsort((distinct, head, piece))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.piece, self.which = piece[order], place[which]
        self.points, self.start, self.end = points, start[order], end[order]

    def spelled(self, a: int, b: int):
        """Sizes of some of the distinct words, and their characters laid end to end."""
        length = self.end[a:b] - self.start[a:b]
        return length, self.points[np.repeat(self.start[a:b], length) + _within(length)]

    def pack(self, a: int, b: int) -> bytes:
        """Some of the distinct words: their sizes in bytes, and their UTF-8."""
        import zstandard

        length, points = self.spelled(a, b)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        sizes = np.add.reduceat(width, np.cumsum(length) - length)
        return zstandard.ZstdCompressor(level=3).compress(sizes.astype(np.uint32).tobytes() + points.tobytes().decode("utf-32-le").encode())


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _unpack(payload: bytes, n: int):
    """Words of a packed part as an Arrow string array."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n))]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[4 * n :]))


# -------------------------------------------------------------------- lattice


def lattice(words: DataFrame, model: PieceModel, keys: list[str], singles: bool) -> DataFrame:
    """keys, word, n, edges, tied: the pieces in each word, grouped by word (keys + word must be distinct).

    Pieces are met by their 64-bit hashes, as hash tables of numbers are faster.
    Without ``singles`` only pieces of two characters or more, and only words
    that have any.
    """
    spark = words.sparkSession
    times = Counter(s for _, s, _ in model.pieces)
    table = spark.createDataFrame([(p, float(s), i, times[s] > 1) for p, s, i in model.pieces if singles or len(p) > 1], "piece string, score double, id int, tied boolean")
    table = table.select(F.xxhash64("piece").alias("piece"), "score", "id", "tied")
    if len(model.pieces) <= BROADCAST_PIECES:
        table = F.broadcast(table)
    least = 1 if singles else 2
    named = words.select(*keys, "word", F.xxhash64("word").alias("__key"), F.length("word").alias("n")).where(F.col("n") >= least)
    starts = named.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("start"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(least), F.least(F.lit(max(model.longest, least)), F.col("n") - F.col("start")))).alias("size"))
    spans = spans.withColumn("piece", F.xxhash64(F.substring("word", F.col("start") + 1, F.col("size"))))
    edges = spans.join(table, "piece", "left" if singles else "inner")
    if singles:  # every character is an edge, piece or not
        edges = edges.where(F.col("id").isNotNull() | (F.col("size") == 1))
    edge = F.struct((-F.col("score")).alias("cost"), "start", (F.col("start") + F.col("size")).alias("end"), "id")
    grouped = edges.groupBy(*keys, "__key", "n").agg(F.first("word").alias("word"), F.collect_list(edge).alias("edges"), F.max("tied").alias("tied"))
    return grouped.select(*keys, "word", "n", "edges", "tied")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: lambdas otherwise evaluate what they enclose each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bpe_fold(n: Column, edges: Column) -> Column:
    """The edges left when neighbours have been joined from the best edge on.

    The state is a mask of the bounds between symbols. An edge joins two symbols
    if its ends are bounds and one bound lies between them.
    """
    masked = F.transform(F.array_sort(edges), lambda e: F.struct((_bit(e["start"]) + _bit(e["end"])).alias("ends"), (_bit(e["end"]) - _bit(e["start"]) * 2).alias("inner"), e["start"].alias("start"), e["end"].alias("end"), e["id"].alias("id")))

    def join(bounds, e):
        return F.when((bounds.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bounds.bitwiseAND(e["inner"])) == 1), bounds.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(bounds)

    def left(state):
        mine = F.filter(state["edges"], lambda e: (state["bounds"].bitwiseAND(e["ends"]) == e["ends"]) & (state["bounds"].bitwiseAND(e["inner"]) == 0))
        return F.transform(mine, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["id"].alias("id")))

    def fold(found):
        return F.struct(found.alias("edges"), F.aggregate(found, _bit(n + 1) - 1, join).alias("bounds"))

    return _let(_let(masked, fold), left)


def viterbi_fold(n: Column, edges: Column, unknown: float) -> Column:
    """The edges on the path of the greatest score (ties: the longer last piece)."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def step(best, at):
        into = F.filter(edges, lambda e: e["end"] == at)
        options = F.transform(into, lambda e: F.struct((F.get(best, e["start"])["score"] + F.coalesce(-e["cost"], F.lit(unknown))).alias("score"), (-e["start"]).alias("back")))
        return F.concat(best, F.array(_let(F.array_max(options), lambda top: F.struct(top["score"].alias("score"), (-top["back"]).alias("back")))))

    def path(best):
        def follow(bounds, _):
            head = F.get(bounds, F.lit(0))
            return F.when(head > 0, F.concat(F.array(F.get(best, head)["back"]), bounds)).otherwise(bounds)

        bounds = F.aggregate(F.sequence(F.lit(1), n), F.array(n), follow)
        pairs = lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end")))
        return _let(_let(bounds, pairs), lambda kept: F.filter(edges, lambda e: e["id"].isNotNull() & F.array_contains(kept, F.struct(e["start"].alias("start"), e["end"].alias("end")))))

    chosen = _let(F.aggregate(F.sequence(F.lit(1), n), first, step), path)
    return F.transform(chosen, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["id"].alias("id")))


def encode_words(words: DataFrame, model: PieceModel, keys: list[str]) -> DataFrame:
    """keys, word, pieces: (start, end, id) of the pieces in distinct short words; characters outside them stand alone.

    Null pieces: the fold can't tell (BPE pieces of equal score).
    """
    grouped = lattice(words, model, keys, model.kind == "unigram")
    if model.kind == "bpe":
        # where several pieces share a score, the order of joins depends on the joins before
        pieces = F.when(~F.col("tied"), bpe_fold(F.col("n"), F.col("edges")))
    else:
        lowest = min((s for _, s, _ in model.pieces), default=0.0)
        pieces = viterbi_fold(F.col("n"), F.col("edges"), lowest - 10.0)
    return grouped.select(*keys, "word", pieces.alias("pieces"))


def join_by_heap(word: str, scores: dict[str, float]) -> list[int]:
    """Starts of the pieces of one word by the BPE rule."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(a):
        b = end[a]
        if b < n and (s := scores.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (-s, a, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, to = heapq.heappop(heap)
        if not alive[a] or end[a] >= n or end[end[a]] != to:
            continue
        b = end[a]
        alive[b] = False
        end[a] = to
        if to < n:
            before[to] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [a for a in range(n) if alive[a]]


def _best_path(word: str, scores: dict[str, float], longest: int) -> list[int]:
    """Starts of the pieces of one word by Viterbi's rule."""
    lowest = min(scores.values(), default=0.0) - 10.0
    best = [(0.0, 0)]
    for at in range(1, len(word) + 1):
        options = []
        for size in range(1, min(longest, at) + 1):
            s = scores.get(word[at - size : at])
            if s is not None or size == 1:
                options.append((best[at - size][0] + (lowest if s is None else s), size - at))
        score, back = max(options)
        best.append((score, -back))
    out, at = [], len(word)
    while at:
        at = best[at][1]
        out.append(at)
    return out[::-1]


# ------------------------------------------------------------------- operator


def encode(docs: DataFrame, model: PieceModel, block_bytes: int = shared.BLOCK_BYTES, slice_bytes: int = SLICE_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id, text, ids of every document; with ``decoded`` also the text that the ids decode to."""
    total = shared.text_bytes(docs)
    blocks = shared.deal_blocks(docs, shared.block_count(total, block_bytes), block_bytes)
    bits = shared.slices_for(total, slice_bytes)
    slices = 1 << bits
    cutter = Cutter(model)
    scores = {p: s for p, s, _ in model.pieces}
    byte_ids, unknown, kind, longest = model.byte_ids, model.unknown, model.kind, model.longest

    def ask(block_id, block):
        words = _Words(cutter, block, bits)
        rows = {"slice": [], "block": [], "n": [], "data": []}
        for g, a, b in shared.cut(words.piece):
            rows["slice"].append(g)
            rows["block"].append(block_id)
            rows["n"].append(b - a)
            rows["data"].append(words.pack(a, b))
        return rows

    def received(table):
        return pa.concat_arrays([_unpack(d, n) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)])

    def distinct(key, table):
        import pyarrow.compute as pc

        words = received(table).unique()
        words = words.filter(pc.less_equal(pc.utf8_length(words), LONG))
        return pa.table({"part": pa.array(np.full(len(words), key[0].as_py(), np.int32)), "word": words})

    asked = shared.ask(blocks, ask, "slice int, block int, n int, data binary").repartition(slices, "slice")
    words = asked.groupBy("slice").applyInArrow(distinct, "part int, word string").repartition(slices, "part")
    coded = encode_words(words, model, ["part"])

    def reply(key, left, right):
        import pyarrow.compute as pc

        own = received(left)
        length = np.asarray(pc.utf8_length(own)).astype(np.int64)
        base = np.cumsum(length) - length
        heads = np.ones(int(length.sum()), bool)
        open_words = length > LONG
        if right.num_rows:
            names, found = (pa.concat_arrays(right.column(c).chunks) for c in ("word", "pieces"))
            pieces_in = np.asarray(pc.fill_null(pc.list_value_length(found), 0)).astype(np.int64)
            flat = found.flatten()
            start, end = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            at = np.asarray(pc.fill_null(pc.index_in(own, value_set=names), -1)).astype(np.int64)
            have = np.flatnonzero(at >= 0)
            open_words[have] = ~np.asarray(found.is_valid())[at[have]]
            n = pieces_in[at[have]]
            take = np.repeat((np.cumsum(pieces_in) - pieces_in)[at[have]], n) + _within(n)
            inner = end[take] - start[take] - 1
            heads[np.repeat(start[take] + np.repeat(base[have], n) + 1, inner) + _within(inner)] = False
        for i in np.flatnonzero(open_words).tolist():
            word = own[i].as_py()
            heads[base[i] : base[i] + len(word)] = False
            heads[base[i] + np.array(join_by_heap(word, scores) if kind == "bpe" else _best_path(word, scores, longest))] = True
        counts = np.array(left.column("n").to_pylist())
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(ends)
        data = [shared.bits(heads[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        k = left.num_rows
        return pa.table({"block": left.column("block"), "kind": pa.array([0] * k, pa.int32()), "slice": left.column("slice"), "n": pa.array(sizes.astype(np.int32)), "data": pa.array(data, pa.binary())})

    replies = asked.groupBy("slice").cogroup(coded.groupBy("part")).applyInArrow(reply, shared.REPLY)

    def assemble(block_id, block, table):
        words = _Words(cutter, block, bits)
        length, points = words.spelled(0, len(words.start))
        heads = shared.replies_in_order(table, 0, len(points))
        flat = cutter.ids(points, heads)
        base = np.cumsum(length) - length
        size = np.add.reduceat(heads, base).astype(np.int64) if len(base) else base
        begin = np.cumsum(size) - size
        n = size[words.which]
        at = np.repeat(begin[words.which] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        ids = flat[at]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(words.counts)])]
        ids, grown = spelled_out(ids, byte_ids, unknown)
        ends = grown[ends]
        out = [None if block.nulls[i] else ids[ends[i] : ends[i + 1]] for i in range(len(block))]
        texts = [None if block.nulls[i] else block.raw(i).decode() for i in range(len(block))]
        rows = {"doc_id": block.ids, "text": texts, "ids": pa.array(out, pa.list_(pa.int32()))}
        return rows | {"decoded": decoder.texts(rows["ids"])} if decoded else rows

    decoder = Decoder(model)
    return shared.answer(blocks, replies, assemble, "doc_id long, text string, ids array<int>" + ", decoded string" * decoded)


def spelled_out(ids: np.ndarray, byte_ids: list[int] | None, unknown: int):
    """``ids`` with each character that no piece has (-1 - code point) as its bytes' pieces or ``unknown``, and the new place of each old one."""
    rare = np.flatnonzero(ids < 0)
    chars, which = np.unique(ids[rare], return_inverse=True)
    codes = [[byte_ids[b] for b in chr(-1 - c).encode()] if byte_ids else [unknown] for c in chars.tolist()]
    size = np.ones(len(ids), np.int64)
    size[rare] = np.array([len(c) for c in codes], np.int64)[which]
    grown = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(ids, size).astype(np.int32)
    at = grown[rare]
    for k in range(max(map(len, codes), default=0)):
        code = np.array([c[k] if k < len(c) else -1 for c in codes])[which]
        out[at[code >= 0] + k] = code[code >= 0]
    return out, grown


class Decoder:
    """Texts of lists of ids."""

    def __init__(self, model: PieceModel):
        byte_of = {i: b for b, i in enumerate(model.byte_ids or [])}
        self.parts = [bytes([byte_of[i]]) if i in byte_of else t.replace(SPACE, " ").encode() for i, t in enumerate(model.texts)]
        self.add_space = model.add_space

    def texts(self, ids: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        flat = ids.flatten().to_numpy(zero_copy_only=False)
        known = np.where((flat >= 0) & (flat < len(self.parts)), flat, len(self.parts))
        count = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        pieces = pa.array([*self.parts, b""], pa.binary()).take(pa.array(known))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pieces)
        out = []
        for text, valid in zip(pc.binary_join(lists, b"").to_pylist(), ids.is_valid().to_pylist(), strict=True):
            text = text.decode("utf-8", "replace") if valid else None
            out.append(text[1:] if valid and self.add_space and text.startswith(" ") else text)
        return pa.array(out, pa.string())


def decode(tokens: DataFrame, model: PieceModel) -> DataFrame:
    """All columns of ``tokens`` and ``decoded``, the text of the column ``ids``; ids outside the model are skipped."""
    from pyspark.sql.types import StringType, StructField, StructType

    decoder = Decoder(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a batch may hold long texts
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.texts(part.column("ids"))], names=[*part.schema.names, "decoded"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", StringType())]))


def op4_pieces(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    model = PieceModel.read(spark, f"file://{path}" if path.startswith("/") else path)
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded").eqNullSafe(F.translate("text", SPACE, " "))).alias("round_trip"))
