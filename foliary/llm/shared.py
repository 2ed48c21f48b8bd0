"""What the operators share: the shared folder, text blocks and hash kernels.

Text blocks. Operators that must bring an answer back to the text (substring
dedup, tokenisation) deal the documents once into blocks of about
``BLOCK_BYTES`` by a hash of the row. A block crosses the shuffle as
zstd-compressed UTF-8 and is the unit of work of one Python call, so a task
holds one block at a time whatever the size of the corpus. The parts of a block
arrive in any order, another one at every reading, so a block is put in the
order of its rows' hashes: every kernel sees the same block each time. Rows equal
in doc_id and text that together would fill a block are dealt in shares of a block.

Questions and replies. A block asks about its keys (hashes) by sending them,
once each, to the slice of the key space they belong to; a slice answers every
block with one bit per key. Repeats of a hot key inside a block are merged
before the shuffle, so a slice receives a key at most once per block.
"""

from __future__ import annotations

import atexit
import math
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text per block.
BLOCK_BYTES = 2_000_000
#: Bytes that a row takes in a block beside its text, about.
ROW_BYTES = 64

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two polynomial hashes
_SEED = 20_240_229


# ------------------------------------------------------------------ storage


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(shared_dir, "own", None)
        if root is None:
            path = tempfile.mkdtemp(prefix="foliary-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            root = shared_dir.own = f"file://{path}"
    path = f"{root.rstrip('/')}/foliary-{uuid.uuid4().hex}"
    _written.append(path)
    return path


_written: list[str] = []


def forget(spark: SparkSession) -> None:
    """Delete every folder that this process has written; results that still read from them are gone, too."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ------------------------------------------------------------------- blocks


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, math.ceil(total_bytes / block_bytes))


class Block:
    """Documents of one block: ids (None for null), UTF-8 data, offsets, null flags."""

    __slots__ = ("ids", "data", "offsets", "nulls")

    def __init__(self, ids, data, offsets, nulls):
        self.ids, self.data, self.offsets, self.nulls = ids, data, offsets, nulls

    def __len__(self):
        return len(self.ids)

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _string_buffers(column: pa.Array):
    """Offsets, bytes and null mask of an Arrow string column without building Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    n = len(column)
    nulls = np.asarray(column.is_null())
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8).copy() if n else np.zeros(1, np.int64)
    body = column.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return offsets, data, nulls


def _pack(ids, offsets, data, nulls, order, rows) -> bytes:
    import zstandard

    lengths = (offsets[rows + 1] - offsets[rows]).astype("<i8")
    lengths[nulls[rows]] = 0
    parts = [data[offsets[r] : offsets[r + 1]] for r in rows if offsets[r + 1] > offsets[r] and not nulls[r]]
    id_null = np.array([ids[r] is None for r in rows], np.uint8)
    id_value = np.array([0 if ids[r] is None else ids[r] for r in rows], "<i8")
    head = np.array([len(rows)], "<i8").tobytes() + order[rows].astype("<i8").tobytes() + id_value.tobytes() + id_null.tobytes() + lengths.tobytes() + nulls[rows].astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=5).compress(head + (np.concatenate(parts).tobytes() if parts else b""))


def unpack_block(payloads) -> Block:
    """The documents of a block from its packed parts, in the order of their rows' hashes."""
    import zstandard

    hashes, ids, lengths, nulls, bodies = [], [], [], [], []
    undo = zstandard.ZstdDecompressor()
    for payload in payloads:
        raw = undo.decompress(payload)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        at = 8
        hashes.append(np.frombuffer(raw, "<i8", n, at))
        at += 8 * n
        value = np.frombuffer(raw, "<i8", n, at)
        at += 8 * n
        missing = np.frombuffer(raw, np.uint8, n, at)
        at += n
        size = np.frombuffer(raw, "<i8", n, at)
        lengths.append(size)
        at += 8 * n
        nulls.append(np.frombuffer(raw, np.uint8, n, at).astype(bool))
        at += n
        ids.extend(None if m else v for v, m in zip(value.tolist(), missing.tolist(), strict=True))
        body = np.frombuffer(raw, np.uint8, len(raw) - at, at)
        ends = np.cumsum(size).tolist()
        bodies.extend(body[a:b] for a, b in zip([0, *ends], ends, strict=False))
    if not ids:
        return Block([], np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool))
    # rows of one hash are equal
    order = np.argsort(np.concatenate(hashes), kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths)[order])]).astype(np.int64)
    place = order.tolist()
    return Block([ids[i] for i in place], np.concatenate([bodies[i] for i in place]), offsets, np.concatenate(nulls)[order])


def _in_shares(rows: DataFrame, block_bytes: int) -> DataFrame:
    """``rows`` (doc_id, text, hash) with ``place``, which decides the block: the hash, or for rows with copies that would fill a block one for each share of them.

    Copies are counted and made again from their number, so which of them stands where never matters.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    heavy = materialise(rows.groupBy("hash").agg(F.count("*").alias("n"), F.max(size).alias("size")).where((F.col("n") > 1) & (F.col("n") * F.col("size") > block_bytes)).select("hash"))
    if heavy.isEmpty():
        return rows.withColumn("place", F.col("hash"))
    single = rows.join(heavy, "hash", "left_anti").select("doc_id", "text", "hash", F.col("hash").alias("place"))
    # the text and the number of copies travel, not the copies
    counted = rows.join(heavy, "hash", "left_semi").groupBy("doc_id", "text", "hash").agg(F.count("*").alias("n"))
    counted = counted.withColumn("most", F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / size)).cast("long"))
    shares = counted.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("most")).cast("long"))))
    shares = shares.withColumn("place", F.xxhash64("hash", "share")).repartition("place")
    copies = F.least("most", F.col("n") - F.col("share") * F.col("most"))
    made = shares.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return single.unionByName(made.select("doc_id", "text", "hash", "place"))


def deal_blocks(docs: DataFrame, blocks: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, part): the documents dealt by a hash of the whole row into ``blocks`` blocks, compressed."""

    def pack(batches):
        for batch in batches:
            offsets, data, nulls = _string_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            block = batch.column("place").to_numpy(zero_copy_only=False) % blocks  # not negative, as numpy's remainder has the divisor's sign
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            groups = np.split(order, cuts) if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(block[g[0]]) for g in groups], pa.int32()), pa.array([_pack(ids, offsets, data, nulls, hashes, g) for g in groups], pa.binary())], names=["block", "part"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _in_shares(rows.withColumn("hash", F.xxhash64("doc_id", "text")), block_bytes).mapInArrow(pack, "block int, part binary")


def ask(blocks: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(block_id, Block) -> dict of columns`` on each block."""
    types = _arrow_schema(schema)

    def run(key, table):
        return pa.table(kernel(key[0].as_py(), unpack_block(table.column("part").to_pylist())), schema=types)

    return blocks.groupBy("block").applyInArrow(run, schema)


def answer(blocks: DataFrame, replies: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(block_id, Block, reply table)`` on each block with the replies addressed to it."""
    types = _arrow_schema(schema)

    def run(key, left, right):
        if left.num_rows == 0:
            return types.empty_table()
        return pa.table(kernel(key[0].as_py(), unpack_block(left.column("part").to_pylist()), right), schema=types)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


# ------------------------------------------------------------------ hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix (bijective)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept and grown between calls."""
    kept = sys.__dict__.setdefault("_foliary_powers", {})  # per process; not shipped with the function
    have = kept.get(base)
    if have is None or len(have) <= n:
        size = -(-(n + 1) // (1 << 16)) << 16  # whole steps of 2^16, so that a little more text doesn't double it
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        kept[base] = have
    return have


class RollingHash:
    """Polynomial hash modulo 2**64 of any run of a sequence, from prefix sums.

    A symbol counts as a random 64-bit number (bytes through a table, words
    through their own hash); the multiplier is odd, so a run's hash doesn't
    depend on its place. ``which`` chooses one of two independent hashes.
    """

    def __init__(self, symbols: np.ndarray, which: int = 0, mixed: bool = False):
        base = _BASES[which]
        if mixed:  # the symbols are random numbers already
            pass
        elif symbols.dtype == np.uint8:
            symbols = np.random.default_rng(_SEED + which).integers(0, 1 << 63, 256, np.uint64)[symbols] * np.uint64(2) + np.uint64(1)
        else:
            symbols = mix64(symbols + np.uint64(which * 2 + 1))
        self._inverse = pow(base, -1, 1 << 64)
        n = len(symbols)
        with np.errstate(over="ignore"):
            self._prefix = np.zeros(n + 1, np.uint64)
            np.multiply(symbols, powers(base, n)[:n], out=self._prefix[1:])
            np.cumsum(self._prefix[1:], out=self._prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self._prefix[end] - self._prefix[start]) * powers(self._inverse, len(self._prefix))[start])

    def windows(self, size: int) -> np.ndarray:
        """Of all runs of ``size`` symbols."""
        n = len(self._prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix64((self._prefix[size:] - self._prefix[:n]) * powers(self._inverse, len(self._prefix))[:n])


# -------------------------------------------------------- questions, replies


def slices_for(keys: float, per_slice: int) -> int:
    """Bits of the slice number so that a slice receives about ``per_slice`` keys."""
    return max(0, math.ceil(math.log2(max(1.0, keys / per_slice))))


def cut(sorted_slice: np.ndarray):
    """(slice, start, end) of the runs of a sorted slice column."""
    if not len(sorted_slice):
        return []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(sorted_slice)) + 1, [len(sorted_slice)]])
    return [(int(sorted_slice[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def replies_in_order(table, kind: int, total: int) -> np.ndarray:
    """All reply bits of one kind to one block, in the order of its sorted keys."""
    if table.num_rows == 0:
        return np.zeros(total, bool)
    kinds = table.column("kind").to_numpy()
    mine = np.flatnonzero(kinds == kind)
    mine = mine[np.argsort(table.column("slice").to_numpy()[mine], kind="stable")]
    count, data = table.column("n").to_pylist(), table.column("data").to_pylist()
    out = [unbits(data[i], count[i]) for i in mine]
    out = np.concatenate(out) if out else np.zeros(0, bool)
    if len(out) != total:
        raise ValueError(f"{len(out)} replies for {total} keys")
    return out


REPLY = "block int, kind int, slice int, n int, data binary"
