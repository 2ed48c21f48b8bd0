"""Approximate nearest neighbours by low-dimensional stable projections.

Unit vectors are projected on ``DIMENSIONS`` Gaussian directions (a 2-stable
law): the squared projected distance of two points is their squared distance
times a chi-square variable. A kd-tree over a bounded sample of projections cuts
the projected space into regions; every vector is indexed in its region (and in
one of its parts, if regions would hold over ``REGION_ROWS`` rows), where the
same cuts go on down to leaves.

A query first searches its own region, then, nearest first and in ``ROUNDS``, the
regions whose box its bound still reaches; the bound tightens from round to
round. A region's queries of a round are dealt into parts of about
``QUERY_ROWS``, each with its own copy of the region, so a task holds a bounded
number of points and of queries whatever the size of the table. In a region a
query verifies leaf after leaf, nearest box first, and
stops when a point of the rest could be among its best so far with a chance of
less than ``1 - CONFIDENCE``: the squared distance to the next box, divided by
the squared distance of its worst kept neighbour, is beyond that chi-square
quantile. Verification is exact cosine in double precision.

Equal vectors are indexed once, with their smallest ids, so a vector that a
third of the rows share costs one row. Queries meet regions, never each other.

Edge cases: vectors that are null, zero, or hold null or non-finite components,
and rows without an id, take no part; vectors are only compared with those of
their own length; a query with fewer candidates returns them all; rows that share an
id are candidates each, and as queries give one answer; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm import shared
from foliary.llm.labels import bounded

K = 5
DIMENSIONS = 8
CONFIDENCE = 0.98
REGION_ROWS = 8_192
LEAF_ROWS = 256
#: Queries that meet a region in one task, about.
QUERY_ROWS = 4_096
#: Regions searched by the end of each round, nearest first; the last round takes all that are left.
ROUNDS = (1, 9, None)
#: Bound of the sample that the regions are cut by, and of their number.
SAMPLE = 20_000
MAX_REGIONS = 4_096
_POINT = "width int, region int, part int, vec binary, ids array<long>"
_FOUND = "query_id long, score double, vec_id long"


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the closed form for even ``k``."""
    if k % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x):
        term = total = 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 100.0 * k
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(width: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(width).standard_normal((width, dimensions))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Cells:
    """A kd-tree by medians: box bounds of the cells, and the cell of any point."""

    def __init__(self, points: np.ndarray, cells: int):
        d = points.shape[1]
        self.low, self.high, self.nodes = [], [], []
        self.root = self._grow(points, cells, np.full(d, -np.inf), np.full(d, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points, cells, low, high):
        if cells > 1 and len(points) > 1:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            value = float(np.median(points[:, axis]))
            left = points[:, axis] < value
            if 0 < left.sum() < len(points):
                high_l, low_r = high.copy(), low.copy()
                high_l[axis] = low_r[axis] = value
                at = len(self.nodes)
                self.nodes.append(None)
                a = self._grow(points[left], cells // 2, low, high_l)
                b = self._grow(points[~left], cells - cells // 2, low_r, high)
                self.nodes[at] = (axis, value, a, b)
                return at
        self.low.append(low)
        self.high.append(high)
        return -len(self.low)  # a cell

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            else:
                axis, value, a, b = self.nodes[node]
                left = points[rows, axis] < value
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        out = np.zeros((len(points), len(self.low)))
        for axis in range(points.shape[1]):
            x = points[:, axis : axis + 1]
            gap = np.maximum(np.maximum(self.low[:, axis] - x, x - self.high[:, axis]), 0)
            out += gap**2
        return out


def _usable(batch):
    """Rows of a batch that take part: ids and vectors, by vector length."""
    column = batch.column("embedding")
    lists, ids = column.to_pylist(), batch.column("vec_id").to_pylist()
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, lists, strict=True):
        if i is not None and v and None not in v:
            g = groups.setdefault(len(v), ([], []))
            g[0].append(i)
            g[1].append(v)
    for width, (i, v) in groups.items():
        x = np.array(v, np.float64)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield width, np.array(i, np.int64)[good], x[good] + 0.0


def _vectors(table: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for width, ids, x in _usable(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), width, np.int32)), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], names=["width", "vec_id", "vec"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "width int, vec_id long, vec binary")


class _Region:
    """The points of a region, cut into leaves."""

    def __init__(self, vectors: np.ndarray, dimensions: int, leaf_rows: int):
        self.unit = unit(vectors)
        self.projected = self.unit @ projection(vectors.shape[1], dimensions)
        self.cells = Cells(self.projected, max(1, len(vectors) // leaf_rows))
        order = np.argsort(cell := self.cells.of(self.projected), kind="stable")
        self.rows = np.split(order, np.searchsorted(cell[order], np.arange(1, len(self.cells.low))))

    def search(self, queries: np.ndarray, worst: np.ndarray, keep: int, limit: float, dimensions: int):
        """(rows, scores) of the ``keep`` best of each query; ``worst`` is the score it must beat to begin with."""
        u = unit(queries)
        gaps = self.cells.distances(u @ projection(queries.shape[1], dimensions))
        order = np.argsort(gaps, axis=1, kind="stable")
        best = np.full((len(u), keep), -np.inf)
        rows = np.full((len(u), keep), -1, np.int64)
        active = np.arange(len(u))
        for wave in range(order.shape[1]):
            leaf = order[active, wave]
            bound = np.maximum(best[active, -1], worst[active])
            reach = np.maximum(2 - 2 * bound, 0) * limit
            active = active[gaps[active, leaf] <= reach]
            leaf = order[active, wave]
            by_leaf = np.argsort(leaf, kind="stable")
            for number, a, b in shared.cut(leaf[by_leaf]):
                who, points = active[by_leaf[a:b]], self.rows[number]
                score = u[who] @ self.unit[points].T
                both = np.concatenate([best[who], score], axis=1)
                names = np.concatenate([rows[who], np.broadcast_to(points, score.shape)], axis=1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :keep]
                best[who], rows[who] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
            if not len(active):
                break
        return rows, best


def search(table: DataFrame, queries: DataFrame, k: int = K, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, region_rows: int = REGION_ROWS, leaf_rows: int = LEAF_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row among all other rows of ``table``."""
    spark = table.sparkSession
    limit = chi_square_quantile(confidence, dimensions)
    # equal vectors: the smallest ids, one more than asked for as the query's own may be among them
    ranked = _vectors(table).withColumn("n", F.row_number().over(Window.partitionBy("width", "vec").orderBy("vec_id")))
    points = shared.materialise(ranked.where(F.col("n") <= k + 1).groupBy("width", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    sizes = {r.width: r.n for r in points.groupBy("width").agg(F.count("*").alias("n")).collect()}
    cells, parts = {}, {}
    for width, n in sizes.items():
        regions = min(MAX_REGIONS, max(1, n // region_rows))
        parts[width] = max(1, -(-n // (regions * region_rows * 2)))
        sample = bounded(points.where(F.col("width") == width), SAMPLE, n, "vec").select("vec").toPandas()["vec"]
        x = unit(np.frombuffer(b"".join(sample), np.float64).reshape(-1, width)) if len(sample) else np.zeros((0, width))
        x = x[np.lexsort(x.T)]
        cells[width] = Cells(x @ projection(width, dimensions), regions)

    def place(batches):
        for batch in batches:
            width, vec = batch.column("width").to_numpy(), batch.column("vec").to_pylist()
            region = np.zeros(len(vec), np.int32)
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                x = unit(np.frombuffer(b"".join(vec[i] for i in mine), np.float64).reshape(-1, w))
                region[mine] = cells[int(w)].of(x @ projection(int(w), dimensions))
            part = np.array([zlib.crc32(v) % parts[int(w)] if parts[int(w)] > 1 else 0 for v, w in zip(vec, width, strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("width"), pa.array(region), pa.array(part), batch.column("vec"), batch.column("ids")], names=["width", "region", "part", "vec", "ids"])

    indexed = shared.materialise(points.mapInArrow(place, _POINT))

    def visit(begin: int, end: int | None):
        """Which of a query's regions from the ``begin``-th to the ``end``-th, nearest first, its bound reaches."""

        def run(batches):
            for batch in batches:
                out = {name: [] for name in visit_schema.names}
                for row in batch.to_pylist():
                    if len(out["width"]) >= query_rows:
                        yield pa.RecordBatch.from_pydict(out, schema=visit_schema)
                        out = {name: [] for name in visit_schema.names}
                    w = row["width"]
                    if w not in cells:
                        continue
                    p = unit(np.frombuffer(row["vec"], np.float64).reshape(1, -1)) @ projection(w, dimensions)
                    gap, bound = cells[w].distances(p)[0], row["bound"]
                    gap[cells[w].of(p)[0]] = -1.0  # its own region
                    regions = np.argsort(gap, kind="stable")[begin:end]
                    regions = regions[gap[regions] <= max(2 - 2 * bound, 0) * limit].tolist()
                    for r in regions:
                        for part in range(parts[w]):
                            for name, value in zip(out, (w, r, part, row["query_id"], row["vec"], bound), strict=True):
                                out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=visit_schema)

        return run

    visits = "width int, region int, part int, query_id long, vec binary, bound double"
    visit_schema = shared._arrow_schema(visits)
    found_schema = shared._arrow_schema(_FOUND)

    def inside(key, left, right):
        if not left.num_rows or not right.num_rows:
            return found_schema.empty_table()
        w = key[0].as_py()
        left = left.sort_by("vec")
        x = np.frombuffer(b"".join(left.column("vec").to_pylist()), np.float64).reshape(-1, w)
        ids = left.column("ids").to_pylist()
        region = _Region(x, dimensions, leaf_rows)
        out = {"query_id": [], "score": [], "vec_id": []}
        for a in range(0, right.num_rows, 1024):
            part = right.slice(a, 1024)
            names = part.column("query_id").to_pylist()
            q = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float64).reshape(-1, w)
            rows, _ = region.search(q, part.column("bound").to_numpy(), k + 1, limit, dimensions)
            who, where = np.nonzero(rows >= 0)
            points_at = rows[who, where]
            score = cosine(q[who], x[points_at])
            for i, r, s in zip(who.tolist(), points_at.tolist(), score.tolist(), strict=True):
                own = list(ids[r])
                if names[i] in own:  # the query's own row
                    own.remove(names[i])
                for v in own[:k]:
                    out["query_id"].append(names[i])
                    out["score"].append(s)
                    out["vec_id"].append(v)
        return pa.table(out, schema=found_schema)

    def best(frames: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return frames.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = shared.materialise(_vectors(queries).withColumnRenamed("vec_id", "query_id"))
    found, begin = None, 0
    for end in ROUNDS:
        if begin and begin >= max((len(c.low) for c in cells.values()), default=0):
            break
        wanted = asked.withColumn("bound", F.lit(-1.0))
        if found is not None:
            # a query that has k neighbours must beat the last of them
            bounds = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            wanted = asked.join(bounds, "query_id", "left").select("width", "query_id", "vec", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-1.0)).alias("bound"))
        visited = shared.materialise(wanted.mapInArrow(visit(begin, end), visits))
        by = ["width", "region", "part", "cut"]
        left, right = _meetings(indexed, visited, query_rows)
        more = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(inside, _FOUND)
        # a vector id that several rows share stands once for each row in each round
        found = shared.materialise(best(more if found is None else found.unionByName(more)).drop("rank"))
        begin = end
    return best(found).select("query_id", "rank", "vec_id", "score")


def _meetings(indexed: DataFrame, visited: DataFrame, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points and queries of each region that is visited, with the part (``cut``) of its queries that they meet in."""
    by = ["width", "region", "part"]
    cuts = visited.groupBy(*by).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("cuts"))
    left = indexed.join(cuts, by).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    right = visited.join(cuts, by).withColumn("cut", F.pmod(F.xxhash64("query_id", "vec"), F.col("cuts")).cast("int")).drop("cuts")
    return left, right


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows, each scaled by its largest component first so that no square overflows."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.where(F.col("vec_id") % 50 == 0))
