"""Comparison metrics of texts and rasters, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raster_errors(a: DataFrame, b: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Mean and root-mean-square error, greatest difference, and changed shares; a pixel that one side lacks counts as 255."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full")
    d = F.abs(F.coalesce("__a", F.lit(255)) - F.coalesce("__b", F.lit(255)))
    return both.agg(F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d).alias("max_delta"), F.count_if(d > 0).alias("changed"), F.count_if(d > threshold).alias("over"), F.count("*").alias("pixels"))


def ink(pixels: DataFrame, dark: Column) -> DataFrame:
    """Count, share, weighted centre and box of the dark pixels (x, y, weight)."""
    w = F.when(dark, F.col("weight"))
    return pixels.agg(
        F.count_if(dark).alias("count"), (F.count_if(dark) / F.count("*")).alias("ratio"),
        (F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"),
        F.min(F.when(dark, F.col("x"))).alias("left"), F.max(F.when(dark, F.col("x"))).alias("right"), F.min(F.when(dark, F.col("y"))).alias("top"), F.max(F.when(dark, F.col("y"))).alias("bottom"),
    )


def edge_scores(rows: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Precision, recall and F1; a ratio of nothing is 1."""
    tp, fp, fn = (F.count_if(c) for c in (expected & actual, ~expected & actual, expected & ~actual))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    out = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def projection_distance(a: DataFrame, b: DataFrame, axis: str) -> DataFrame:
    """Half the L1 distance of the two normalised histograms along an axis."""

    def shares(side, name):
        h = side.groupBy(axis).agg(F.sum("weight").cast("double").alias("h"))
        return h.crossJoin(side.agg(F.sum("weight").cast("double").alias("t"))).select(axis, (F.col("h") / F.col("t")).alias(name))

    both = shares(a, "__a").join(shares(b, "__b"), axis, "full")
    return both.agg((F.sum(F.abs(F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0)))) / 2).alias("distance"))


def hotspots(pixels: DataFrame, tile: int, top: int) -> DataFrame:
    """The tiles of the greatest total error, with their rank."""
    tiles = pixels.groupBy(F.floor(F.col("x") / tile).cast("long").alias("tx"), F.floor(F.col("y") / tile).cast("long").alias("ty")).agg(F.sum("error").alias("error"), F.count("*").alias("pixels"))
    best = tiles.orderBy(F.col("error").desc(), F.col("pixels").desc(), "ty", "tx").limit(top)
    # the rank of a bounded list
    ordered = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("error")).alias("e"), (-F.col("pixels")).alias("p"), "ty", "tx"))).alias("t"))
    return ordered.select(F.posexplode("t").alias("i", "t")).select((F.col("i") + 1).alias("rank"), "t.tx", "t.ty", (-F.col("t.e")).alias("error"), (-F.col("t.p")).alias("pixels"))


def best_offset(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """The shift (dx, dy) of ``b`` with the least total difference from ``a``; ties: the shorter, then smaller shift."""
    spark = a.sparkSession
    shifts = spark.createDataFrame([(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)], "dx int, dy int")
    moved = b.crossJoin(F.broadcast(shifts)).select("dx", "dy", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.col("value").alias("__b"))
    pairs = moved.join(a.select("x", "y", F.col("value").alias("__a")), ["x", "y"])
    costs = pairs.groupBy("dx", "dy").agg((F.sum(F.abs(F.col("__a") - F.col("__b"))) / F.count("*")).alias("cost"))
    order = F.struct("cost", (F.abs("dx") + F.abs("dy")).alias("far"), "dy", "dx")
    return costs.agg(F.min_by(F.struct("dx", "dy", "cost"), order).alias("m")).select("m.*")


def _common(a: Column, b: Column, n: Column) -> Column:
    """Length of the common beginning of two texts, ``n`` at most."""
    # bisect on equal beginnings: a fixed number of substring comparisons
    halve = lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(F.when(F.substring(a, F.lit(1), F.ceil((s["low"] + s["high"]) / 2).cast("int")) == F.substring(b, F.lit(1), F.ceil((s["low"] + s["high"]) / 2).cast("int")), F.struct(F.ceil((s["low"] + s["high"]) / 2).cast("int").alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (F.ceil((s["low"] + s["high"]) / 2) - 1).cast("int").alias("high"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda s: s["low"])


def compare_texts(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Equality, lengths, lines, the common beginning and end of two texts, and what stands where they first differ.

    The common end never reaches into the common beginning.
    """
    from foliary.functions.text import count_lines, excerpt, normalise_spaces

    shorter = F.least(F.length(a), F.length(b))
    out = rows.select(
        "*", (a == b).alias("exact"), (normalise_spaces(a) == normalise_spaces(b)).alias("normalised"), F.length(a).alias("length_a"), F.length(b).alias("length_b"),
        count_lines(a).alias("lines_a"), count_lines(b).alias("lines_b"), _common(a, b, shorter).alias("common_prefix"),
    )
    prefix = F.col("common_prefix")
    differs = lambda x: F.when(~F.col("exact"), excerpt(x, prefix))
    return out.select("*", _common(F.reverse(a), F.reverse(b), shorter - prefix).alias("common_suffix"), differs(a).alias("excerpt_a"), differs(b).alias("excerpt_b"))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))
