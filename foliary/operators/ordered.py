"""Running-state operators: windows, and folds where a window can't say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys, order):
    return _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys, order):
    return _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def budget(rows: DataFrame, keys: list[str], order: list, text: Column, nodes: int, text_bytes: int) -> DataFrame:
    """Running numbers of nodes and of text bytes, and the limit that each row is over; nodes are checked first."""
    w = running(keys, order)
    out = rows.withColumn("nodes", F.count("*").over(w)).withColumn("bytes", F.sum(F.octet_length(text)).over(w))
    return out.withColumn("error", F.when(F.col("nodes") > nodes, "TEMPLATE_EXPANDED_NODE_LIMIT").when(F.col("bytes") > text_bytes, "TEMPLATE_EXPANDED_TEXT_LIMIT"))


def prefix_tops(rows: DataFrame, keys: list[str], order: list, height: Column) -> DataFrame:
    """``top``: the heights of all rows before."""
    return rows.withColumn("top", F.coalesce(F.sum(height).over(before(keys, order)), F.lit(0)))


def cumulative_rounding(rows: DataFrame, keys: list[str], order: list, value: Column) -> DataFrame:
    """``advance``: rounded running total less the rounded one before, so that errors don't add up."""
    total = lambda w: F.floor(F.coalesce(F.sum(value).over(w), F.lit(0)) + 0.5).cast("long")
    return rows.withColumn("advance", total(running(keys, order)) - total(before(keys, order)))


def share_remainder(rows: DataFrame, keys: list[str], order: list, total: Column) -> DataFrame:
    """``part``: an equal share of the group's total, the first rows taking one more each until it is used up."""
    whole = Window.partitionBy(*keys)
    n, place = F.count("*").over(whole), F.row_number().over(_window(keys, order))
    return rows.withColumn("part", (F.floor(total / n) + (place <= total % n).cast("int")).cast("long"))


def largest_remainder(rows: DataFrame, keys: list[str], order: list, value: Column) -> DataFrame:
    """``rounded``: floors that add up to the rounded total, the largest fractions taking one more (ties: the first)."""
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("__floor", F.floor(value).cast("long")).withColumn("__rest", value - F.floor(value))
    short = F.floor(F.sum(value).over(whole) + 0.5).cast("long") - F.sum("__floor").over(whole)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__rest").desc(), *order))
    return rows.withColumn("rounded", F.col("__floor") + (place <= short).cast("int")).drop("__floor", "__rest")


def carry_forward(rows: DataFrame, keys: list[str], order: list, value: Column, name: str = "carried") -> DataFrame:
    """The last value that isn't null up to each row: inherited headers, owners of merged cells."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(running(keys, order)))


def islands(rows: DataFrame, keys: list[str], order: list, keep: Column) -> DataFrame:
    """``chain``: number of the run of rows that hang together; a run goes on while the row before keeps with its next."""
    starts = F.coalesce(~F.lag(keep).over(_window(keys, order)), F.lit(True)).cast("int")
    rows = rows.withColumn("__start", starts)
    return rows.withColumn("chain", F.sum("__start").over(running(keys, order))).drop("__start")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``first``: whether a row is the first of its group."""
    return rows.withColumn("first", F.row_number().over(_window(keys, order)) == 1)


def balance(rows: DataFrame, keys: list[str], order: list, step: Column) -> DataFrame:
    """``depth`` after each opening (+1) and closing (-1), and whether it went below zero by then."""
    rows = rows.withColumn("depth", F.sum(step).over(running(keys, order)))
    return rows.withColumn("unbalanced", F.min("depth").over(running(keys, order)) < 0)


def list_counters(rows: DataFrame, keys: list[str], order: list, level: Column, start: int = 1, levels: int = 3) -> DataFrame:
    """``counters``: the numbers of levels 0..level of a multi-level list; a level starts anew after any row above it.

    A level that a deeper row refers to before it had a row of its own has its start number.
    """
    rows = rows.withColumn("__level", level)
    names = []
    for k in range(levels):
        rows = rows.withColumn(f"__reset{k}", F.coalesce(F.sum((F.col("__level") < k).cast("int")).over(running(keys, order)), F.lit(0)))
        w = Window.partitionBy(*keys, f"__reset{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        own = F.sum((F.col("__level") == k).cast("int")).over(w)
        rows = rows.withColumn(f"__n{k}", F.greatest(own, F.lit(1)) + start - 1)
        names.append(f"__n{k}")
    rows = rows.withColumn("counters", F.slice(F.array(*names), 1, F.col("__level") + 1))
    return rows.drop("__level", *names, *(f"__reset{k}" for k in range(levels)))


def fits(rows: DataFrame, keys: list[str], order: list, height: Column, room: Column) -> DataFrame:
    """Rows that fit a box from its top: the longest prefix whose heights add up to no more than ``room``."""
    return rows.withColumn("__sum", F.sum(height).over(running(keys, order))).where(F.col("__sum") <= room).drop("__sum")


def char_offsets(rows: DataFrame, keys: list[str], order: list, length: Column) -> DataFrame:
    """``offset``: characters before each piece."""
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(before(keys, order)), F.lit(0)).cast("long"))
