"""Joins and recursions of the document model."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.session import written


def fill_tags(tags: DataFrame, catalog: DataFrame, key: str, value: str, raw: str) -> DataFrame:
    """Tags with their catalog value; a tag that the catalog lacks keeps its raw text."""
    return tags.join(catalog.select(key, value), key, "left").withColumn("text", F.coalesce(value, raw))


def orphans(tags: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """Tags that no field answers, neither by name nor by their first path segment."""
    head = tags.withColumn("__head", F.substring_index(key, ".", 1))
    names = fields.select(F.col(key).alias("__name"))
    return head.join(names, head[key] == names["__name"], "left_anti").join(names, F.col("__head") == F.col("__name"), "left_anti").drop("__head")


def unused(fields: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Fields that no tag names."""
    return fields.join(tags.select(key), key, "left_anti")


def mismatched(fields: DataFrame, tags: DataFrame, key: str, role: str, kind: str) -> DataFrame:
    """Fields and tags of one name whose roles differ."""
    return fields.join(tags, key).where(F.col(role) != F.col(kind))


def style_chains(styles: DataFrame) -> DataFrame:
    """id, depth, ancestor, problem: a style's ancestors by ``based_on``, itself at depth 0.

    Each round is one equi-join; a chain meets no style twice, so the rounds end with
    the longest one. It ends with ``DOCX_MISSING_STYLE_PARENT``, ``DOCX_STYLE_TYPE_MISMATCH`` or
    ``DOCX_STYLE_CYCLE`` where it is at fault.
    """
    parents = styles.select(F.col("id").alias("p_id"), F.col("type").alias("p_type"), F.col("based_on").alias("p_next"))
    level = styles.select("id", F.lit(0).alias("depth"), F.col("id").alias("ancestor"), F.col("type"), F.col("based_on").alias("next"), F.array("id").alias("path"), F.lit(None).cast("string").alias("problem"))
    out = level
    for depth in itertools.count(1):
        level = level.where(F.col("next").isNotNull() & F.col("problem").isNull()).join(parents, F.col("next") == F.col("p_id"), "left")
        problem = F.when(F.col("p_id").isNull(), "DOCX_MISSING_STYLE_PARENT").when(F.array_contains("path", F.col("next")), "DOCX_STYLE_CYCLE").when(F.col("p_type") != F.col("type"), "DOCX_STYLE_TYPE_MISMATCH")
        level = level.select("id", F.lit(depth).alias("depth"), F.col("next").alias("ancestor"), "type", F.when(problem.isNull(), F.col("p_next")).alias("next"), F.array_append("path", F.col("next")).alias("path"), problem.alias("problem"))
        level = written(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("id", "depth", "ancestor", "problem")


def cascade(chains: DataFrame, properties: DataFrame, names: list[str]) -> DataFrame:
    """Each style's properties: the nearest ancestor that sets one wins."""
    rows = chains.where(F.col("problem").isNull()).join(properties, F.col("ancestor") == properties["style_id"], "left")
    nearest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    return rows.groupBy("id").agg(*map(nearest, names))


def as_of(events: DataFrame, keys: list[str], order: list, marker: Column, value: Column, name: str) -> DataFrame:
    """The value of the last marked row up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(F.when(marker, value), ignorenulls=True).over(w))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width_seconds: int) -> DataFrame:
    """Points inside spans of at most ``width_seconds``: an equi-join on time buckets, then the exact test.

    A span lies in one bucket or two; a bucket holds a bounded stretch of time,
    so neither side meets the whole of the other.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width_seconds)
    both = spans.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col(start)), bucket(F.col(end))))))
    return points.withColumn("__bucket", bucket(F.col(at))).join(both, [*keys, "__bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bucket")


def fragments_of(lines: DataFrame, fragments: DataFrame, keys: list[str], top: str, start: str, end: str) -> DataFrame:
    """Lines whose top lies in a fragment: the fragments of a key follow each other, so one sorted pass finds the last that starts before."""
    marks = fragments.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(*(c for c in fragments.columns if c not in keys)).alias("__fragment"))
    rows = lines.select(*keys, F.col(top).alias("__at"), F.lit(1).alias("__kind"), F.struct(*(c for c in lines.columns if c not in keys)).alias("__line"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__found", F.last("__fragment", ignorenulls=True).over(w)).where("__kind = 1")
    inside = both.where(F.col("__at") < F.col(f"__found.{end}"))
    return inside.select(*keys, "__line.*", *(F.col(f"__found.{c}").alias(c) for c in fragments.columns if c not in keys))


def border_winner(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The border that wins an edge: visible, then wider, then the heavier style, then more space, then the first."""
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in (("none", 0), ("dotted", 1), ("dashed", 2), ("single", 3), ("double", 4)) for x in pair)), F.col("style"))
    order = F.struct((F.col("style") != "none").alias("a"), F.col("width"), rank.alias("r"), F.col("space"), (-F.col("ordinal")).alias("o"))
    return edges.groupBy(*keys).agg(F.max_by(F.struct("style", "width", "space", "ordinal"), order).alias("w")).select(*keys, "w.*")


def font_match(requests: DataFrame, faces: DataFrame) -> DataFrame:
    """family, weight -> matched weight: the nearest by preference, for a request's family.

    400 and 500 try each other first; below 400 lighter ones first, above 500 heavier ones first.
    """
    want, have = F.col("weight"), F.col("face_weight")
    middle = F.when(want == 400, F.array(*map(F.lit, (400, 500, 300, 200, 100, 600, 700, 800, 900)))).when(want == 500, F.array(*map(F.lit, (500, 400, 300, 200, 100, 600, 700, 800, 900))))
    light = F.when(have <= want, want - have).otherwise(1000 + have - want)
    heavy = F.when(have >= want, have - want).otherwise(1000 + want - have)
    rank = F.when(middle.isNotNull(), F.array_position(middle, have)).when(want < 400, light).otherwise(heavy)
    return requests.join(faces, "family").groupBy(*requests.columns).agg(F.min_by("face_weight", rank).alias("matched"))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """alias -> target at the end of its chain; null where the chain runs in a circle."""
    step = aliases.select(F.col("alias").alias("s_from"), F.col("target").alias("s_to"))
    out = aliases.select("alias", "target", F.array("alias", "target").alias("path"), F.lit(False).alias("circle"))
    while True:  # a chain meets no alias twice
        out = out.join(step, F.col("target") == F.col("s_from"), "left")
        closes = F.col("s_to").isNotNull() & F.array_contains("path", F.coalesce("s_to", F.lit("")))
        moves = F.col("s_to").isNotNull() & ~F.col("circle") & ~closes
        out = out.select("alias", F.when(moves, F.col("s_to")).otherwise(F.col("target")).alias("target"), F.when(moves, F.array_append("path", F.col("s_to"))).otherwise(F.col("path")).alias("path"), (F.col("circle") | closes).alias("circle"), moves.alias("moved"))
        out = written(out)
        if out.where("moved").isEmpty():
            break
        out = out.drop("moved")
    return out.select("alias", F.when(~F.col("circle"), F.col("target")).alias("target"))


def upsert(current: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the current row's values win over the defaults."""
    names = [c for c in defaults.columns if c != key]
    right = defaults.select(key, *(F.col(c).alias(f"__{c}") for c in names))
    return current.join(right, key, "full").select(key, *(F.coalesce(c, f"__{c}").alias(c) for c in names))


def flatten_choices(nodes: DataFrame) -> DataFrame:
    """value, label of the leaves of a choice tree (value, parent, label); the label holds its ancestors.

    A value that is its own ancestor ends there.
    """
    level = nodes.where(F.col("parent").isNull()).select("value", "label", F.array("value").alias("path"))
    inner = nodes.select(F.col("parent").alias("value")).where(F.col("value").isNotNull()).distinct()
    out = None
    while True:
        leaves = level.join(inner, "value", "left_anti").select("value", "label")
        out = leaves if out is None else out.unionByName(leaves)
        below = nodes.select(F.col("value").alias("c_value"), F.col("parent").alias("c_parent"), F.col("label").alias("c_label"))
        level = level.join(below, F.col("value") == F.col("c_parent")).where(~F.array_contains("path", F.col("c_value")))
        level = level.select(F.col("c_value").alias("value"), F.concat_ws(" / ", "label", "c_label").alias("label"), F.array_append("path", F.col("c_value")).alias("path"))
        level = written(level)
        if level.isEmpty():
            return out
