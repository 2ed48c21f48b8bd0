"""Form trees, names and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.session import written


def tree_paths(nodes: DataFrame) -> DataFrame:
    """id, depth, path of a forest (id, parent, ordinal): ordinals from the root on; nodes that no root reaches are left out.

    A level a round, each one equi-join on the parent; a node stands once, so the rounds are the forest's depth.
    """
    level = nodes.where(F.col("parent").isNull()).select("id", F.lit(0).alias("depth"), F.array("ordinal").alias("path"))
    below = nodes.where(F.col("parent").isNotNull()).select(F.col("id").alias("c_id"), "parent", F.col("ordinal").alias("c_ordinal"))
    out = level
    while not level.isEmpty():
        level = level.join(below, F.col("id") == F.col("parent")).select(F.col("c_id").alias("id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("c_ordinal")).alias("path"))
        level = written(level)
        out = out.unionByName(level)
    return out


def placeholder_lookup(tags: DataFrame, definitions: DataFrame, raw: str) -> DataFrame:
    """Tags with the definition (slug, kind, ...) that their text names, by its slug or by its encoded form; unknown ones keep nulls."""
    from foliary.functions.nested import placeholder

    names = F.array_distinct(F.array(F.col("slug"), placeholder(F.col("slug"), F.col("kind"))))
    return tags.join(definitions.withColumn("__name", F.explode(names)), F.col(raw) == F.col("__name"), "left").drop("__name")


def locale_key(text: Column) -> Column:
    """A text under the root collation of Unicode: letters before case, lower before upper."""
    return F.collate(text, "UNICODE")


def chosen_text(items: Column) -> Column:
    """The choices of a list as text, or null without any."""
    return F.when(F.size(items) > 0, F.array_join(items, ", "))


def rows_text(rows: Column) -> Column:
    n = F.size(rows)
    return F.concat(n.cast("string"), F.when(n == 1, " row").otherwise(" rows"))


def merged_assets(dynamic: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Assets of both tables; where both have one, the record's own wins."""
    names = [c for c in static.columns if c != key]
    right = static.select(key, F.lit(True).alias("__static"), *(F.col(c).alias(f"__{c}") for c in names))
    both = dynamic.withColumn("__own", F.lit(True)).join(right, key, "full")
    return both.select(key, *(F.when(F.col("__own"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in names), F.coalesce("__own", F.lit(False)).alias("dynamic"))


def plan_images(images: DataFrame, content: str) -> DataFrame:
    """Images with ``digest`` and ``name`` of the asset that they share with equal ones; assets are numbered in the order of their digests."""
    from pyspark.sql import Window

    out = images.withColumn("digest", F.sha2(content, 256))
    assets = out.select("digest").distinct()
    # one row a distinct image; two levels, so that no task numbers them all
    w = Window.partitionBy("__shard").orderBy("digest")
    sharded = assets.withColumn("__shard", F.substring("digest", 1, 2))
    sizes = sharded.groupBy("__shard").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("__shard"), F.coalesce(F.sum("n").over(Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 256 rows at most
    named = sharded.withColumn("n", F.row_number().over(w)).join(before, "__shard").select("digest", F.concat(F.lit("Im"), (F.col("before") + F.col("n")).cast("string")).alias("name"))
    return out.join(named, "digest")


def image_value(mime: Column, content: Column, width: Column, height: Column, box_width: Column, box_height: Column, max_side: int = 100_000) -> Column:
    """struct<asset, width, height, error> of an image that a record gives: checked, then fitted into its box."""
    from foliary.functions.numbers import fit
    from foliary.sources.images import size_of, sniff

    size = size_of(content)
    error = (
        F.when(mime.isNull() | content.isNull() | ~F.coalesce(mime.isin("image/png", "image/jpeg"), F.lit(False)), "TEMPLATE_VALUE_TYPE")
        .when(~F.coalesce(sniff(content) == mime, F.lit(False)), "TEMPLATE_IMAGE_TYPE")
        .when(~F.coalesce((width > 0) & (height > 0) & (width <= max_side) & (height <= max_side), F.lit(False)), "TEMPLATE_IMAGE_SIZE")
        .when((size["width"] != width) | (size["height"] != height), "TEMPLATE_IMAGE_DIMENSIONS")
    )
    fitted = fit(box_width, box_height, width, height)
    fine = error.isNull()
    return F.struct(F.when(fine, F.sha2(content, 256)).alias("asset"), F.when(fine, fitted["width"]).alias("width"), F.when(fine, fitted["height"]).alias("height"), error.alias("error"))
