"""Form trees, names, sets, assets, and small functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliary.functions import numbers, text
from foliary.operators import paint, trees
from foliary.plans.catalog import query
from foliary.session import table


@query(
    "tree_paths",
    """
    WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 10 THEN p_partkey // 10 END AS parent, p_partkey % 10 AS ordinal FROM part),
    w AS (SELECT id, 0 AS depth, ordinal::VARCHAR AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, depth + 1, path || '/' || n.ordinal FROM w JOIN n ON n.parent = w.id)
    SELECT * FROM w
    """,
)
def tree_paths(spark, sf_dir):
    key = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 10, F.floor(key / 10)).alias("parent"), (key % 10).alias("ordinal"))
    return trees.tree_paths(nodes).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("placeholder_lookup", "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN n_name END AS name FROM part JOIN nation ON n_nationkey = p_partkey % 25")
def placeholder_lookup(spark, sf_dir):
    from foliary.functions.nested import placeholder

    definitions = table(spark, sf_dir, "nation").select(F.concat(F.lit("field_"), F.col("n_nationkey").cast("string")).alias("slug"), F.lit("string").alias("kind"), F.col("n_name").alias("name"))
    slug = F.concat(F.lit("field_"), (F.col("p_partkey") % 25).cast("string"))
    by = F.col("p_size") % 3
    tags = table(spark, sf_dir, "part").select("p_partkey", F.when(by == 0, slug).when(by == 1, placeholder(slug, F.lit("string"))).otherwise("nothing").alias("raw"))
    return trees.placeholder_lookup(tags, definitions, "raw").select("p_partkey", "name")


@query("locale_sort", "WITH n AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY lower(name), name = upper(name), c_custkey))::INT AS place FROM n")
def locale_sort(spark, sf_dir):
    names = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    return names.select("c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(trees.locale_key(name), "c_custkey")).alias("place"))


@query("merged_assets", "SELECT coalesce(p_partkey, ps) AS id, coalesce(p_name, 'static ' || ps) AS content, p_partkey IS NOT NULL AS dynamic FROM (SELECT * FROM part WHERE p_size % 2 = 0) FULL JOIN (SELECT p_partkey AS ps FROM part WHERE p_size % 3 = 0) ON p_partkey = ps")
def merged_assets(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dynamic = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    static = part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("static "), F.col("p_partkey").cast("string")).alias("content"))
    return trees.merged_assets(dynamic, static, "id")


@query("image_plan", "WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents) SELECT doc_id, digest, 'Im' || dense_rank() OVER (ORDER BY digest) AS name FROM d")
def image_plan(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return trees.plan_images(images, "content").select("doc_id", "digest", "name")


@query(
    "dynamic_images",
    """
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'TEMPLATE_VALUE_TYPE' WHEN p_size % 5 = 0 THEN 'TEMPLATE_IMAGE_TYPE' WHEN p_size % 3 = 0 THEN 'TEMPLATE_IMAGE_DIMENSIONS' END AS error,
           CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 3 <> 0 THEN CASE WHEN 400 * 10 > 300 * p_size THEN greatest(1, floor(300 * p_size / 10.0 + 0.5)) ELSE 400 END::BIGINT END AS width,
           CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 3 <> 0 THEN CASE WHEN 400 * 10 > 300 * p_size THEN 300 ELSE greatest(1, floor(400 * 10 / p_size + 0.5)) END::BIGINT END AS height
    FROM part
    """,
)
def dynamic_images(spark, sf_dir):
    size = F.col("p_size")
    number = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    content = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(size), number(F.lit(10)))
    mime = F.when(size % 7 == 0, "image/gif").when(size % 5 == 0, "image/jpeg").otherwise("image/png")
    height = F.when((size % 3 == 0), 11).otherwise(10)
    found = trees.image_value(mime, content, size, height, F.lit(400), F.lit(300))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("i")).select("p_partkey", "i.error", "i.width", "i.height")


@query("row_counts_text", "SELECT o_orderkey, n || CASE WHEN n = 1 THEN ' row' ELSE ' rows' END AS rows, CASE WHEN n > 0 THEN flags END AS flags, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS settled FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag, ', ' ORDER BY l_linenumber, l_returnflag) AS flags FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def row_counts_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("l"))
    flags = F.transform("l", lambda x: x["l_returnflag"])
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", trees.rows_text(F.col("l")).alias("rows"), trees.chosen_text(flags).alias("flags"), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("settled"))


@query("path_errors", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'TEMPLATE_INVALID_EXPRESSION' WHEN 1 THEN 'TEMPLATE_UNSAFE_PATH' WHEN 2 THEN 'TEMPLATE_EXPRESSION_LIMIT' END AS error FROM part")
def path_errors(spark, sf_dir):
    kind = F.col("p_size") % 4
    path = F.when(kind == 0, F.concat(F.lit("a."), F.col("p_partkey").cast("string"))).when(kind == 1, "a.constructor.b").when(kind == 2, F.array_join(F.array_repeat(F.lit("a"), 33), ".")).otherwise(F.concat(F.lit("_a.b$"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", text.path_error(path).alias("error"))


@query("family_names", "SELECT p_partkey, lower(p_name) AS family FROM part")
def family_names(spark, sf_dir):
    spaced = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_family(spaced).alias("family"))


@query("excerpts", "SELECT doc_id, substr(text, greatest(length(text) // 2 - 40, 0) + 1, length(text) // 2 + 80 - greatest(length(text) // 2 - 40, 0)) AS excerpt FROM documents")
def excerpts(spark, sf_dir):
    at = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), at).alias("excerpt"))


@query("script_shifts", "SELECT p_partkey, -floor(p_size / 3 + 0.5)::BIGINT AS raised, floor(p_size / 6 + 0.5)::BIGINT AS lowered, floor(p_size * 2 / 3 + 0.5)::BIGINT AS size FROM part")
def script_shifts(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.script_shift(size, F.lit("superscript")).alias("raised"), numbers.script_shift(size, F.lit("subscript")).alias("lowered"), numbers.script_size(size).alias("size"))


@query("link_boxes", "SELECT doc_id, page_id AS page, url AS href FROM (SELECT page_id, page_id % 100 AS doc_id, url FROM pages) WHERE page_id % 3 = 0 AND url IS NOT NULL")
def link_boxes(spark, sf_dir):
    place = [F.lit(1).alias(c) for c in ("x", "y", "width", "height")]
    items = table(spark, sf_dir, "pages").select((F.col("page_id") % 100).alias("doc_id"), F.col("page_id").alias("page"), *place, F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("href"))
    return paint.link_boxes(items).select("doc_id", "page", "href")


@query("glyph_sets", "SELECT lang, list_sort(list_distinct(flatten(list(string_split(text, ''))))) AS chars FROM (SELECT lang, substr(text, 1, length(text)) AS text FROM documents) GROUP BY 1")
def glyph_sets(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    return chars.groupBy("lang").agg(F.array_sort(F.collect_list("c")).alias("chars"))


@query("allowed_choices", "SELECT user_id, len(list_filter(list_distinct(list(event_type)), lambda t: t NOT IN ('click', 'view', 'purchase'))) = 0 AS allowed, count(*) <> count(DISTINCT event_type) AS repeats FROM events GROUP BY 1")
def allowed_choices(spark, sf_dir):
    chosen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"), F.count("*").alias("n"))
    return chosen.select("user_id", (F.size(F.array_except("s", F.array(*map(F.lit, ("click", "view", "purchase"))))) == 0).alias("allowed"), (F.col("n") != F.size("s")).alias("repeats"))
