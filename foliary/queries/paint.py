"""Display items, table fragments and tags in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import paint
from foliary.plans.catalog import query
from foliary.session import table

_STYLE = "['none','single','dotted','dashed','double'][p_size % 5 + 1]"


@query(
    "border_paint",
    f"""
    WITH e AS (SELECT p_partkey, {_STYLE} AS style, (p_size % 30 + 1)::BIGINT AS width FROM part), d AS (SELECT *, (ceil(greatest(width, 20) / 20.0) * 20)::BIGINT AS dots FROM e)
    SELECT p_partkey, 0::BIGINT AS "offset", width AS line_width, []::BIGINT[] AS dash FROM d WHERE style = 'single'
    UNION ALL SELECT p_partkey, 0, dots, [1, greatest(20, dots * 2 - 1)] FROM d WHERE style = 'dotted'
    UNION ALL SELECT p_partkey, 0, width, [width * 4, width * 2] FROM d WHERE style = 'dashed'
    UNION ALL SELECT p_partkey, -width, width, [] FROM d WHERE style = 'double' UNION ALL SELECT p_partkey, width, width, [] FROM d WHERE style = 'double'
    """,
)
def border_paint(spark, sf_dir):
    names = F.array(*map(F.lit, ("none", "single", "dotted", "dashed", "double")))
    edges = table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, F.col("p_size") % 5 + 1).alias("style"), (F.col("p_size") % 30 + 1).cast("long").alias("width"))
    return paint.border_lines(edges).select("p_partkey", "offset", "line_width", "dash")


@query("paint_layers", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 ELSE 1 END, ts) - 1)::INT AS z FROM events")
def paint_layers(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "rectangle").when(F.col("event_type") == "click", "line").otherwise("glyph-run")
    return paint.layered(table(spark, sf_dir, "events").withColumn("type", kind), ["user_id"], ["ts"]).select("event_id", "z")


@query(
    "merge_runs",
    """
    WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
    SELECT user_id, min(event_id) AS first, event_type, string_agg(event_id::VARCHAR, '' ORDER BY event_id) AS text, count(*) AS width FROM r GROUP BY user_id, run, event_type
    """,
)
def merge_runs(spark, sf_dir):
    clusters = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("text"), F.lit(1).alias("width"))
    return paint.merge_runs(clusters, ["user_id"], "event_id", ["event_type"]).select("user_id", "first", "event_type", "text", "width")


@query("page_fields_filled", "SELECT conv_id, turn, 'Page ' || (turn + 1) || ' of ' || (max(turn) OVER (PARTITION BY conv_id) + 1) AS text FROM conversations")
def page_fields_filled(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("page"), F.lit("Page {page} of {pages}").alias("text"))
    return paint.fill_page_fields(items, "conv_id").select("conv_id", "turn", "text")


@query("header_stamps", "SELECT conv_id, turn AS page, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'first' ELSE 'every' END AS text FROM conversations")
def header_stamps(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    docs = talks.select("conv_id").distinct()
    usual = docs.select("conv_id", F.lit("header").alias("place"), F.lit("default").alias("variant"), F.lit("every").alias("text"))
    opening = docs.where("conv_id % 2 = 0").select("conv_id", F.lit("header").alias("place"), F.lit("first").alias("variant"), F.lit("first").alias("text"))
    return paint.stamp(talks.select("conv_id", F.col("turn").alias("page")), usual.unionByName(opening), ["conv_id"]).select("conv_id", "page", "text")


@query("page_geometry_gate", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'pdf/page-geometry-invalid' END AS code FROM part")
def page_geometry_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 10).alias("width"), F.lit(100).alias("height"))
    good, bad = paint.valid_pages(pages)
    return good.select("p_partkey", F.lit(None).cast("string").alias("code")).unionByName(bad.select("p_partkey", "code"))


@query("numbering_references", "SELECT c_custkey, CASE WHEN c_nationkey >= 20 THEN 'layout/numbering-definition-missing' WHEN c_custkey % 4 = 3 THEN 'layout/numbering-level-missing' WHEN c_custkey % 4 = 2 THEN 'layout/numbering-level-duplicate' END AS code, CASE WHEN c_nationkey < 20 AND c_custkey % 4 < 2 THEN '%' || (c_custkey % 4 + 1) END AS text FROM customer")
def numbering_references(spark, sf_dir):
    levels = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("num_id"), F.explode(F.array(*map(F.lit, (0, 1, 2, 2)))).alias("level"))
    levels = levels.withColumn("text", F.concat(F.lit("%"), (F.col("level") + 1).cast("string")))
    paragraphs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("num_id"), (F.col("c_custkey") % 4).cast("int").alias("level"))
    return paint.numbering_reference(paragraphs, levels).select("c_custkey", "code", "text")


@query("table_fragments", "SELECT l_orderkey AS doc_id, ((row_number() OVER w - 1) // 3)::INT AS page, (row_number() OVER w - 1)::INT AS row_no, ((row_number() OVER w - 1) % 3 * 300)::BIGINT AS top FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def table_fragments(spark, sf_dir):
    row = F.struct(F.lit(300).alias("height"), F.lit(100).alias("step"), F.lit(False).alias("header"), F.lit(True).alias("cant_split"))
    tables = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(row).alias("rows"))
    return paint.paginate_tables(tables, 1000).select("doc_id", "page", "row_no", "top")


@query("upload_states", "WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS c, min(ts) FILTER (event_type = 'view') AS r, min(ts) FILTER (event_type = 'purchase') AS u FROM events GROUP BY 1) SELECT user_id, CASE WHEN c IS NULL THEN 'unknown' WHEN r > c + INTERVAL 65 MINUTE THEN 'expired' WHEN r IS NULL THEN 'awaiting' WHEN u >= r THEN 'consumed' ELSE 'registered' END AS state FROM f")
def upload_states(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "registered").when(F.col("event_type") == "purchase", "consumed")
    return paint.upload_states(table(spark, sf_dir, "events").withColumn("kind", kind), "user_id", "ts", "kind")


@query("lenient_tags", "SELECT p_partkey, ['name | upper', 'unknown'] AS tags, p_name || ' {{unknown}} {{' AS filled FROM part")
def lenient_tags(spark, sf_dir):
    text = F.lit("{{name | upper}} {{unknown}} {{")
    return table(spark, sf_dir, "part").select("p_partkey", paint.find_placeholders(text).alias("tags"), paint.fill_placeholders(text, {"name": F.col("p_name")}).alias("filled"))


@query("set_path", "SELECT o_orderkey, o_orderstatus AS kept, 'changed' AS status FROM orders")
def set_path(spark, sf_dir):
    from foliary.functions.nested import set_path as put

    data = F.struct(F.struct(F.col("o_orderpriority").alias("status"), F.col("o_orderstatus").alias("kept")).alias("order"))
    return table(spark, sf_dir, "orders").select("o_orderkey", put(data, "order.status", F.lit("changed")).alias("d")).select("o_orderkey", "d.order.kept", "d.order.status")
