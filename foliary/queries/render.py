"""Templates rendered over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.plans.catalog import query
from foliary.plans.codegen import render
from foliary.plans.template import compile_template
from foliary.session import table

INVOICE = [
    'Invoice {{o_orderkey}} of {{o_orderdate | date:"dd MMMM yyyy"}}',
    "{{#each items}}",
    '{{name | upper}}: {{price:number | currency:"ZAR"}}',
    "{{/each}}",
    'Total {{o_totalprice:number | currency:"USD"}}',
]


def orders_with_items(spark, sf_dir):
    """Orders with the array of their lines, in order; an order without lines has an empty one."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    items = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    items = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "name", "price", "quantity"))).alias("items"))
    return table(spark, sf_dir, "orders").join(items, "o_orderkey", "left")


@query(
    "render_invoice_lines",
    """
    WITH li AS (
      SELECT l_orderkey, upper(p_name) AS name, l_extendedprice AS price,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, l_extendedprice, l_quantity) AS i
      FROM lineitem JOIN part ON l_partkey = p_partkey
    ), n AS (SELECT l_orderkey, count(*) AS n FROM li GROUP BY 1)
    SELECT o_orderkey, 0 AS ord, 'p0' AS id, 'Invoice ' || o_orderkey || ' of ' || strftime(o_orderdate, '%d %B %Y') AS text FROM orders
    UNION ALL
    SELECT l_orderkey, i::INT, 'p2~each-' || (i - 1), name || ': R' || chr(160) || translate(format('{:,.2f}', price), ',.', chr(160) || ',') FROM li
    UNION ALL
    SELECT o_orderkey, (coalesce(n, 0) + 1)::INT, 'p4', 'Total ' || CASE WHEN o_totalprice < 0 THEN '-' ELSE '' END || 'US$' || chr(160) || translate(format('{:,.2f}', abs(o_totalprice)), ',.', chr(160) || ',')
    FROM orders LEFT JOIN n ON o_orderkey = l_orderkey
    """,
)
def render_invoice_lines(spark, sf_dir):
    lines = render(compile_template(INVOICE), orders_with_items(spark, sf_dir), ["o_orderkey"], locale="en-ZA")
    return lines.select("o_orderkey", "ord", "id", "text")


@query(
    "render_if_else_blocks",
    """
    SELECT o_orderkey, 0 AS ord, CASE WHEN o_orderstatus = 'F' THEN 'p1' ELSE 'p3' END AS id,
           CASE WHEN o_orderstatus = 'F' THEN 'Order ' || o_orderkey || ' is settled.' ELSE 'Order ' || o_orderkey || ' is open (' || lower(o_orderstatus) || ').' END AS text
    FROM orders
    """,
)
def render_if_else_blocks(spark, sf_dir):
    template = ["{{#if settled}}", "Order {{o_orderkey}} is settled.", "{{else}}", "Order {{o_orderkey}} is open ({{o_orderstatus | lower}}).", "{{/if}}"]
    records = table(spark, sf_dir, "orders").withColumn("settled", F.col("o_orderstatus") == "F")
    return render(compile_template(template), records, ["o_orderkey"]).select("o_orderkey", "ord", "id", "text")


@query(
    "render_nested_each",
    """
    WITH o AS (
      SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders
    ), l AS (
      SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey) - 1 AS j FROM lineitem
    )
    SELECT o_custkey AS c_custkey, 'p1~each-' || i AS id, 'Order ' || o_orderkey AS text FROM o
    UNION ALL
    SELECT o_custkey, 'p3~each-' || i || '-' || j, 'Quantity ' || l_quantity::BIGINT FROM o JOIN l ON o_orderkey = l_orderkey
    """,
)
def render_nested_each(spark, sf_dir):
    template = ["{{#each orders}}", "Order {{key}}", "{{#each items}}", "Quantity {{quantity}}", "{{/each}}", "{{/each}}"]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("quantity"), "l_extendedprice", "l_partkey", "l_suppkey"))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    nested = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), "items"))).alias("orders"))
    return render(compile_template(template), nested, ["c_custkey"]).select("c_custkey", "id", "text")


@query(
    "render_permissive_missing",
    """
    SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') || '/' AS text, 'TEMPLATE_VALUE_MISSING' AS error, 'warning' AS severity FROM events
    """,
)
def render_permissive_missing(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("data", F.from_json("props", "k long"))
    lines = render(compile_template(["{{data.k:number}}/{{data.absent}}"]), events, ["event_id"], permissive=True)
    return lines.select("event_id", "text", "error", "severity")


@query(
    "render_strict_errors",
    """
    SELECT event_id, 'p0' AS id, 'TEMPLATE_VALUE_TYPE' AS error, 'error' AS severity FROM events WHERE event_type NOT IN ('click', 'view')
    """,
)
def render_strict_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("target", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")))
    return render(compile_template(["{{target | upper}}"]), events, ["event_id"]).where("error is not null").select("event_id", "id", "error", "severity")


@query(
    "expansion_budget",
    """
    WITH b AS (
      SELECT source, doc_id, (sum(1) OVER w)::BIGINT AS nodes, (sum(strlen(text)) OVER w)::BIGINT AS bytes
      FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)
    )
    SELECT source, doc_id, nodes, bytes, CASE WHEN nodes > 40 THEN 'TEMPLATE_EXPANDED_NODE_LIMIT' WHEN bytes > 60000 THEN 'TEMPLATE_EXPANDED_TEXT_LIMIT' END AS error FROM b
    """,
)
def expansion_budget(spark, sf_dir):
    from foliary.operators.ordered import budget

    return budget(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), ["source"], ["doc_id"], F.col("text"), nodes=40, text_bytes=60_000).select("source", "doc_id", "nodes", "bytes", "error")


_TAGS = [
    (1, "Dear {{customer.name | upper}},"),
    (2, "{{#each items}}"),
    (3, '{{sku}} at {{price | currency:"USD"}}'),
    (4, "{{/each}}"),
    (5, 'Due {{due | date:"dd/MM/yyyy"}} {{customer.name}} {{total:number}}'),
    (6, "{{total:string}} {{customer}}"),
]


@query(
    "tag_manifest",
    """
    SELECT * FROM (VALUES ('customer', 'unknown', 1, ''), ('customer.name', 'string', 2, 'upper'), ('due', 'date', 1, 'date'), ('items', 'array', 1, ''),
      ('items[].price', 'number', 1, 'currency'), ('items[].sku', 'unknown', 1, ''), ('total', 'unknown', 2, '')) t(path, kind, sources, formatters)
    """,
)
def tag_manifest(spark, sf_dir):
    fields = compile_template([text for _, text in _TAGS]).fields
    return spark.createDataFrame([(f.path, f.kind, len(f.paragraphs), ",".join(f.formatters)) for f in fields], "path string, kind string, sources int, formatters string")


@query("template_problems", "SELECT * FROM (VALUES (5, 'TEMPLATE_TYPE_CONFLICT'), (4, 'TEMPLATE_TYPE_CONFLICT')) t(paragraph, code) WHERE paragraph = 4")
def template_problems(spark, sf_dir):
    problems = compile_template([text for _, text in _TAGS]).problems
    return spark.createDataFrame([(p.paragraph, p.code) for p in problems], "paragraph int, code string")
