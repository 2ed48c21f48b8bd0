"""Tables rendered over records, and templates' guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.plans import tables
from foliary.plans.catalog import query
from foliary.plans.tables import Cell, Row
from foliary.queries.render import orders_with_items
from foliary.session import table


def _row(*texts: str, header: bool = False) -> Row:
    return Row([Cell([t]) for t in texts], header)


INVOICE_TABLE = [
    _row("Item", "Quantity", "Price", header=True),
    _row("{{#each items}}", "", ""),
    _row("{{name | upper}}", "{{quantity:number}}", '{{price:number | currency:"USD"}}'),
    _row("", "{{/each}}", ""),
    _row("{{#if large}}"),
    _row("Large order", "", "{{o_orderpriority | lower}}"),
    _row("{{else}}"),
    _row("Order", "", "{{o_orderkey}}"),
    _row("{{/if}}"),
]


@query(
    "render_table_rows",
    """
    WITH li AS (
      SELECT l_orderkey, upper(p_name) AS name, l_extendedprice AS price, l_quantity AS quantity,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, l_extendedprice, l_quantity) AS i
      FROM lineitem JOIN part ON l_partkey = p_partkey
    ), n AS (SELECT l_orderkey, count(*) AS n FROM li GROUP BY 1)
    SELECT o_orderkey, 0 AS ord, 'r0' AS id, 'Item|Quantity|Price' AS cells FROM orders
    UNION ALL
    SELECT l_orderkey, i::INT, 'r2~each-' || (i - 1), name || '|' || quantity::BIGINT || '|' || '$' || format('{:,.2f}', price) FROM li
    UNION ALL
    SELECT o_orderkey, (coalesce(n, 0) + 1)::INT, CASE WHEN o_totalprice > 200000 THEN 'r5' ELSE 'r7' END,
           CASE WHEN o_totalprice > 200000 THEN 'Large order||' || lower(o_orderpriority) ELSE 'Order||' || o_orderkey END
    FROM orders LEFT JOIN n ON o_orderkey = l_orderkey
    """,
)
def render_table_rows(spark, sf_dir):
    records = orders_with_items(spark, sf_dir).withColumn("large", F.col("o_totalprice") > 200_000)
    rows = tables.render_table(tables.compile_table(INVOICE_TABLE), records, ["o_orderkey"])
    return rows.select("o_orderkey", "ord", "id", F.array_join("cells", "|").alias("cells"))


@query("table_row_errors", "SELECT event_id, 'r1~each-0' AS id, 'TEMPLATE_VALUE_TYPE' AS error, 'error' AS severity FROM events WHERE event_type NOT IN ('click', 'view')")
def table_row_errors(spark, sf_dir):
    target = F.when(F.col("event_type").isin("click", "view"), F.col("event_type"))
    records = table(spark, sf_dir, "events").select("event_id", F.array(F.struct(target.alias("target"))).alias("items"))
    compiled = tables.compile_table([_row("{{#each items}}"), _row("fixed", "{{target | upper}}"), _row("{{/each}}")])
    return tables.render_table(compiled, records, ["event_id"]).where("error IS NOT NULL").select("event_id", "id", "error", "severity")


def _case(n: int) -> list[Row]:
    """A small table whose faults are the bits of ``n``."""
    body = Row([Cell(["{{name}}"], merge="restart" if n & 2 else None)], header=bool(n & 1))
    rows = [_row("{{#each items}}"), body, _row("{{/each}}")]
    rows += [_row("{{#if open}}", "more")] if n & 4 else []
    return rows + ([_row("{{#if open}}")] if n & 8 else [])


@query(
    "table_block_problems",
    """
    SELECT p_partkey, code, row_no FROM part, (VALUES (1, 'TEMPLATE_TABLE_LOOP_HEADER', 0), (2, 'TEMPLATE_TABLE_LOOP_VERTICAL_MERGE', 2), (4, 'TEMPLATE_TABLE_ROW_MARKER_CONTENT', 3), (8, 'TEMPLATE_UNCLOSED_TABLE_BLOCK', -1)) t(bit, code, spot),
      LATERAL (SELECT CASE WHEN spot >= 0 THEN spot WHEN p_size % 8 >= 4 THEN 4 ELSE 3 END AS row_no) WHERE (p_size % 16) & bit <> 0
    """,
)
def table_block_problems(spark, sf_dir):
    """Parts stand for templates, whose number of faults is bounded: each kind is compiled once."""
    found = [(n, p.code, p.paragraph) for n in range(16) for p in tables.compile_table(_case(n)).problems]
    cases = spark.createDataFrame(found, "n int, code string, row_no int")
    return table(spark, sf_dir, "part").withColumn("n", F.col("p_size").cast("int") % 16).join(F.broadcast(cases), "n").select("p_partkey", "code", "row_no")


@query(
    "table_manifest",
    "SELECT * FROM (VALUES ('items', 'array', 1, ''), ('items[].name', 'string', 2, 'upper'), ('items[].price', 'number', 2, 'currency'), ('items[].quantity', 'number', 2, ''), ('large', 'boolean', 4, ''), ('o_orderkey', 'unknown', 7, ''), ('o_orderpriority', 'string', 5, 'lower')) t(path, kind, row_no, formatters)",
)
def table_manifest(spark, sf_dir):
    fields = tables.compile_table(INVOICE_TABLE).fields
    return spark.createDataFrame([(f.path, f.kind, f.paragraphs[0], ",".join(f.formatters)) for f in fields], "path string, kind string, row_no int, formatters string")


@query("block_scopes", "WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'table' ELSE 'paragraph' END AS kind FROM conversations) SELECT conv_id, turn, CASE WHEN kind = 'paragraph' THEN (count(*) FILTER (kind = 'table') OVER (PARTITION BY conv_id ORDER BY turn))::INT END AS scope FROM b")
def block_scopes(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "table").otherwise("paragraph").alias("kind"))
    return tables.block_scopes(blocks, "conv_id", "turn", "kind").select("conv_id", "turn", "scope")
