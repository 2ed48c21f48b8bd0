"""Ordered and running-state operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.functions import counters
from foliary.operators import ordered
from foliary.plans.catalog import query
from foliary.session import table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_W = f"PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_K = ", ".join(_KEYS)


@query("prefix_sum_tops", f"SELECT {_K}, coalesce(sum(l_quantity::BIGINT) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS top FROM lineitem")
def prefix_sum_tops(spark, sf_dir):
    return ordered.prefix_tops(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER, F.col("l_quantity").cast("long")).select(*_KEYS, "top")


@query("cumulative_rounding", f"SELECT {_K}, (floor(s / 100.0 + 0.5) - floor((s - c) / 100.0 + 0.5))::BIGINT AS advance FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS c, sum(round(l_extendedprice * 100)::BIGINT) OVER ({_W})::BIGINT AS s FROM lineitem)")
def cumulative_rounding(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    # whole cents, so that the running total is exact whatever the order of additions
    rows = table(spark, sf_dir, "lineitem").withColumn("cents", cents)
    total = lambda w: F.floor(F.coalesce(F.sum("cents").over(w), F.lit(0)) / 100 + 0.5).cast("long")
    return rows.withColumn("advance", total(ordered.running(["l_orderkey"], _ORDER)) - total(ordered.before(["l_orderkey"], _ORDER))).select(*_KEYS, "advance")


@query("cumulative_rounding_halves", f"SELECT {_K}, (floor(s / 2.0 + 0.5) - floor((s - q) / 2.0 + 0.5))::BIGINT AS advance FROM (SELECT *, l_quantity::BIGINT AS q, sum(l_quantity::BIGINT) OVER ({_W})::BIGINT AS s FROM lineitem)")
def cumulative_rounding_halves(spark, sf_dir):
    return ordered.cumulative_rounding(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER, F.col("l_quantity") / 2).select(*_KEYS, "advance")


@query("remainder_distribution", f"SELECT {_K}, (1000 // n + CASE WHEN i <= 1000 % n THEN 1 ELSE 0 END)::BIGINT AS part FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER ({_W}) AS i FROM lineitem)")
def remainder_distribution(spark, sf_dir):
    return ordered.share_remainder(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER, F.lit(1000)).select(*_KEYS, "part")


@query(
    "largest_remainder_grid",
    f"""
    WITH f AS (SELECT *, (l_quantity * 10 / 4.0) AS v FROM lineitem), g AS (SELECT *, floor(v)::BIGINT AS lo, v - floor(v) AS rest FROM f),
    h AS (SELECT *, floor(sum(v) OVER (PARTITION BY l_orderkey) + 0.5)::BIGINT - (sum(lo) OVER (PARTITION BY l_orderkey))::BIGINT AS short, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, {', '.join(_ORDER)}) AS i FROM g)
    SELECT {_K}, (lo + CASE WHEN i <= short THEN 1 ELSE 0 END)::BIGINT AS rounded FROM h
    """,
)
def largest_remainder_grid(spark, sf_dir):
    return ordered.largest_remainder(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER, F.col("l_quantity") * 10 / 4).select(*_KEYS, "rounded")


@query("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(spark, sf_dir):
    value = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return ordered.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts"], value).select("event_id", "carried")


@query("keep_chain_islands", "SELECT event_id, (sum(s) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS chain FROM (SELECT *, CASE WHEN coalesce(lag(event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts), false) THEN 0 ELSE 1 END AS s FROM events)")
def keep_chain_islands(spark, sf_dir):
    return ordered.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts"], F.col("event_type") == "view").select("event_id", "chain")


@query("first_page_variant", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM conversations")
def first_page_variant(spark, sf_dir):
    return ordered.first_of(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "first")


@query("marker_balance", "SELECT event_id, depth, min(depth) OVER (PARTITION BY user_id ORDER BY ts) < 0 AS unbalanced FROM (SELECT *, (sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS depth FROM events)")
def marker_balance(spark, sf_dir):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return ordered.balance(table(spark, sf_dir, "events"), ["user_id"], ["ts"], step).select("event_id", "depth", "unbalanced")


@query(
    "multilevel_labels",
    """
    WITH t AS (SELECT *, turn % 3 AS lv FROM conversations), r AS (
      SELECT *, coalesce(sum(CASE WHEN lv < 0 THEN 1 ELSE 0 END) OVER w, 0) AS r0, sum(CASE WHEN lv < 1 THEN 1 ELSE 0 END) OVER w AS r1, sum(CASE WHEN lv < 2 THEN 1 ELSE 0 END) OVER w AS r2 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ), n AS (
      SELECT *, greatest(sum(CASE WHEN lv = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, r0 ORDER BY turn), 1)::BIGINT AS n0, greatest(sum(CASE WHEN lv = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, r1 ORDER BY turn), 1)::BIGINT AS n1,
        greatest(sum(CASE WHEN lv = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, r2 ORDER BY turn), 1)::BIGINT AS n2 FROM r
    )
    SELECT conv_id, turn, CASE lv WHEN 0 THEN n0 || '.' WHEN 1 THEN n0 || '.' || n1 || ')' ELSE n0 || '.' || n1 || '.' || chr((96 + n2)::INT) END AS label FROM n
    """,
)
def multilevel_labels(spark, sf_dir):
    rows = ordered.list_counters(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("turn") % 3)
    number = [F.get("counters", F.lit(i)) for i in range(3)]
    plain = [F.when(n.isNotNull(), n.cast("string")) for n in number]
    level = F.size("counters") - 1
    template = F.element_at(F.array(F.lit("%1."), F.lit("%1.%2)"), F.lit("%1.%2.%3")), level + 1)
    return rows.select("conv_id", "turn", counters.level_text(template, [plain[0], plain[1], counters.letters(number[2])]).alias("label"))


@query("lines_that_fit", f"SELECT {_K} FROM (SELECT *, sum(l_quantity::BIGINT) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) WHERE s <= 60")
def lines_that_fit(spark, sf_dir):
    return ordered.fits(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER, F.col("l_quantity").cast("long"), F.lit(60)).select(*_KEYS)


_SPLIT = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents"


def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("char_offsets", f"SELECT doc_id, pos::INT AS pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ({_SPLIT})")
def char_offsets(spark, sf_dir):
    return ordered.char_offsets(document_lines(spark, sf_dir), ["doc_id"], ["pos"], F.length("line") + 1).select("doc_id", "pos", "offset")


@query("page_break_positions", f"SELECT doc_id, pos::INT AS pos FROM (SELECT *, lag(pos // 12) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM ({_SPLIT})) WHERE b <> pos // 12")
def page_break_positions(spark, sf_dir):
    page = F.floor(F.col("pos") / 12)
    from pyspark.sql import Window

    rows = document_lines(spark, sf_dir).withColumn("page", page)
    return rows.withColumn("b", F.lag("page").over(Window.partitionBy("doc_id").orderBy("pos"))).where("b <> page").select("doc_id", "pos")


@query("section_start_pages", "SELECT source, (coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_page FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def section_start_pages(spark, sf_dir):
    # one row per section: bounded by the number of sections, not of documents
    sections = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    return ordered.prefix_tops(sections, ["all"], ["source"], F.col("n")).select("source", F.col("top").alias("start_page"))
