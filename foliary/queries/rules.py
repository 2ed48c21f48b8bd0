"""Form rules over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.plans import rules
from foliary.plans.catalog import query
from foliary.plans.rules import Condition, Question, Rule
from foliary.session import table


def _orders_and_gaps(spark, sf_dir):
    """Orders joined to the customers of one segment, so that most answers are missing."""
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")


_GAPS = "(SELECT o.*, c.c_acctbal FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey)"


def _answers():
    return {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "balance": F.col("c_acctbal"), "total": F.col("o_totalprice")}


@query("condition_all", f"SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 100000 AS shown FROM {_GAPS}")
def condition_all(spark, sf_dir):
    condition = Condition((Rule("status", "eq", "F"), Rule("total", "gt", 100_000)))
    return _orders_and_gaps(spark, sf_dir).select("o_orderkey", rules.holds(condition, _answers()).alias("shown"))


@query("condition_any", f"SELECT o_orderkey, o_orderstatus IN ('P', 'O') OR c_acctbal IS NOT NULL AS shown FROM {_GAPS}")
def condition_any(spark, sf_dir):
    condition = Condition((Rule("status", "in", ("P", "O")), Rule("balance", "is_set")), match="any")
    return _orders_and_gaps(spark, sf_dir).select("o_orderkey", rules.holds(condition, _answers()).alias("shown"))


@query(
    "condition_null_semantics",
    f"""SELECT o_orderkey, false AS eq, true AS neq, false AS inside, true AS outside, coalesce(c_acctbal, 0) < 5 AS lt, coalesce(c_acctbal, 0) > 5 AS gt,
        c_acctbal IS NULL AS is_empty, true AS unknown, true AS none FROM {_GAPS}""",
)
def condition_null_semantics(spark, sf_dir):
    one = lambda op, value=None: rules.satisfied(Rule("balance", op, value), _answers())
    return _orders_and_gaps(spark, sf_dir).select("o_orderkey", one("eq", "x").alias("eq"), one("neq", "x").alias("neq"), one("in", ("x",)).alias("inside"), one("not_in", ("x",)).alias("outside"), one("lt", 5.0).alias("lt"), one("gt", 5.0).alias("gt"), one("is_empty").alias("is_empty"), one("between").alias("unknown"), rules.holds(Condition(), _answers()).alias("none"))


_FORM = [
    Question("status", "Status", "select", required=True, options=("O", "F")),
    Question("priority", "Priority", "short_text", min_length=6, max_length=9),
    Question("balance", "Balance", "number", required=True, low=0, high=9000, visible=Condition((Rule("status", "eq", "F"),))),
    Question("total", "Total", "number", high=150000),
]


@query("visible_fields", f"SELECT o_orderkey, f AS field FROM {_GAPS}, (VALUES ('status'), ('priority'), ('balance'), ('total')) t(f) WHERE f <> 'balance' OR o_orderstatus = 'F'")
def visible_fields(spark, sf_dir):
    return rules.visible_fields(_orders_and_gaps(spark, sf_dir), ["o_orderkey"], _FORM, _answers())


@query("strip_hidden", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN c_acctbal END AS balance, o_totalprice AS total FROM {_GAPS}")
def strip_hidden(spark, sf_dir):
    kept = rules.strip_hidden(_FORM, _answers())
    return _orders_and_gaps(spark, sf_dir).select("o_orderkey", kept["balance"].alias("balance"), kept["total"].alias("total"))


@query(
    "validate_records",
    f"""
    WITH g AS (SELECT * FROM {_GAPS})
    SELECT o_orderkey, 'status' AS field, 'Status has an invalid option' AS message FROM g WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT o_orderkey, 'priority', CASE WHEN length(o_orderpriority) > 9 THEN 'Priority must be at most 9 characters' ELSE 'Priority must be at least 6 characters' END FROM g WHERE length(o_orderpriority) > 9 OR length(o_orderpriority) < 6
    UNION ALL SELECT o_orderkey, 'balance', CASE WHEN c_acctbal IS NULL THEN 'Balance is required' WHEN c_acctbal > 9000 THEN 'Balance must be at most 9000' ELSE 'Balance must be at least 0' END FROM g WHERE o_orderstatus = 'F' AND (c_acctbal IS NULL OR c_acctbal > 9000 OR c_acctbal < 0)
    UNION ALL SELECT o_orderkey, 'total', 'Total must be at most 150000' FROM g WHERE o_totalprice > 150000
    """,
)
def validate_records(spark, sf_dir):
    return rules.validate(_orders_and_gaps(spark, sf_dir), ["o_orderkey"], _FORM, _answers())


@query("default_resolution", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS amount, CASE WHEN event_type = 'signup' THEN '2026-01-31' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def default_resolution(spark, sf_dir):
    number = rules.default_for(Question("amount", "Amount", "number"), "0", "2026-01-31")
    day = rules.default_for(Question("day", "Day", "date"), "today", "2026-01-31")
    events = table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "purchase", F.col("value"))
    given = F.when(F.col("event_type") != "signup", F.date_format("ts", "yyyy-MM-dd"))
    return events.select("event_id", F.coalesce(amount, F.lit(number)).alias("amount"), F.coalesce(given, F.lit(day)).alias("day"))


@query("answers_to_data", "SELECT o_orderkey, '{\"order\":{\"status\":\"' || o_orderstatus || '\",\"open\":' || (o_orderstatus = 'O')::VARCHAR || '},\"note\":\"\"}' AS data FROM orders")
def answers_to_data(spark, sf_dir):
    note = F.coalesce(F.lit(None).cast("string"), F.lit(""))
    data = F.struct(F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "O").alias("open")).alias("order"), note.alias("note"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(data).alias("data"))


@query("split_other_values", "SELECT o_orderkey, [o_orderstatus] AS known, [o_orderpriority] AS free FROM orders")
def split_other_values(spark, sf_dir):
    values, options = F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit("O"), F.lit("F"), F.lit("P"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.filter(values, lambda v: F.array_contains(options, v)).alias("known"), F.array_except(values, options).alias("free"))


@query("tags_from_form", "SELECT p_partkey, t.slug, t.role FROM part, LATERAL (SELECT lower(p_brand[1:5]) || '_' || p_size AS slug, 'value' AS role UNION ALL SELECT lower(p_brand[1:5]) || '_' || p_size || '.name', 'reference' WHERE p_size % 2 = 0) t")
def tags_from_form(spark, sf_dir):
    slug = F.concat(F.lower(F.substring("p_brand", 1, 5)), F.lit("_"), F.col("p_size").cast("string"))
    tags = F.array(F.struct(slug.alias("slug"), F.lit("value").alias("role")), F.when(F.col("p_size") % 2 == 0, F.struct(F.concat(slug, F.lit(".name")).alias("slug"), F.lit("reference").alias("role"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("t")).select("p_partkey", "t.slug", "t.role")


@query("answer_texts", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS settled, o_orderstatus || ', ' || o_orderpriority AS listed, n || ' row(s)' AS rows FROM (SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_orderpriority) AS o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def answer_texts(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").join(counted, "o_orderkey", "left")
    return orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("settled"), F.array_join(F.array("o_orderstatus", "o_orderpriority"), ", ").alias("listed"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" row(s)")).alias("rows"))


@query("issue_prefix_filter", "SELECT DISTINCT o_orderpriority AS path FROM orders WHERE o_orderpriority = '1-URGENT' OR starts_with(o_orderpriority, '1-URGENT.') OR starts_with(o_orderpriority, '1-URGENT[')")
def issue_prefix_filter(spark, sf_dir):
    path, root = F.col("o_orderpriority"), "1-URGENT"
    return table(spark, sf_dir, "orders").where((path == root) | path.startswith(f"{root}.") | path.startswith(f"{root}[")).select(path.alias("path")).distinct()
