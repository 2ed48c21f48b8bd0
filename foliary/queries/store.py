"""The artifact store: content, cache, states, lifetimes; batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import store
from foliary.plans.catalog import query
from foliary.session import table


@query("content_dedupe", "SELECT sha256(text) AS digest, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(spark, sf_dir):
    return store.dedupe_content(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("recent_renders", "SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC LIMIT 20")
def recent_renders(spark, sf_dir):
    return store.recent(table(spark, sf_dir, "events"), F.col("user_id") == 7, [F.col("ts").desc()], 20).select("event_id", "ts")


@query("cursor_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 50")
def cursor_page(spark, sf_dir):
    return store.page_after(table(spark, sf_dir, "orders"), "o_orderkey", 9000, 50).select("o_orderkey", "o_orderstatus")


@query("latest_by_hash", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC) AS n FROM events) SELECT user_id, props, event_id FROM r WHERE n = 1 AND event_type <> 'error'")
def latest_by_hash(spark, sf_dir):
    return store.latest_by(table(spark, sf_dir, "events"), ["user_id", "props"], [F.col("ts").desc()], F.col("event_type") == "error").select("user_id", "props", "event_id")


@query(
    "cache_lookup",
    """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE event_type IN ('purchase', 'view')),
    b AS (SELECT user_id, arg_max(event_id, ts) AS found FROM a WHERE n <= 8 AND event_type = 'purchase' GROUP BY 1)
    SELECT u.user_id, found FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b USING (user_id)
    """,
)
def cache_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    artifacts = events.where(F.col("event_type").isin("purchase", "view")).select("user_id", "ts", "event_type", F.col("event_id").alias("found"))
    return store.cached(events.select("user_id").distinct(), artifacts, ["user_id"], [F.col("ts").desc()], F.col("event_type") == "purchase").select("user_id", "found")


_STATES = {"signup": "queued", "view": "rendering", "purchase": "completed", "error": "failed", "click": "cancelled"}


@query(
    "state_fold",
    """
    WITH s AS (SELECT user_id, value > 50 AS part, ts, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'rendering' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS state FROM events)
    SELECT user_id, part, coalesce(arg_min(state, ts) FILTER (state IN ('completed', 'failed', 'cancelled')), arg_max(state, ts) FILTER (state IN ('queued', 'rendering'))) AS state FROM s GROUP BY 1, 2
    """,
)
def state_fold(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pair in _STATES.items() for x in pair))
    events = table(spark, sf_dir, "events").select("user_id", (F.col("value") > 50).alias("part"), "ts", "event_id", names[F.col("event_type")].alias("state"))
    return store.fold_states(events, ["user_id", "part"], ["ts", "event_id"], "state")


@query("ttl_sweep", "SELECT event_id FROM events WHERE event_type = 'signup' AND ts + INTERVAL 65 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def ttl_sweep(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    return store.expired(events.where("event_type = 'signup'").crossJoin(F.broadcast(now)), "ts", F.col("now")).select("event_id")


@query("consume_once", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1 AS granted FROM events")
def consume_once(spark, sf_dir):
    return store.consume_once(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts"]).select("event_id", "granted")


@query("merge_metadata", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 AND c_acctbal >= 0 THEN 'renamed' ELSE c_name END AS name FROM customer")
def merge_metadata(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("session"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("deleting"))
    updates = current.where("id % 5 = 0").select("id", "session", F.lit("renamed").alias("name"))
    return store.merge_metadata(current, updates, "id", "session").select("id", "name")


@query("cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf_dir):
    removed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.cascade_delete(table(spark, sf_dir, "orders"), removed, "o_custkey").select("o_orderkey")


@query("begin_render_guard", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND o_totalprice > l_extendedprice")
def begin_render_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").where("o_totalprice > l_extendedprice").select("l_orderkey", "l_partkey", "l_suppkey")


@query("unique_keys", "WITH b AS (SELECT p_partkey, lower(p_brand) AS base FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b) SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS key FROM r")
def unique_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("base"))
    return store.unique_keys(rows, "base", ["p_partkey"]).select("p_partkey", "key")


@query("metadata_bounds", "SELECT event_id, strlen(props) <= 262144 AS small, true AS parses FROM events")
def metadata_bounds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.octet_length("props") <= 256 * 1024).alias("small"), F.try_parse_json("props").isNotNull().alias("parses"))


@query("summary_bounds", "SELECT user_id, count(*) <= 100000 AND count(DISTINCT event_type) <= 64 AS accepted FROM events GROUP BY 1")
def summary_bounds(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(((F.count("*") <= 100_000) & (F.count_distinct("event_type") <= 64)).alias("accepted"))


_EXECUTABLE = ("bat", "chm", "class", "cmd", "com", "dll", "exe", "hta", "jar", "js", "jse", "lnk", "msi", "msp", "ps1", "reg", "scr", "sh", "vbe", "vbs", "wsf", "wsh")


@query("active_content_classify", "SELECT page_id, CASE WHEN contains(lower(url), '/embeddings/') THEN 'ole' WHEN regexp_extract(lower(url), '([^.]*)$', 1) IN ('" + "','".join(_EXECUTABLE) + "') THEN 'executable' END AS kind FROM pages")
def active_content_classify(spark, sf_dir):
    from foliary.sources.packages import classify_path

    return table(spark, sf_dir, "pages").select("page_id", classify_path(F.col("url")).alias("kind"))


@query("stream_latest_wins", "SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def stream_latest_wins(spark, sf_dir):
    from foliary.streaming.state import latest_wins

    return latest_wins(spark, f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type")


@query("stream_ttl_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_ttl_windows(spark, sf_dir):
    from foliary.streaming.state import hourly_counts

    return hourly_counts(spark, f"{sf_dir}/events.parquet")


@query("stream_reactive_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_reactive_counts(spark, sf_dir):
    from foliary.streaming.state import reactive_counts

    return reactive_counts(spark, f"{sf_dir}/events.parquet")


@query("stream_first_of_key", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_first_of_key(spark, sf_dir):
    from foliary.streaming.state import first_of_key

    return first_of_key(spark, f"{sf_dir}/events.parquet")


@query("revision_freshness", "SELECT event_id, ts = max(ts) OVER (PARTITION BY user_id) AS current FROM events")
def revision_freshness(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.groupBy("user_id").agg(F.max("ts").alias("newest"))
    return events.join(newest, "user_id").select("event_id", (F.col("ts") == F.col("newest")).alias("current"))
