"""Aggregates and comparison metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import compare
from foliary.plans.catalog import query
from foliary.session import table


@query("inspection_top_sources", "SELECT lang, count(*) AS times, list(doc_id ORDER BY doc_id)[1:20] AS sources FROM documents GROUP BY 1")
def inspection_top_sources(spark, sf_dir):
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    # the first twenty by a window limit, so that no group is ever collected whole
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 20").groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("sources"))
    return docs.groupBy("lang").agg(F.count("*").alias("times")).join(first, "lang")


@query("kind_histogram", "SELECT k AS event_type, (SELECT count(*) FROM events WHERE event_type = k) AS n, (SELECT count(*) FROM events WHERE event_type = k AND value > 50) AS warnings FROM (VALUES ('signup'), ('view'), ('click'), ('purchase'), ('error')) t(k)")
def kind_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("warnings"))


@query("severity_pivot", "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1")
def severity_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("upper_median", "SELECT o_custkey, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(compare.upper_median(F.collect_list("o_totalprice")).alias("median"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


def _pixels(spark, sf_dir):
    """Line items as pixels of two images of integer values."""
    xy = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("x"), (F.col("l_suppkey") % 40).alias("y"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").alias("n"))
    grid = lambda odd: xy.where(f"n % 2 = {odd}").groupBy("x", "y").agg(F.max("q").alias("value"))
    return grid(0), grid(1)


_GRID = "g AS (SELECT l_partkey % 60 AS x, l_suppkey % 40 AS y, l_linenumber % 2 AS odd, max(l_quantity::BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3), a AS (SELECT x, y, value FROM g WHERE odd = 0), b AS (SELECT x, y, value FROM g WHERE odd = 1)"


@query("mae_rmse", f"WITH {_GRID}, d AS (SELECT abs(coalesce(a.value, 255) - coalesce(b.value, 255)) AS d FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y) SELECT round(avg(d), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, max(d)::BIGINT AS max_delta, count(*) FILTER (d > 0) AS changed, count(*) FILTER (d > 10) AS over, count(*) AS pixels FROM d")
def mae_rmse(spark, sf_dir):
    a, b = _pixels(spark, sf_dir)
    return compare.raster_errors(a, b, ["x", "y"], "value", 10).withColumns({c: F.round(c, 6) for c in ("mae", "rmse")})


@query("weighted_centroid", f"WITH {_GRID} SELECT count(*) FILTER (value > 20) AS count, round(count(*) FILTER (value > 20) / count(*), 6) AS ratio, round(sum(value * x) FILTER (value > 20) / sum(value) FILTER (value > 20), 6) AS cx, round(sum(value * y) FILTER (value > 20) / sum(value) FILTER (value > 20), 6) AS cy, min(x) FILTER (value > 20) AS \"left\", max(x) FILTER (value > 20) AS \"right\", min(y) FILTER (value > 20) AS top, max(y) FILTER (value > 20) AS bottom FROM a")
def weighted_centroid(spark, sf_dir):
    a, _ = _pixels(spark, sf_dir)
    out = compare.ink(a.withColumn("weight", F.col("value")), F.col("value") > 20)
    return out.withColumns({c: F.round(c, 6) for c in ("ratio", "cx", "cy")})


@query("confusion_f1", "SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn FROM labels)")
def confusion_f1(spark, sf_dir):
    scores = compare.edge_scores(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return scores.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("projection_l1", f"WITH {_GRID}, ha AS (SELECT x, sum(value) / (SELECT sum(value) FROM a) AS s FROM a GROUP BY 1), hb AS (SELECT x, sum(value) / (SELECT sum(value) FROM b) AS s FROM b GROUP BY 1) SELECT round(sum(abs(coalesce(ha.s, 0) - coalesce(hb.s, 0))) / 2, 9) AS distance FROM ha FULL JOIN hb ON ha.x = hb.x")
def projection_l1(spark, sf_dir):
    a, b = (g.withColumnRenamed("value", "weight") for g in _pixels(spark, sf_dir))
    return compare.projection_distance(a, b, "x").select(F.round("distance", 9).alias("distance"))


@query("tile_hotspots", f"WITH {_GRID}, t AS (SELECT x // 8 AS tx, y // 8 AS ty, sum(value)::BIGINT AS error, count(*) AS pixels FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY error DESC, pixels DESC, ty, tx) AS rank FROM t) SELECT rank::INT AS rank, tx, ty, error, pixels FROM r WHERE rank <= 10")
def tile_hotspots(spark, sf_dir):
    a, _ = _pixels(spark, sf_dir)
    return compare.hotspots(a.withColumnRenamed("value", "error"), 8, 10)


@query("argmin_offset", f"WITH {_GRID}, s AS (SELECT dx, dy FROM range(-2, 3) p(dx), range(-2, 3) q(dy)), c AS (SELECT dx, dy, sum(abs(a.value - b.value)) / count(*) AS cost FROM b, s, a WHERE a.x = b.x + dx AND a.y = b.y + dy GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY cost, abs(dx) + abs(dy), dy, dx) AS n FROM c) SELECT dx::INT AS dx, dy::INT AS dy, round(cost, 9) AS cost FROM r WHERE n = 1")
def argmin_offset(spark, sf_dir):
    a, b = _pixels(spark, sf_dir)
    return compare.best_offset(a, b, 2).withColumn("cost", F.round("cost", 9))


@query(
    "text_compare_prefix",
    """
    WITH t AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 UNION ALL SELECT doc_id, text, text || ' end' FROM documents UNION ALL SELECT doc_id, text, text FROM documents),
    s AS (SELECT *, least(length(x), length(y)) AS n, string_split(x, '') AS a, string_split(y, '') AS b FROM t),
    p AS (SELECT *, coalesce(nullif(list_position(list_transform(list_zip(a[1:n], b[1:n]), lambda c: c[1] <> c[2]), true), 0) - 1, n) AS pre FROM s),
    q AS (SELECT *, list_zip(list_reverse(a)[1:n - pre], list_reverse(b)[1:n - pre]) AS back FROM p)
    SELECT doc_id, x = y AS exact, length(x)::INT AS length_a, length(y)::INT AS length_b, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, chr(10))) END::INT AS lines_a, CASE WHEN y = '' THEN 0 ELSE len(string_split(y, chr(10))) END::INT AS lines_b,
           pre::INT AS common_prefix, coalesce(nullif(list_position(list_transform(back, lambda c: c[1] <> c[2]), true), 0) - 1, n - pre)::INT AS common_suffix,
           CASE WHEN x <> y THEN substr(x, greatest(pre - 40, 0) + 1, pre + 80 - greatest(pre - 40, 0)) END AS excerpt_a, CASE WHEN x <> y THEN substr(y, greatest(pre - 40, 0) + 1, pre + 80 - greatest(pre - 40, 0)) END AS excerpt_b
    FROM q
    """,
)
def text_compare_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    pairs = docs.join(after, "doc_id").unionByName(docs.withColumn("other", F.concat("text", F.lit(" end")))).unionByName(docs.withColumn("other", F.col("text")))
    return compare.compare_texts(pairs, F.col("text"), F.col("other")).drop("text", "other", "normalised")


@query("table_bounds_per_page", "SELECT l_linenumber AS page, min(l_partkey) AS \"left\", max(l_partkey) AS \"right\", min(l_suppkey) AS top, max(l_suppkey) AS bottom FROM lineitem GROUP BY 1")
def table_bounds_per_page(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("left"), F.max("l_partkey").alias("right"), F.min("l_suppkey").alias("top"), F.max("l_suppkey").alias("bottom"))


@query("diagnostic_codes_by_node", "WITH f AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY t) AS codes FROM f GROUP BY 1")
def diagnostic_codes_by_node(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("t", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("codes"))


@query("pages_per_section", "SELECT source, count(*) AS pages, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def pages_per_section(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.octet_length("text")).alias("bytes"))


@query("highest_error_page", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS worst FROM orders GROUP BY 1")
def highest_error_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("worst"))
