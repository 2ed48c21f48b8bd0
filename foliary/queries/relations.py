"""Joins, set operations and recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import joins
from foliary.plans.catalog import query
from foliary.session import table


@query("tag_fill_left_join", "SELECT n_nationkey, CASE WHEN r_regionkey IS NULL THEN n_name ELSE r_name END AS text FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def tag_fill_left_join(spark, sf_dir):
    tags = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("slug"), F.col("n_name").alias("raw"))
    catalog = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("slug"), F.col("r_name").alias("value"))
    return joins.fill_tags(tags, catalog, "slug", "value", "raw").select("n_nationkey", "text")


@query("orphan_tags", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_tags(spark, sf_dir):
    slug = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    tags = table(spark, sf_dir, "documents").select("doc_id", F.concat(slug, F.lit(".text")).alias("slug"))
    fields = table(spark, sf_dir, "labels").select(slug.alias("slug"))
    return joins.orphans(tags, fields, "slug").select("doc_id")


@query("unused_questions", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unused_questions(spark, sf_dir):
    tags = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.unused(table(spark, sf_dir, "part").select("p_partkey"), tags, "p_partkey")


@query("kind_mismatch", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_name[1:1] <> c_mktsegment[1:1]")
def kind_mismatch(spark, sf_dir):
    fields = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("slug"), F.substring("n_name", 1, 1).alias("role"))
    tags = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("slug"), F.substring("c_mktsegment", 1, 1).alias("kind"))
    return joins.mismatched(fields, tags, "slug", "role", "kind").select("n_nationkey", "c_custkey")


def _styles(spark, sf_dir):
    """region <- nation <- supplier as a tree of styles."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("p").alias("type"), F.lit(None).cast("string").alias("based_on"), F.col("r_regionkey").alias("size"), F.lit("left").alias("align"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("p"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")), F.lit(None).cast("string"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("p"), F.concat(F.lit("n"), "s_nationkey"), F.lit(None).cast("int"), F.when(F.col("s_suppkey") % 3 == 0, "right"))
    return region.union(nation).union(supplier)


_STYLES = """styles AS (
  SELECT 'r' || r_regionkey AS id, NULL AS based_on, r_regionkey AS size, 'left' AS align FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, NULL FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, NULL, CASE WHEN s_suppkey % 3 = 0 THEN 'right' END FROM supplier
), chain AS (
  SELECT id, 0 AS depth, id AS ancestor, based_on AS up FROM styles
  UNION ALL SELECT chain.id, depth + 1, styles.id, styles.based_on FROM chain JOIN styles ON styles.id = chain.up
)"""


@query("style_chain", f"WITH RECURSIVE {_STYLES} SELECT id, depth, ancestor FROM chain")
def style_chain(spark, sf_dir):
    return joins.style_chains(_styles(spark, sf_dir).select("id", "type", "based_on")).select("id", "depth", "ancestor")


@query("style_cascade", f"WITH RECURSIVE {_STYLES} SELECT c.id, arg_min(s.size, depth) FILTER (s.size IS NOT NULL) AS size, arg_min(s.align, depth) FILTER (s.align IS NOT NULL) AS align FROM chain c JOIN styles s ON s.id = c.ancestor GROUP BY c.id")
def style_cascade(spark, sf_dir):
    styles = _styles(spark, sf_dir)
    properties = styles.select(F.col("id").alias("style_id"), "size", "align")
    return joins.cascade(joins.style_chains(styles.select("id", "type", "based_on")), properties, ["size", "align"])


@query("style_problems", "SELECT * FROM (VALUES ('a', 1, 'DOCX_MISSING_STYLE_PARENT'), ('b', 2, 'DOCX_STYLE_CYCLE'), ('c', 2, 'DOCX_STYLE_CYCLE'), ('d', 1, 'DOCX_STYLE_TYPE_MISMATCH')) t(id, depth, problem)")
def style_problems(spark, sf_dir):
    styles = spark.createDataFrame([("a", "p", "gone"), ("b", "p", "c"), ("c", "p", "b"), ("d", "p", "e"), ("e", "c", None)], "id string, type string, based_on string")
    return joins.style_chains(styles).where("problem is not null").select("id", "depth", "problem")


@query("flatten_choice_leaves", "SELECT n_nationkey::VARCHAR AS value, r_name || ' / ' || n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def flatten_choice_leaves(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("value"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit(None).cast("string"), "r_name")
    return joins.flatten_choices(nations.union(regions))


_WEIGHTS = "(100), (300), (400), (500), (700), (900)"


@query(
    "font_match_rank",
    f"""
    WITH faces AS (SELECT DISTINCT p_brand AS family, (p_size % 9 + 1) * 100 AS have FROM part), asked AS (SELECT DISTINCT p_brand AS family, w AS weight FROM part, (VALUES {_WEIGHTS}) t(w))
    SELECT family, weight, arg_min(have, CASE WHEN weight = 400 THEN list_position([400,500,300,200,100,600,700,800,900], have) WHEN weight = 500 THEN list_position([500,400,300,200,100,600,700,800,900], have)
      WHEN weight < 400 THEN CASE WHEN have <= weight THEN weight - have ELSE 1000 + have - weight END
      ELSE CASE WHEN have >= weight THEN have - weight ELSE 1000 + weight - have END END) AS matched
    FROM asked JOIN faces USING (family) GROUP BY 1, 2
    """,
)
def font_match_rank(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    faces = part.select(F.col("p_brand").alias("family"), ((F.col("p_size") % 9 + 1) * 100).alias("face_weight")).distinct()
    asked = part.select(F.col("p_brand").alias("family")).distinct().select("family", F.explode(F.array(*map(F.lit, (100, 300, 400, 500, 700, 900)))).alias("weight"))
    return joins.font_match(asked, faces)


@query("alias_chains", "SELECT * FROM (VALUES ('a', 'd'), ('b', 'd'), ('c', 'd'), ('x', NULL), ('y', NULL)) t(alias, target)")
def alias_chains(spark, sf_dir):
    return joins.resolve_aliases(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "alias string, target string"))


@query("merge_owner_asof", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS owner FROM events")
def merge_owner_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return joins.as_of(events, ["user_id"], ["ts"], F.col("event_type") == "purchase", F.col("event_id"), "owner").select("event_id", "owner")


@query("interval_join_ttl", "SELECT a.event_id AS intent, b.event_id AS file FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 65 MINUTE WHERE a.event_type = 'signup' AND b.event_type = 'view'")
def interval_join_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("intent"), F.col("ts").cast("timestamp").alias("start"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 65 MINUTES")).alias("end"))
    files = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("file"), F.col("ts").cast("timestamp").alias("at"))
    return joins.interval_join(files, spans, ["user_id"], "at", "start", "end", 65 * 60).select("intent", "file")


_TOPS = "SELECT *, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS top FROM lineitem"
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query("range_join_fragments", f"SELECT l_orderkey, l_partkey, top, (top // 50)::BIGINT AS fragment FROM ({_TOPS})")
def range_join_fragments(spark, sf_dir):
    from foliary.operators.ordered import prefix_tops

    lines = prefix_tops(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE_ORDER, F.col("l_quantity").cast("long")).select("l_orderkey", "l_partkey", "top")
    last = lines.groupBy("l_orderkey").agg(F.floor(F.max("top") / 50).alias("n"))
    fragments = last.select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("fragment")).select("l_orderkey", "fragment", (F.col("fragment") * 50).alias("start"), (F.col("fragment") * 50 + 50).alias("end"))
    return joins.fragments_of(lines, fragments, ["l_orderkey"], "top", "start", "end").select("l_orderkey", "l_partkey", "top", "fragment")


@query(
    "border_conflict_winner",
    """
    WITH e AS (SELECT l_orderkey, ['none','dotted','dashed','single','double'][l_linenumber % 5 + 1] AS style, (l_quantity % 4)::BIGINT AS width, l_partkey % 3 AS space, l_partkey AS ordinal FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY style <> 'none' DESC, width DESC, list_position(['none','dotted','dashed','single','double'], style) DESC, space DESC, ordinal) AS n FROM e)
    SELECT l_orderkey, style, width, space FROM b WHERE n = 1
    """,
)
def border_conflict_winner(spark, sf_dir):
    names = F.array(*map(F.lit, ("none", "dotted", "dashed", "single", "double")))
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", F.element_at(names, F.col("l_linenumber") % 5 + 1).alias("style"), (F.col("l_quantity") % 4).cast("long").alias("width"), (F.col("l_partkey") % 3).alias("space"), F.col("l_partkey").alias("ordinal"))
    return joins.border_winner(edges, ["l_orderkey"]).select("l_orderkey", "style", "width", "space")


@query("catalog_upsert", "SELECT coalesce(c.k, d.k) AS k, coalesce(c.v, d.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN (SELECT c_custkey AS k, 'DEFAULT' AS v FROM customer WHERE c_custkey % 3 = 0) d ON c.k = d.k")
def catalog_upsert(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return joins.upsert(customers.where("k % 2 = 0"), customers.where("k % 3 = 0").select("k", F.lit("DEFAULT").alias("v")), "k")


@query("style_name_union", "SELECT DISTINCT lower(p) AS path FROM (SELECT p_brand AS p FROM part UNION ALL SELECT c_mktsegment FROM customer)")
def style_name_union(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.lower("p_brand").alias("path")).union(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment"))).distinct()


@query("type_conflicts", "SELECT user_id, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def type_conflicts(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    return kinds.where(F.size("k") > 1).select("user_id", F.size("k").cast("long").alias("kinds"), F.array_join("k", ",").alias("names"))


@query("path_conflicts", "SELECT a.n_name || '' AS parent, b.child FROM (SELECT 'r' || n_regionkey AS p, n_name FROM nation) a JOIN (SELECT 'r' || n_regionkey AS p, 'r' || n_regionkey || '.' || n_name AS child FROM nation) b ON a.p = b.p")
def path_conflicts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    leaves = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("p"), F.col("n_name").alias("parent"))
    children = nation.select(F.concat(F.lit("r"), "n_regionkey", F.lit("."), "n_name").alias("child"))
    # a child's proper beginnings, as an equi-join instead of a comparison of all pairs
    below = children.select("child", F.split("child", r"\.").alias("s")).select("child", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.array_join(F.slice("s", 1, i), "."))).alias("p"))
    return leaves.join(below, "p").select("parent", "child")
