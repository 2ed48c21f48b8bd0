"""URL filter: path rules first, link-graph propagation for the rest.

A rule is a host and a path prefix. It fits its host and all subdomains where
the url's path starts with the rule's; the longest fitting rule (host and path
together, then the longer host, then a block) decides.

Pages no rule decides take their host's verdict. Hosts are the nodes of the
link graph, an edge being the number of pages of one host that link to another.
Personalised PageRank spreads trust forward from the pages that allow rules
decided, and distrust backward (along reversed edges) from the pages that block
rules decided. Both are divided by the host's pages, so that a host whose pages
are all blocked has distrust 1. A host is blocked if its distrust is at least
``threshold`` and above its trust.

Pages meet their host's rules, and then its scores, in joins that end in a written
table, so Spark deals a host with a third of all pages over as many tasks as its
pages ask for. Every step of the propagation is a join or an aggregation by host;
the ranks are written to the shared folder every ``CUT_EVERY`` steps, and
iteration stops when they change by less than ``tolerance`` in all. Nothing is
collected but that sum.

Edge cases: a url that is null or has no ``://`` has an empty host and path; an
empty host takes part in no links; a null html has no links; repeated rows count
as pages each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import shared

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DAMPING = 0.85
CUT_EVERY = 4
THRESHOLD = 0.5
TOLERANCE = 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules that fit a host, the one that wins first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = hosts.where(F.col("host") != "").select("host", F.explode(suffixes).alias("rule_host"))
    order = F.struct((-F.length("rule_host") - F.length("rule_path")).alias("size"), (-F.length("rule_host")).alias("host_size"), (F.col("rule_verdict") != "block").alias("soft"), "rule_host", "rule_path", "rule_verdict")
    return own.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("rules"))


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: pages of one host that link to another one."""
    href = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    absolute = F.filter(href, lambda x: x.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))
    hosts = F.array_distinct(F.transform(absolute, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))))
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """host, rank: personalised PageRank of ``edges`` (src, dst, weight) from ``seeds`` (host, seed).

    Ranks are in units of the seeds' own: without edges a seed keeps its value.
    ``steps`` None iterates until a step changes the ranks by less than ``tolerance``.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    edges = shared.materialise(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")))
    ranks = shared.materialise(seeds.select("host", F.col("seed").cast("double").alias("rank")))
    if edges.isEmpty():
        return ranks
    seed = ranks
    if steps is None:
        # a step's change is at most the mass still moving, twice the seeds' times damping ** step
        mass = 2 * (seed.agg(F.sum("rank")).first()[0] or 0.0)
        steps = max(1, math.ceil(math.log(tolerance / max(mass, tolerance)) / math.log(damping)) + 1)
    for step in range(1, steps + 1):
        flow = ranks.join(edges, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("rank"))
        new = flow.unionByName(seed).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % CUT_EVERY == 0 or step == steps:
            new = shared.materialise(new)
            old = ranks.withColumnRenamed("rank", "old")
            change = new.join(old, "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("x")).first()["x"] or 0.0
            if change < tolerance:
                return new
        ranks = new
    return ranks


def classify(pages: DataFrame, rules: DataFrame, threshold: float = THRESHOLD, damping: float = DAMPING, steps: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of pages (page_id, url, html)."""
    pages = pages.select("page_id", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    # tables by host are written, so that their sizes are known before pages are dealt out to meet them
    by_host = shared.materialise(rules_by_host(pages.select("host").distinct(), rules))

    def first_fit(rules_column, path):
        fits = F.filter(rules_column, lambda r: path.startswith(r["rule_path"]))
        return F.when(F.size(fits) > 0, F.element_at(fits, 1))

    ruled = pages.select("page_id", "host", "path").join(by_host, "host", "left").withColumn("hit", first_fit(F.col("rules"), F.col("path")))
    ruled = shared.materialise(ruled.select("page_id", "host", "path", F.concat("hit.rule_host", "hit.rule_path").alias("rule"), F.col("hit.rule_verdict").alias("by_rule")))
    # pages, and pages that rules decided, of each host
    hosts = shared.materialise(ruled.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")))
    edges = shared.materialise(link_edges(pages))
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagate(edges, hosts.where("allowed > 0").select("host", F.col("allowed").alias("seed")), damping, steps).withColumnRenamed("rank", "trust")
    distrust = propagate(backward, hosts.where("blocked > 0").select("host", F.col("blocked").alias("seed")), damping, steps).withColumnRenamed("rank", "distrust")
    scores = shared.materialise(hosts.join(trust, "host", "left").join(distrust, "host", "left").select("host", *((F.coalesce(c, F.lit(0.0)) / F.col("pages")).alias(c) for c in ("trust", "distrust"))))
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, rule_verdict string")
    return classify(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
