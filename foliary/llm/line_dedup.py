"""Line dedup by a log-template tree, in DataFrame operations only.

A line is its tokens (runs of other characters than white space); tokens that
hold a digit become ``<*>``. The tree has a fixed depth: number of tokens, then
the ``LEAD`` first tokens. In a leaf, lines are ranked by their documents (ties:
the smaller first document, then place). A line joins the template of a
higher-ranked line that agrees with it in at least ``AGREE`` of the tokens after
the leading ones, compared one by one; the tokens that differ are the template's
variable fields. Lines that join none are templates of their own.

Lines meet their templates in buckets: a bucket is the lines of a leaf that
agree at the few places of one of ``BANDS`` bands. Every bucket proposes its
highest line to the others, so a leaf forms any number of templates at once, and
no two lines are compared but a line and a bucket's highest. A round settles the
lines that join a line that itself joins none. The rest, and the lines that
weren't like the highest of their buckets, go on with wider bands at other
places, until no bucket holds ``MIN_DOCS`` documents and two lines any more;
the buckets narrow from round to round, so this ends without a bound on the
number of rounds. A line is missed only if no band avoids its variable fields:
of lines at the limit (0.6) about 0.5 % in the first round, which has 2 places a
band; of those with a tenth of their tokens varying, one in 10^8.

A template of at least ``MIN_DOCS`` documents is recurring. Its lines are
dropped from every document but the first (smallest doc_id) that holds it.

A leaf with fewer than ``MIN_DOCS`` lines can't hold a recurring template, so
only the lines of larger leaves go through the tree. Hot lines, leaves and
buckets: counts are taken by map-side aggregation; the largest leaves, at most
``LARGE_LEAVES`` whatever the size of the corpus, are known to every task and
need no join; the joins of lines to buckets and templates end in other
exchanges or written tables, so Spark splits their hot keys at run time. Lines
travel as hashes (16 bits a token, 64 a line); texts are shuffled once, to meet
the numbers of the lines that they lose.

Edge cases: a null text counts as empty; a null doc_id as larger than every
other; rows with equal doc_id and text are one document in the counts and give
equal results; blank lines are never dropped; other columns are kept as they
are, but columns named ``n_lines`` or ``n_removed`` are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import shared

LEAD = 3
AGREE = 0.6
BANDS = 12
#: Places of a band in the first round; each round has half as many again.
WIDTH = 2
MIN_DOCS = 8
#: Leaves with more than this share of all lines are looked up instead of joined.
LARGE_LEAVES = 1_024
_LAST = (1 << 63) - 1


def _lines(docs: DataFrame, lead: int) -> DataFrame:
    """id, text_key, pos, leaf, line, tokens: every line that isn't blank; of the tokens those after the leading ones, as hashes."""
    lines = docs.select("id", "text_key", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    # one space for the white space between tokens; tokens with digits become <*>
    spaced = F.when(F.col("raw").rlike(r"[\t\x0B\f\r]|  "), F.regexp_replace("raw", r"[\t\x0B\f\r ]+", " ")).otherwise(F.col("raw"))
    lines = lines.select("id", "text_key", "pos", F.trim(spaced).alias("spaced")).where(F.col("spaced") != "")
    masked = F.when(F.col("spaced").rlike("[0-9]"), F.regexp_replace("spaced", r"[^ ]*[0-9][^ ]*", "<*>")).otherwise(F.col("spaced"))
    lines = lines.select("id", "text_key", "pos", masked.alias("masked")).withColumn("all", F.split("masked", " "))
    rest = F.slice("all", lead + 1, F.greatest(F.size("all") - lead, F.lit(0)))
    tokens = F.transform(rest, lambda t: F.shiftright(F.hash(t), 16).cast("short"))
    return lines.select("id", "text_key", "pos", F.xxhash64(F.size("all"), F.slice("all", 1, lead)).alias("leaf"), F.xxhash64("masked").alias("line"), tokens.alias("tokens"))


def _of_large_leaves(lines: DataFrame, min_docs: int) -> DataFrame:
    """The lines of leaves that hold at least ``min_docs`` lines."""
    leaves = shared.materialise(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs))
    total = leaves.agg(F.sum("n").alias("n")).first()["n"] or 0
    largest = F.col("n") > total / LARGE_LEAVES  # so there are fewer than LARGE_LEAVES of them
    named = [r.leaf for r in leaves.where(largest).select("leaf").collect()]
    if not named:
        return lines.join(leaves.select("leaf"), "leaf", "left_semi")
    found = F.col("leaf").isin(named)
    return lines.where(found).unionByName(lines.where(~found).join(leaves.where(~largest).select("leaf"), "leaf", "left_semi"))


def _bucket(width: int, band: Column) -> Column:
    """The bucket of a line in a band: its leaf and its tokens at ``width`` places that depend on band, width and length alone."""
    n = F.size("tokens")
    at = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.element_at("tokens", (F.pmod(F.xxhash64(F.lit(width), band, j, n), n) + 1).cast("int")))
    return F.xxhash64("leaf", band, F.lit(width), at)


def _templates(by_doc: DataFrame, agree: float, bands: int, min_docs: int) -> DataFrame:
    """leaf, line, template: of the distinct lines that join a template or that others join."""
    lines = by_doc.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min(F.struct("id", "text_key", "pos")).alias("first"), F.first("tokens").alias("tokens"))
    rank = F.struct("docs", (-F.col("first.id")).alias("a"), (-F.col("first.text_key")).alias("b"), (-F.col("first.pos")).alias("c"), "line").alias("rank")
    open_lines = shared.materialise(lines.where(F.size("tokens") > 0).select("leaf", "line", rank, "tokens"))
    width, settled = WIDTH, None
    while True:
        rows = open_lines.select("leaf", "line", "rank", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "tokens").select("leaf", "line", "rank", _bucket(width, F.col("band")).alias("bucket"))
        buckets = rows.groupBy("bucket").agg(F.sum("rank.docs").alias("docs"), F.count("*").alias("n"), F.max("rank").alias("seed")).where((F.col("n") > 1) & (F.col("docs") >= min_docs)).select("bucket", "seed")
        buckets = shared.materialise(buckets)  # else the join would share this count's exchange, and its hot keys couldn't be split
        meet = shared.materialise(rows.join(buckets, "bucket").select("leaf", "line", "seed").distinct())
        ours = open_lines.select("leaf", "line", "tokens")
        theirs = open_lines.select("leaf", F.col("line").alias("seed_line"), F.col("tokens").alias("seed_tokens"))
        pairs = meet.where(F.col("line") != F.col("seed.line")).withColumn("seed_line", F.col("seed.line")).join(ours, ["leaf", "line"]).join(theirs, ["leaf", "seed_line"])
        same = F.size(F.filter(F.zip_with("tokens", "seed_tokens", lambda a, b: a == b), lambda x: x))
        parents = shared.materialise(pairs.where(same >= F.size("tokens") * F.lit(agree)).groupBy("leaf", "line").agg(F.max("seed").alias("seed")).select("leaf", "line", F.col("seed.line").alias("template")))
        top = parents.select("leaf", "template").distinct().join(parents.select("leaf", F.col("line").alias("template")), ["leaf", "template"], "left_anti")
        found = parents.join(top, ["leaf", "template"], "left_semi").select("leaf", "line", "template").unionByName(top.select("leaf", F.col("template").alias("line"), "template"))
        found = shared.materialise(found)
        settled = found if settled is None else settled.unionByName(found)
        left = meet.select("leaf", "line").distinct().join(found, ["leaf", "line"], "left_anti")
        open_lines = shared.materialise(open_lines.join(left, ["leaf", "line"], "left_semi"))
        if open_lines.isEmpty():
            return settled
        width += (width + 1) // 2


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEAD, agree: float = AGREE, bands: int = BANDS) -> DataFrame:
    """All columns of ``docs``, each text without its recurring lines, and the numbers of lines before and of those dropped (``n_lines``, ``n_removed``)."""
    id_name, key_name, gone_name, raw_name = shared.free_names(docs, "id", "key", "gone", "raw")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    identity = {id_name: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), key_name: F.xxhash64(text)}
    lines = shared.materialise(_lines(docs.select(identity[id_name].alias("id"), text.alias("text"), identity[key_name].alias("text_key")), lead))
    by_doc = _of_large_leaves(lines, min_docs).groupBy("leaf", "line", "id", "text_key").agg(F.min("pos").alias("pos"), F.first("tokens").alias("tokens"), F.collect_set("pos").alias("at"))
    by_doc = shared.materialise(by_doc)
    templates = _templates(by_doc, agree, bands, min_docs)
    named = by_doc.select("leaf", "line", "id", "text_key", "at").join(templates, ["leaf", "line"], "left").withColumn("template", F.coalesce("template", "line"))
    one = shared.materialise(named.groupBy("leaf", "template", "id", "text_key").agg(F.flatten(F.collect_list("at")).alias("at")))
    recurring = one.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min(F.struct("id", "text_key")).alias("first")).where(F.col("docs") >= min_docs)
    dropped = one.join(recurring, ["leaf", "template"]).where((F.col("id") != F.col("first.id")) | (F.col("text_key") != F.col("first.text_key")))
    places = dropped.groupBy(F.col("id").alias(id_name), F.col("text_key").alias(key_name)).agg(F.flatten(F.collect_list("at")).alias(gone_name))
    joined = docs.withColumns(identity).join(places, [id_name, key_name], "left").withColumn(raw_name, F.split(text, "\n"))
    raw, gone = F.col(raw_name), F.coalesce(gone_name, F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), gone)
    kept = F.when(F.col(gone_name).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(raw, i + 1)), "\n"))
    n_lines = F.size(F.filter(raw, lambda x: x.rlike(r"[^ \t\x0B\f\r]"))).cast("long")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*(kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in names), n_lines.alias("n_lines"), F.size(gone).cast("long").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The tree in DuckDB: the lines of a leaf in the order of their ranks, one after the other, each joining the highest template that it agrees with.
ORACLE = f"""
WITH RECURSIVE keys AS (
  SELECT DISTINCT coalesce(doc_id, {_LAST}) AS id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT id, text, string_split(text, chr(10)) AS raw FROM keys
), exploded AS (
  SELECT id, text, generate_subscripts(raw, 1) - 1 AS pos, unnest(raw) AS raw FROM split
), masked AS (
  SELECT id, text, pos, regexp_replace(trim(regexp_replace(raw, '[\\t\\x0B\\f\\r ]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM exploded
), lines AS (
  SELECT id, text, pos, line, string_split(line, ' ') AS tokens FROM masked WHERE line <> ''
), placed AS (
  SELECT id, text, pos, line, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:{LEAD}], ' ') AS leaf, tokens[{LEAD + 1}:] AS rest FROM lines
), distinct_lines AS (
  SELECT leaf, line, any_value(rest) AS rest, count(DISTINCT (id, text)) AS docs, min(id) AS fid, arg_min(pos, (id, pos)) AS fpos FROM placed GROUP BY leaf, line
), crowded AS (
  SELECT leaf FROM distinct_lines GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCS}
), ranked AS MATERIALIZED (
  SELECT leaf, line, rest, row_number() OVER (PARTITION BY leaf ORDER BY docs DESC, fid, fpos) AS k FROM distinct_lines JOIN crowded USING (leaf)
), walk AS (
  SELECT leaf, k, line, line AS template, [struct_pack(line := line, rest := rest)] AS templates FROM ranked WHERE k = 1
  UNION ALL
  SELECT leaf, k, line, coalesce(found, line), CASE WHEN found IS NULL THEN list_append(templates, struct_pack(line := line, rest := rest)) ELSE templates END
  FROM (
    SELECT r.leaf, r.k, r.line, r.rest, w.templates,
           list_filter(w.templates, lambda t: len(r.rest) > 0 AND len(list_filter(range(1, len(r.rest) + 1), lambda i: t.rest[i] = r.rest[i])) >= len(r.rest) * {AGREE})[1].line AS found
    FROM walk w JOIN ranked r ON r.leaf = w.leaf AND r.k = w.k + 1
  )
), named AS (
  SELECT id, text, pos, leaf, coalesce(template, line) AS template FROM placed LEFT JOIN (SELECT leaf, line, template FROM walk) USING (leaf, line)
), recurring AS (
  SELECT leaf, template, min(id) AS first_id FROM named GROUP BY leaf, template HAVING count(DISTINCT (id, text)) >= {MIN_DOCS}
), gone AS (
  SELECT id, text, list(pos) AS gone FROM named JOIN recurring USING (leaf, template) WHERE id <> first_id GROUP BY id, text
)
SELECT d.doc_id, len(list_filter(raw, lambda x: trim(regexp_replace(x, '[\\t\\x0B\\f\\r ]+', ' ', 'g')) <> ''))::BIGINT AS n_lines,
       coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(raw, lambda x, i: NOT coalesce(list_contains(gone, i - 1), false)), chr(10))) AS kept_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id, {_LAST}) AS id, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents) d
LEFT JOIN gone USING (id, text)
"""
