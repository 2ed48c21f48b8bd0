"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.functions import counters, dates, hashing, measure, numbers, text
from foliary.plans.catalog import query
from foliary.session import spread, table


@query("fmt_upper_lower", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part")
def fmt_upper_lower(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"))


_LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("fmt_currency_en_us", f"SELECT {_LINE_KEYS}, '$' || format('{{:,.2f}}', l_extendedprice) AS money FROM lineitem")
def fmt_currency_en_us(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", numbers.currency(F.col("l_extendedprice"), "USD", "en-US").alias("money"))


@query("fmt_currency_en_za", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || 'R' || chr(160) || translate(format('{:,.2f}', abs(s_acctbal)), ',.', chr(160) || ',') AS money FROM supplier")
def fmt_currency_en_za(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", numbers.currency(F.col("s_acctbal"), "ZAR", "en-ZA").alias("money"))


@query("fmt_currency_jpy", f"SELECT {_LINE_KEYS}, '¥' || format('{{:,}}', floor(l_extendedprice + 0.5)::BIGINT) AS money FROM lineitem")
def fmt_currency_jpy(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", numbers.currency(F.col("l_extendedprice"), "JPY", "en-US").alias("money"))


@query("fmt_currency_unlisted", "SELECT p_partkey, 'CHF' || chr(160) || format('{:,.2f}', p_retailprice) AS money, 'BHD' || chr(160) || format('{:,.3f}', p_retailprice) AS dinar FROM part")
def fmt_currency_unlisted(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.currency(price, "CHF", "en-US").alias("money"), numbers.currency(price, "BHD", "en-US").alias("dinar"))


@query("fmt_date_patterns", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS a, strftime(o_orderdate, '%-d %b %y') AS b, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c, strftime(o_orderdate, '%B %-d, %Y %-I:%M %p') AS d FROM orders")
def fmt_date_patterns(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    patterns = {"a": "dd/MM/yyyy", "b": "d MMM yy", "c": "yyyy-MM-dd HH:mm:ss", "d": "MMMM d, yyyy h:mm a"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(dates.format_instant(at, p, "UTC").alias(n) for n, p in patterns.items()))


@query("fmt_date_timezone", "SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS local_text FROM events")
def fmt_date_timezone(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.format_instant(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm", "Africa/Johannesburg").alias("local_text"))


@query("date_parse_iso", "SELECT event_id, ts AS instant, NULL::TIMESTAMP AS refused FROM events")
def date_parse_iso(spark, sf_dir):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events = table(spark, sf_dir, "events")
    return events.select("event_id", dates.parse_iso(F.concat(stamp, F.lit("Z"))).cast("timestamp_ntz").alias("instant"), dates.parse_iso(stamp).cast("timestamp_ntz").alias("refused"))


@query("date_completeness", "SELECT o_orderkey, true AS one, o_orderkey % 2 = 0 AS spanned, false AS timed FROM orders")
def date_completeness(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders")
    span = F.when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit("/"), day)).otherwise(F.concat(day, F.lit("/")))
    return orders.select("o_orderkey", dates.is_complete(day).alias("one"), dates.is_complete(span, date_range=True).alias("spanned"), dates.is_complete(day, include_time=True).alias("timed"))


@query("wall_clock_to_instant", "SELECT event_id, ts - INTERVAL 2 HOUR AS instant FROM events")
def wall_clock_to_instant(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.wall_to_instant(F.col("ts").cast("timestamp"), "Africa/Johannesburg").cast("timestamp_ntz").alias("instant"))


@query("js_number_text", f"SELECT {_LINE_KEYS}, regexp_replace(l_extendedprice::VARCHAR, '\\.0$', '') AS price, l_quantity::BIGINT::VARCHAR AS quantity, (l_quantity * 100000000)::BIGINT::VARCHAR AS large FROM lineitem")
def js_number_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", numbers.js_number(F.col("l_extendedprice")).alias("price"), numbers.js_number(F.col("l_quantity")).alias("quantity"), numbers.js_number(F.col("l_quantity") * 100_000_000).alias("large"))


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9$]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("slugify_keys", f"SELECT p_partkey, {_SLUG.format('p_name')} AS key, CASE WHEN {_SLUG.format('p_size::VARCHAR')} ~ '^[a-z_$]' THEN '' ELSE 'field_' END || {_SLUG.format('p_size::VARCHAR')} AS size_key FROM part")
def slugify_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("key"), text.slugify(F.col("p_size").cast("string")).alias("size_key"))


@query("option_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS option FROM part")
def option_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.option_slug(F.col("p_type"), F.col("p_partkey")).alias("option"))


@query("prettify_key", "SELECT c_custkey, list_aggregate(list_transform(list_filter(string_split_regex(lower(c_mktsegment) || '_account.name', '[._]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS label FROM customer")
def prettify_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.prettify(F.concat(F.lower("c_mktsegment"), F.lit("_account.name"))).alias("label"))


@query("key_validity", "SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z_$][A-Za-z0-9_$]*') AS valid, CASE WHEN regexp_full_match(p_brand, '[A-Za-z_$][A-Za-z0-9_$]*') THEN 'TEMPLATE_UNSAFE_PATH' ELSE 'TEMPLATE_INVALID_EXPRESSION' END AS problem FROM part")
def key_validity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.is_valid_key(F.col("p_brand")).alias("valid"), text.path_error(F.concat(F.col("p_brand"), F.lit(".constructor"))).alias("problem"))


@query("bullet_normalise", "SELECT conv_id, turn, regexp_replace('- ' || text, '(^|\\n)(\\s*)- ', '\\1\\2• ', 'g') AS text FROM conversations")
def bullet_normalise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.bullets(F.concat(F.lit("- "), F.col("text"))).alias("text"))


@query("text_normalise", "SELECT doc_id, sha256(trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.sha256(text.normalise_spaces(F.col("text"))).alias("digest"))


@query("tokenise_ranges", "SELECT doc_id, len(regexp_extract_all(text, '\\r\\n|\\r|\\n|[\\t ]+|[^\\r\\n\\t ]+'))::INT AS tokens, len(list_filter(regexp_extract_all(text, '\\r\\n|\\r|\\n|[\\t ]+|[^\\r\\n\\t ]+'), lambda x: x = chr(10)))::INT AS breaks FROM documents")
def tokenise_ranges(spark, sf_dir):
    found = text.tokens(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.size(found).alias("tokens"), F.size(F.filter(found, lambda t: t == "\n")).alias("breaks"))


@query("split_formatter_pipes", "SELECT p_partkey, [p_brand, 'currency:\"A|B\"', lower(p_type)] AS parts FROM part")
def split_formatter_pipes(spark, sf_dir):
    body = F.concat(F.col("p_brand"), F.lit(' | currency:"A|B" | '), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.split_pipes(body).alias("parts"))


_DROP = "regexp_replace({0}, '<{1}\\b[^>]*(?:/>|>.*?</{1}\\s*>)', '', 'gis')"


def _sanitise_sql() -> str:
    out = "regexp_replace(regexp_replace(html, '^\\x{FEFF}', ''), '<!(?:DOCTYPE|ENTITY).*?>', '', 'gis')"
    for name in ("script", "foreignobject", "handler", "animate", "animatetransform", "animatemotion", "set", "audio", "video", "iframe", "object", "embed"):
        out = _DROP.format(out, name)
    out = f"regexp_replace({out}, '\\s(?:[oO][nN][a-zA-Z]+)\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s>]+)', '', 'g')"
    for q, e in (('"', '"'), ("''", "''")):
        out = f"regexp_replace({out}, '\\s(?:xlink:)?href\\s*=\\s*{q}\\s*(?:javascript:|data:text/html|https?:|//|file:)[^{q}]*{q}', ' href={e}{e}', 'gi')"
    return out


@query("html_sanitise", f"SELECT page_id, sha256({_sanitise_sql()}) AS digest FROM pages")
def html_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashing.sha256(text.sanitise_markup(F.col("html"))).alias("digest"))


@query("xml_escape", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS digest FROM pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashing.sha256(text.escape_xml(F.col("html"))).alias("digest"))


@query("text_find", "SELECT doc_id, (instr(text, 'the ') - 1)::INT AS first_at, (len(string_split(text, 'the ')) - 1)::INT AS times FROM documents")
def text_find(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.instr("text", "the ") - 1).alias("first_at"), F.size(text.find_all(F.col("text"), "the ")).alias("times"))


@query("line_and_column", "SELECT doc_id, (len(string_split(substr(text, 1, 400), chr(10))))::INT AS line, (len(list_extract(string_split(substr(text, 1, 400), chr(10)), -1)) + 1)::INT AS col, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS lines, substr(text, 361, 120) AS excerpt FROM documents")
def line_and_column(spark, sf_dir):
    at = F.lit(400)
    return table(spark, sf_dir, "documents").select("doc_id", text.line_at(F.col("text"), at).alias("line"), text.column_at(F.col("text"), at).alias("col"), text.count_lines(F.col("text")).alias("lines"), text.excerpt(F.col("text"), at).alias("excerpt"))


def _width_sql(column: str, size: int = 1000) -> str:
    terms, seen = [], ""
    for chars, units in measure.class_widths(size):
        quoted = chars.replace("'", "''")
        terms.append(f"{units} * (length({column}) - length(translate({column}, '{quoted}', '')))")
        seen += quoted
    return f"({' + '.join(terms)} + {int(measure.OTHER * size / 1000 + 0.5)} * length(translate({column}, '{seen}', '')))::BIGINT"


@query("standard_width", f"SELECT p_partkey, {_width_sql('p_name')} AS units, {_width_sql('p_name', 240)} AS twips FROM part")
def standard_width(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", measure.width(F.col("p_name")).alias("units"), measure.width(F.col("p_name"), 240).alias("twips"))


@query("standard_width_documents", f"SELECT doc_id, {_width_sql('text', 220)} AS twips FROM documents")
def standard_width_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", measure.width(F.col("text"), 220).alias("twips"))


@query("unit_conversions", "SELECT p_partkey, floor(p_retailprice * 20 + 0.5)::BIGINT AS twips, floor(p_size * 2 / 3.0 + 0.5)::BIGINT AS script, CASE WHEN p_size % 2 = 0 THEN -floor(p_size / 3.0 + 0.5) ELSE floor(p_size / 6.0 + 0.5) END::BIGINT AS shift FROM part")
def unit_conversions(spark, sf_dir):
    size = F.col("p_size")
    where = F.when(size % 2 == 0, "superscript").otherwise("subscript")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.points_to_twips(F.col("p_retailprice")).alias("twips"), numbers.script_size(size).alias("script"), numbers.script_shift(size, where).alias("shift"))


@query("points_text", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE '-' END || regexp_replace(format('{:.2f}', p_size / 20.0), '\\.?0+$', '') AS points FROM part WHERE p_size > 0")
def points_text(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", numbers.twips_to_points_text(F.when(size % 2 == 0, size).otherwise(-size)).alias("points"))


@query("line_heights", "SELECT p_partkey, greatest(1, floor(p_size * 276 / 240.0 + 0.5))::BIGINT AS auto, greatest(1, 18)::BIGINT AS exact, greatest(p_size, 20)::BIGINT AS at_least FROM part")
def line_heights(spark, sf_dir):
    size = F.col("p_size").cast("long")
    height = lambda rule, value: numbers.line_height(size, F.lit(rule), F.lit(value))
    return table(spark, sf_dir, "part").select("p_partkey", height("auto", 276).alias("auto"), height("exact", 18).alias("exact"), height("atLeast", 20).alias("at_least"))


@query("aligned_positions", "SELECT p_partkey, (720 + 9000 - p_size * 100)::BIGINT AS r, (720 + (9000 - p_size * 100) // 2)::BIGINT AS c, 720::BIGINT AS l FROM part")
def aligned_positions(spark, sf_dir):
    x = lambda align: numbers.aligned_x(F.lit(align), F.lit(720), F.lit(9000), F.col("p_size") * 100)
    return table(spark, sf_dir, "part").select("p_partkey", x("right").alias("r"), x("center").alias("c"), x("left").alias("l"))


@query("luminance", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, floor((299 * (l_partkey % 256) + 587 * (l_suppkey % 256) + 114 * (l_orderkey % 256)) / 1000.0 + 0.5)::BIGINT AS y FROM lineitem")
def luminance(spark, sf_dir):
    y = numbers.luminance(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", y.alias("y"))


_ROMAN = "CASE WHEN {0} > 0 THEN repeat('M', ({0} // 1000)::INT) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][({0} // 100) % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][({0} // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][{0} % 10 + 1] ELSE '' END"
_LETTERS = "CASE WHEN {0} <= 0 THEN '' WHEN {0} <= 26 THEN chr((96 + {0})::INT) ELSE chr((97 + ({0} - 27) // 26)::INT) || chr((97 + ({0} - 1) % 26)::INT) END"


@query("list_labels", f"SELECT p_partkey, {_ROMAN.format('p_partkey')} AS upper_roman, lower({_ROMAN.format('p_size')}) AS lower_roman, {_LETTERS.format('p_size')} AS lower_letter, upper({_LETTERS.format('(p_size % 26)')}) AS upper_letter, p_size::VARCHAR AS plain FROM part")
def list_labels(spark, sf_dir):
    label = lambda v, form: counters.counter(v, F.lit(form))
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", label(F.col("p_partkey"), "upperRoman").alias("upper_roman"), label(size, "lowerRoman").alias("lower_roman"), label(size, "lowerLetter").alias("lower_letter"), label(size % 26, "upperLetter").alias("upper_letter"), label(size, "decimal").alias("plain"))


@query("cache_identity", "SELECT o_orderkey, sha256(unhex(lpad(hex(strlen(o_orderstatus)), 8, '0')) || o_orderstatus::BLOB || unhex(lpad(hex(strlen(o_orderpriority)), 8, '0')) || o_orderpriority::BLOB) AS identity FROM orders")
def cache_identity(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.cache_identity(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("identity"))


@query("canonical_json", "SELECT c_custkey, '{\"a\":\"' || c_mktsegment || '\",\"z\":\"' || c_name || '\"}' AS json FROM customer")
def canonical_json(spark, sf_dir):
    entries = F.create_map(F.lit("z"), F.col("c_name"), F.lit("a"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.canonical_json(entries).alias("json"))


@query("safe_paths", "SELECT page_id, NOT starts_with(p, '/') AND len(list_filter(string_split(p, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS safe FROM (SELECT page_id, regexp_replace(url, '^[a-z]+:', '') AS p FROM pages) UNION ALL SELECT page_id, NOT starts_with(p, '/') AND len(list_filter(string_split(p, '/'), lambda s: s IN ('', '.', '..'))) = 0 FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)")
def safe_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    both = pages.select("page_id", F.regexp_replace("url", "^[a-z]+:", "").alias("p")).union(pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "")))
    return both.select("page_id", text.is_safe_part_path(F.col("p")).alias("safe"))
