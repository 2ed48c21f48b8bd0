"""Package contents, JSON, rasters and page files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from foliary.functions import nested
from foliary.plans.catalog import query
from foliary.session import table
from foliary.sources import data, ooxml
from foliary.sources.packages import open_packages

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PARTS = {
    "[Content_Types].xml": '<Types xmlns="x"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="rels"/><Override PartName="/word/document.xml" ContentType="main"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="x"><Relationship Id="a" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'<Relationships xmlns="x"><Relationship Id="h1" Type="{_REL}/header" Target="header1.xml"/><Relationship Id="l1" Type="{_REL}/hyperlink" Target="https://example.com/" TargetMode="External"/><Relationship Id="l2" Type="{_REL}/hyperlink" Target="javascript:x" TargetMode="External"/></Relationships>',
    "word/header1.xml": f"<w:hdr {_NS}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>",
    "word/header2.xml": f"<w:hdr {_NS}><w:p><w:r><w:t>Unused</w:t></w:r></w:p></w:hdr>",
    "word/styles.xml": f'<w:styles {_NS}><w:style w:type="paragraph" w:styleId="Base" w:default="1"><w:name w:val="Base"/><w:pPr><w:jc w:val="both"/></w:pPr><w:rPr><w:sz w:val="22"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Title"><w:basedOn w:val="Base"/><w:rPr><w:b/><w:sz w:val="40"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Lost"><w:basedOn w:val="Gone"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {_NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>',
    "word/document.xml": f'<w:document {_NS}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Report</w:t></w:r></w:p><w:p><w:hyperlink r:id="l1"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:hyperlink r:id="l2"><w:r><w:t>bad</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tblGrid/><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl><w:p><w:pPr><w:sectPr><w:headerReference r:id="h1"/><w:pgSz w:w="11906" w:h="16838"/><w:cols w:num="2" w:space="720"/></w:sectPr></w:pPr></w:p><w:sectPr><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/></w:sectPr></w:body></w:document>',
}


def sample_parts(spark):
    """One package with every kind of part, opened."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in PARTS.items():
            archive.writestr(zipfile.ZipInfo(name), text)
    return open_packages(spark.createDataFrame([("s", out.getvalue())], "path string, content binary"))


@query("package_relationships", "SELECT * FROM (VALUES ('', 'a', 'word/document.xml', false), ('word/document.xml', 'h1', 'word/header1.xml', false), ('word/document.xml', 'l1', NULL, true), ('word/document.xml', 'l2', NULL, true)) t(owner, id, part, external)")
def package_relationships(spark, sf_dir):
    rels = ooxml.relationships(sample_parts(spark))
    return rels.select("owner", "id", F.when(~F.col("external"), ooxml.resolve_target(F.col("owner"), F.col("target"))).alias("part"), "external")


@query("package_root", "SELECT 's' AS path, 'word/document.xml' AS document, NULL::VARCHAR AS code")
def package_root(spark, sf_dir):
    return ooxml.root_documents(sample_parts(spark))


@query("package_content_types", "SELECT * FROM (VALUES ('[Content_Types].xml', 'application/xml'), ('_rels/.rels', 'rels'), ('word/_rels/document.xml.rels', 'rels'), ('word/header1.xml', 'application/xml'), ('word/header2.xml', 'application/xml'), ('word/styles.xml', 'application/xml'), ('word/numbering.xml', 'application/xml'), ('word/document.xml', 'main')) t(part, content_type)")
def package_content_types(spark, sf_dir):
    return ooxml.typed_parts(sample_parts(spark)).select("part", "content_type")


@query("package_styles", "SELECT * FROM (VALUES ('Base', NULL, 'justify', 220, NULL, NULL), ('Title', 'Base', NULL, 400, true, NULL), ('Lost', 'Gone', NULL, NULL, NULL, 'DOCX_MISSING_STYLE_PARENT')) t(id, based_on, align, size, bold, problem)")
def package_styles(spark, sf_dir):
    from foliary.operators.joins import style_chains

    read = ooxml.styles(sample_parts(spark))
    faults = style_chains(read.select("id", "type", "based_on")).where("problem is not null").select("id", "problem")
    return read.join(faults, "id", "left").select("id", "based_on", "align", "size", "bold", "problem")


@query("package_numbering", "SELECT * FROM (VALUES (1, 0, 1, 'decimal', '%1.'), (1, 1, 1, 'lowerLetter', '%1.%2'), (2, 0, 5, 'decimal', '%1.'), (2, 1, 1, 'lowerLetter', '%1.%2')) t(num_id, level, start, format, text)")
def package_numbering(spark, sf_dir):
    return ooxml.numbering(sample_parts(spark)).select("num_id", "level", "start", "format", "text")


@query("package_sections", "SELECT * FROM (VALUES (0, 11906, false, 2, 'h1'), (1, 16838, true, 1, 'h1')) t(ordinal, width, landscape, columns, header)")
def package_sections(spark, sf_dir):
    return ooxml.sections(sample_parts(spark)).select("ordinal", "width", "landscape", "columns", "header")


@query("package_headers", "SELECT 'h1' AS id, 'word/header1.xml' AS part, 'Head' AS text")
def package_headers(spark, sf_dir):
    return ooxml.header_footers(sample_parts(spark)).select("id", "part", "text")


@query("package_cells", "SELECT * FROM (VALUES (0, 0, 2, 'wide', NULL), (0, 2, 1, 'tall', 0), (1, 0, 1, 'a', NULL), (1, 1, 1, 'b', NULL), (1, 2, 1, '', 0)) t(row_no, \"column\", span, text, owner_row)")
def package_cells(spark, sf_dir):
    return ooxml.merge_owners(ooxml.table_cells(sample_parts(spark))).select("row_no", "column", "span", "text", "owner_row")


@query("package_links", "SELECT 1 AS paragraph, 'site' AS text, 'https://example.com/' AS href")
def package_links(spark, sf_dir):
    return ooxml.linked_runs(sample_parts(spark)).select("paragraph", "text", "href")


@query("relative_targets", "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/', ''), '[?#].*$', '') AS raw, CASE WHEN regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/', ''), '[?#].*$', ''), '/+$', '') <> '' THEN 'word/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/', ''), '[?#].*$', ''), '/+$', '') ELSE 'word' END AS part, NULL::VARCHAR AS out FROM pages")
def relative_targets(spark, sf_dir):
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*/", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").withColumn("raw", raw)
    return pages.select("page_id", "raw", ooxml.resolve_target(F.lit("word/media/x.xml"), F.concat(F.lit(".././"), "raw")).alias("part"), ooxml.resolve_target(F.lit("word/x.xml"), F.concat(F.lit("../../"), "raw")).alias("out"))


@query("page_fields", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'NUMPAGES' END AS field FROM part")
def page_fields(spark, sf_dir):
    instruction = F.when(F.col("p_size") % 3 == 0, r" page \* MERGEFORMAT ").when(F.col("p_size") % 3 == 1, "NUMPAGES").otherwise("PAGE \\x")
    return table(spark, sf_dir, "part").select("p_partkey", ooxml.page_field(instruction).alias("field"))


@query("json_positions", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'syntax' WHEN event_id % 3 = 1 THEN 'root' END AS problem, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 1 END AS line FROM events")
def json_positions(spark, sf_dir):
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": 1,\n'), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", props.alias("props"))
    return data.json_problems(rows, "event_id", "props").select("event_id", "problem", "line")


@query("json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS value, 'rows[' || event_id || '].name' AS filled, 'items[' || event_id || '].a/b' AS pointed FROM events")
def json_paths(spark, sf_dir):
    number = F.col("event_id")
    pointer = F.concat(F.lit("/items/"), number.cast("string"), F.lit("/a~1b"))
    return table(spark, sf_dir, "events").select("event_id", nested.get_path(F.col("props"), "k").alias("value"), nested.concrete_path(F.lit("rows[].name"), F.array(number)).alias("filled"), nested.pointer_to_path(pointer).alias("pointed"))


@query("option_lists", "SELECT p_partkey, [p_brand, p_type] AS options FROM part")
def option_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", nested.flat_options(F.concat(F.lit("  "), "p_brand", F.lit(" \n\n"), "p_type")).alias("options"))


@query("placeholders", "SELECT event_id, CASE event_type WHEN 'view' THEN '{{e.ts:date | date}}' WHEN 'click' THEN '{{e.ts:number}}' ELSE '{{e.ts}}' END AS tag, strftime(ts, '%Y-%m-%d') AS day FROM events")
def placeholders(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "date").when(F.col("event_type") == "click", "number").otherwise("unknown")
    stored = F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf_dir, "events").select("event_id", nested.placeholder(F.lit("e.ts"), kind).alias("tag"), nested.stored_date(stored, False, False).alias("day"))


@query("array_edits", "SELECT o_orderkey, [o_orderstatus, o_orderpriority, 'new'] AS added, [o_orderpriority] AS removed FROM orders")
def array_edits(spark, sf_dir):
    items = F.array("o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", nested.add_item(items, F.lit("new")).alias("added"), nested.remove_item(items, F.lit(0)).alias("removed"))


@query("raster_pixels", "SELECT p_partkey AS img_id, x::INT AS x, y::INT AS y, ((p_partkey + x) % 256)::INT AS r, ((p_size + y) % 256)::INT AS g, 7 AS b FROM part, range(3) a(x), range(2) c(y)")
def raster_pixels(spark, sf_dir):
    byte = lambda n: F.unhex(F.lpad(F.hex(n % 256), 2, "0"))
    samples = [c for y in range(2) for x in range(3) for c in (byte(F.col("p_partkey") + x), byte(F.col("p_size") + y), byte(F.lit(7)))]
    content = F.concat(F.encode(F.lit("P6\n3 2\n255\n"), "UTF-8"), *samples)
    return data.pixels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"), content.alias("content")))


@query("page_reports", "SELECT p_partkey, (p_size + 1)::INT AS pages, 595.28::DOUBLE AS width, 841.89::DOUBLE AS height, 90 AS rotation FROM part")
def page_reports(spark, sf_dir):
    report = F.concat(F.lit("Title: x\nPages:          "), (F.col("p_size") + 1).cast("string"), F.lit("\nPage size:      595.28 x 841.89 pts (A4)\nPage rot:       90\n"))
    return table(spark, sf_dir, "part").select("p_partkey", data.page_report(report).alias("r")).select("p_partkey", "r.*")


@query("page_files_read_back", "SELECT doc_id, regexp_replace(trim(text, ' ' || chr(10)), '[ \\t]*\\n[ \\t]*|[ \\t]+', ' ', 'g') AS words FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\\x0A\\x20-\\x7E]', '', 'g'), ' +', ' ', 'g') AS text FROM documents)")
def page_files_read_back(spark, sf_dir):
    """Every document as a page file, read again: the words in order (no line is broken, pages being as wide as they need), a document without a text having none."""
    from foliary.sinks.pdf import render_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = F.regexp_replace(F.regexp_replace("text", r"[^\x0A\x20-\x7E]", ""), " +", " ")
    files = render_files(docs.where("text is not null").select("doc_id", clean.alias("text")), width=None)
    whole = data.read_files(files).select("doc_id", F.array_join("pages", "\n").alias("text")).unionByName(docs.where("text is null"))
    return whole.select("doc_id", F.regexp_replace(F.regexp_replace("text", r"^[ \n]+|[ \n]+$", ""), r"[ \t]*\n[ \t]*|[ \t]+", " ").alias("words"))


@query("aspect_fit", "SELECT p_partkey, CASE WHEN p_size * 100 * 3 > 1000 * 4 THEN greatest(1, floor(1000 * 4 / 3.0 + 0.5)) ELSE p_size * 100 END::BIGINT AS width, CASE WHEN p_size * 100 * 3 > 1000 * 4 THEN 1000 ELSE greatest(1, floor(p_size * 100 * 3 / 4.0 + 0.5)) END::BIGINT AS height FROM part")
def aspect_fit(spark, sf_dir):
    from foliary.functions.numbers import fit

    return table(spark, sf_dir, "part").select("p_partkey", fit(F.col("p_size") * 100, F.lit(1000), F.lit(4), F.lit(3)).alias("s")).select("p_partkey", "s.*")
