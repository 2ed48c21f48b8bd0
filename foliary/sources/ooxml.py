"""Tables of what a package's XML parts hold: relationships, content types, styles, numbering, sections, tables, runs.

Each reader takes the parts of ``open_packages`` and returns one row for each
thing found. Only the parts that a reader needs are parsed. What rows refer to
(targets, parents, levels) is resolved by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.operators.ordered import carry_forward
from foliary.sources.packages import check_xml

# fixed values: namespaces of the format
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify"}
FORMATS = {"decimal": "decimal", "lowerLetter": "lowerLetter", "upperLetter": "upperLetter", "lowerRoman": "lowerRoman", "upperRoman": "upperRoman", "bullet": "bullet"}


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _read(parts: DataFrame, which: Column, schema: str, rows_of: Callable[[str, ElementTree.Element], Iterator[dict]]) -> DataFrame:
    """Run ``rows_of(part name, root)`` on the chosen parts; a part that isn't sound gives no rows."""
    full = f"path string, part string, {schema}"
    types = _arrow(full)

    def run(batches):
        for batch in batches:
            for path, part, content in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "content")), strict=True):
                if check_xml(content) is None:
                    rows = [{"path": path, "part": part, **r} for r in rows_of(part, ElementTree.fromstring(content))]
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    return parts.where(which).select("path", "part", "content").mapInArrow(run, full)


def _value(node, name: str, attribute: str = "val"):
    found = None if node is None else node.find(f"{W}{name}")
    return None if found is None else found.get(f"{W}{attribute}")


def _number(text):
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def _on(node, name: str):
    found = None if node is None else node.find(f"{W}{name}")
    return None if found is None else found.get(f"{W}val", "1") not in ("0", "false", "off")


def relationships(parts: DataFrame) -> DataFrame:
    """path, part, owner, ordinal, id, type, target, external."""

    def rows(part, root):
        folder, _, name = part.rpartition("_rels/")
        for i, node in enumerate(root):
            yield {"owner": folder + name.removesuffix(".rels"), "ordinal": i, "id": node.get("Id"), "type": node.get("Type"), "target": node.get("Target"), "external": node.get("TargetMode") == "External"}

    return _read(parts, F.col("part").endswith(".rels"), "owner string, ordinal int, id string, type string, target string, external boolean", rows)


def resolve_target(owner: Column, target: Column) -> Column:
    """The part that a target names, from its owner's folder; null if it climbs out of the package."""
    folder = F.when(owner.contains("/"), F.regexp_replace(owner, "[^/]*$", "")).otherwise(F.lit(""))
    whole = F.when(target.startswith("/"), F.substring(target, F.lit(2), F.length(target))).otherwise(F.concat(folder, target))
    step = lambda s, x: F.when(s.isNull() | x.isin("", "."), s).when(x == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))).otherwise(F.array_append(s, x))
    stack = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(stack) > 0, F.array_join(stack, "/"))


def root_documents(parts: DataFrame) -> DataFrame:
    """path, document, code: the one main part of each package, or why there is none."""
    rels = relationships(parts).where(F.col("owner") == "")
    main = rels.where(F.substring_index("type", "/", -1) == "officeDocument").withColumn("document", resolve_target(F.col("owner"), F.col("target")))
    have = parts.select("path", F.col("part").alias("document"), F.lit(True).alias("there"))
    found = main.join(have, ["path", "document"], "left").groupBy("path").agg(F.count("*").alias("n"), F.max("external").alias("external"), F.min("document").alias("document"), F.max("there").alias("there"))
    every = parts.select("path").distinct().join(found, "path", "left")
    code = F.when(F.coalesce("n", F.lit(0)) != 1, "DOCX_MISSING_OFFICE_DOCUMENT_RELATIONSHIP").when(F.col("external"), "DOCX_EXTERNAL_RELATIONSHIP").when(F.col("document").isNull(), "DOCX_UNSAFE_RELATIONSHIP_TARGET").when(F.col("there").isNull(), "DOCX_MISSING_RELATIONSHIP_TARGET")
    return every.select("path", F.when(code.isNull(), F.col("document")).alias("document"), code.alias("code"))


def content_types(parts: DataFrame) -> DataFrame:
    """path, part, kind (default, override), key, content_type."""

    def rows(_, root):
        for node in root:
            kind = node.tag.rpartition("}")[2]
            if kind in ("Default", "Override"):
                yield {"kind": kind.lower(), "key": (node.get("Extension") or node.get("PartName") or "").removeprefix("/").lower() if kind == "Default" else (node.get("PartName") or "").removeprefix("/"), "content_type": node.get("ContentType")}

    return _read(parts, F.col("part") == "[Content_Types].xml", "kind string, key string, content_type string", rows)


def typed_parts(parts: DataFrame) -> DataFrame:
    """path, part, content_type: an override for the part, else the default of its extension."""
    types = content_types(parts)
    override = types.where("kind = 'override'").select("path", F.col("key").alias("part"), F.col("content_type").alias("o"))
    default = types.where("kind = 'default'").select("path", F.col("key").alias("extension"), F.col("content_type").alias("d"))
    named = parts.where(F.col("part").isNotNull()).select("path", "part", F.lower(F.substring_index("part", ".", -1)).alias("extension"))
    return named.join(override, ["path", "part"], "left").join(default, ["path", "extension"], "left").select("path", "part", F.coalesce("o", "d").alias("content_type"))


def styles(parts: DataFrame) -> DataFrame:
    """path, part, id, type, name, based_on, next, is_default, align, size, bold, italic, colour."""

    def rows(_, root):
        for node in root.iter(f"{W}style"):
            run = node.find(f"{W}rPr")
            half = _number(_value(run, "sz"))
            yield {
                "id": node.get(f"{W}styleId"), "type": node.get(f"{W}type", "paragraph"), "name": _value(node, "name"), "based_on": _value(node, "basedOn"), "next": _value(node, "next"), "is_default": node.get(f"{W}default") in ("1", "true"),
                "align": ALIGNMENTS.get(_value(node.find(f"{W}pPr"), "jc")), "size": None if half is None else half * 10, "bold": _on(run, "b"), "italic": _on(run, "i"), "colour": _value(run, "color"),
            }

    return _read(parts, F.col("part") == "word/styles.xml", "id string, type string, name string, based_on string, next string, is_default boolean, align string, size int, bold boolean, italic boolean, colour string", rows)


def style_faults(styles_read: DataFrame) -> DataFrame:
    """path, code, id: ids that occur twice, and types with two default styles."""
    twice = styles_read.groupBy("path", "id").count().where("count > 1").select("path", F.lit("DOCX_DUPLICATE_STYLE").alias("code"), "id")
    defaults = styles_read.where("is_default").groupBy("path", "type").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("path", F.lit("DOCX_DUPLICATE_DEFAULT_STYLE").alias("code"), "id")
    return twice.unionByName(defaults)


def numbering(parts: DataFrame) -> DataFrame:
    """path, num_id, level, start, format, text, suffix, restart, legal: instances with their own overrides over the abstract levels."""
    fields = "kind string, id int, abstract int, level int, start int, format string, text string, suffix string, restart int, legal boolean"

    def level(node) -> dict:
        return {"level": _number(node.get(f"{W}ilvl")), "start": _number(_value(node, "start")), "format": FORMATS.get(_value(node, "numFmt")), "text": _value(node, "lvlText"), "suffix": _value(node, "suff"), "restart": _number(_value(node, "lvlRestart")), "legal": _on(node, "isLgl")}

    def rows(_, root):
        for node in root.iter(f"{W}abstractNum"):
            for own in node.findall(f"{W}lvl"):
                yield {"kind": "abstract", "id": _number(node.get(f"{W}abstractNumId")), **level(own)}
        for node in root.iter(f"{W}num"):
            number, base = _number(node.get(f"{W}numId")), _number(_value(node, "abstractNumId"))
            yield {"kind": "instance", "id": number, "abstract": base}
            for own in node.findall(f"{W}lvlOverride"):
                inner = own.find(f"{W}lvl")
                found = level(inner) if inner is not None else {}
                start = _number(_value(own, "startOverride"))
                yield {"kind": "override", "id": number, **found, "level": _number(own.get(f"{W}ilvl")), "start": found.get("start") if start is None else start}

    read = _read(parts, F.col("part") == "word/numbering.xml", fields, rows)
    names = ["start", "format", "text", "suffix", "restart", "legal"]
    base = read.where("kind = 'abstract'").select("path", F.col("id").alias("abstract"), "level", *names)
    instance = read.where("kind = 'instance'").select("path", F.col("id").alias("num_id"), "abstract")
    own = read.where("kind = 'override'").select("path", F.col("id").alias("num_id"), "level", *(F.col(n).alias(f"o_{n}") for n in names))
    merged = instance.join(base, ["path", "abstract"]).join(own, ["path", "num_id", "level"], "left")
    value = {n: F.coalesce(f"o_{n}", n) for n in names}
    value |= {"start": F.coalesce(value["start"], F.lit(1)), "suffix": F.coalesce(value["suffix"], F.lit("tab")), "legal": F.coalesce(value["legal"], F.lit(False))}
    return merged.select("path", "num_id", "level", *(c.alias(n) for n, c in value.items()))


def sections(parts: DataFrame) -> DataFrame:
    """path, ordinal, width, height, margins, columns, header, footer: a section without a header or footer has the one before it."""
    fields = "ordinal int, width int, height int, landscape boolean, top int, right int, bottom int, left int, columns int, gap int, header string, footer string"

    def rows(_, root):
        for i, node in enumerate(root.iter(f"{W}sectPr")):
            size, margin, columns = node.find(f"{W}pgSz"), node.find(f"{W}pgMar"), node.find(f"{W}cols")
            get = lambda n, a: None if n is None else _number(n.get(f"{W}{a}"))
            ref = lambda kind: next((n.get(f"{R}id") for n in node.findall(f"{W}{kind}") if n.get(f"{W}type", "default") == "default"), None)  # noqa: B023, E731
            yield {
                "ordinal": i, "width": get(size, "w"), "height": get(size, "h"), "landscape": size is not None and size.get(f"{W}orient") == "landscape", "top": get(margin, "top"), "right": get(margin, "right"), "bottom": get(margin, "bottom"), "left": get(margin, "left"),
                "columns": get(columns, "num") or 1, "gap": get(columns, "space"), "header": ref("headerReference"), "footer": ref("footerReference"),
            }

    read = _read(parts, F.col("part") == "word/document.xml", fields, rows)
    for name in ("header", "footer"):
        read = carry_forward(read, ["path"], ["ordinal"], F.col(name), name)
    return read.drop("part")


def header_footers(parts: DataFrame) -> DataFrame:
    """path, id, part, text of the headers and footers that a section refers to; others aren't read."""
    used = sections(parts).select("path", F.explode(F.array("header", "footer")).alias("id")).where(F.col("id").isNotNull()).distinct()
    rels = relationships(parts).where(F.col("owner") == "word/document.xml").select("path", "id", resolve_target(F.col("owner"), F.col("target")).alias("part"))
    wanted = used.join(rels, ["path", "id"])
    chosen = parts.join(wanted.select("path", "part").distinct(), ["path", "part"], "left_semi")
    text = _read(chosen, F.lit(True), "text string", lambda _, root: iter([{"text": "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in root.iter(f"{W}p"))}]))
    return wanted.join(text, ["path", "part"], "left").select("path", "id", "part", "text")


def runs(parts: DataFrame) -> DataFrame:
    """path, paragraph, run, style, bold, italic, size, colour, text, link: the runs of the body in order."""
    fields = "paragraph int, run int, style string, bold boolean, italic boolean, size int, colour string, text string, link string"

    def rows(_, root):
        for i, paragraph in enumerate(root.iter(f"{W}p")):
            linked = {id(r): h.get(f"{R}id") for h in paragraph.iter(f"{W}hyperlink") for r in h.iter(f"{W}r")}
            for j, node in enumerate(paragraph.iter(f"{W}r")):
                props = node.find(f"{W}rPr")
                half = _number(_value(props, "sz"))
                text = "".join({f"{W}t": n.text or "", f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}.get(n.tag, "") for n in node)
                yield {"paragraph": i, "run": j, "style": _value(props, "rStyle"), "bold": _on(props, "b"), "italic": _on(props, "i"), "size": None if half is None else half * 10, "colour": _value(props, "color"), "text": text, "link": linked.get(id(node))}

    return _read(parts, F.col("part") == "word/document.xml", fields, rows)


def table_cells(parts: DataFrame) -> DataFrame:
    """path, table_no, row_no, cell, column, span, merge, text: cells by their place in the grid."""
    fields = "table_no int, row_no int, cell int, column int, span int, merge string, text string"

    def rows(_, root):
        for t, table in enumerate(root.iter(f"{W}tbl")):
            for r, row in enumerate(table.findall(f"{W}tr")):
                column = 0
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    props = cell.find(f"{W}tcPr")
                    span = _number(_value(props, "gridSpan")) or 1
                    vertical = None if props is None else props.find(f"{W}vMerge")
                    yield {"table_no": t, "row_no": r, "cell": c, "column": column, "span": span, "merge": None if vertical is None else vertical.get(f"{W}val", "continue"), "text": "\n".join("".join(x.text or "" for x in p.iter(f"{W}t")) for p in cell.findall(f"{W}p"))}
                    column += span

    return _read(parts, F.col("part") == "word/document.xml", fields, rows)


def merge_owners(cells: DataFrame) -> DataFrame:
    """Cells with ``owner_row``, the row of the nearest cell above in the column that begins a merge; null outside merges."""
    owner = F.when(F.col("merge") == "restart", F.col("row_no"))
    found = carry_forward(cells, ["path", "table_no", "column"], ["row_no"], owner, "owner_row")
    return found.withColumn("owner_row", F.when(F.col("merge").isNotNull(), F.col("owner_row")))


def link_target(target: Column) -> Column:
    """A link's address if its scheme is allowed."""
    return F.when(F.lower(F.trim(target)).rlike("^(?:https?://|mailto:|tel:)"), F.trim(target))


def linked_runs(parts: DataFrame) -> DataFrame:
    """path, paragraph, run, text, href of the runs with a link that is allowed."""
    rels = relationships(parts).where((F.col("owner") == "word/document.xml") & F.col("external")).select("path", F.col("id").alias("link"), link_target(F.col("target")).alias("href"))
    return runs(parts).where(F.col("link").isNotNull()).join(rels, ["path", "link"], "left").where(F.col("href").isNotNull()).select("path", "paragraph", "run", "text", "href")


def page_field(instruction: Column) -> Column:
    """PAGE or NUMPAGES of a field instruction with no other than formatting switches; else null."""
    return F.nullif(F.upper(F.regexp_extract(instruction, r"(?i)^\s*(PAGE|NUMPAGES)(?:\s+\\\*\s*(?:Arabic|MERGEFORMAT))*\s*$", 1)), F.lit(""))


def unsupported(parts: DataFrame) -> DataFrame:
    """path, feature: the first feature of each package's body that would lose content."""
    # fixed values: element names behind each feature, in the order of the check
    features = (("math", ("oMath", "oMathPara")), ("revisions", ("ins", "del", "moveFrom", "moveTo")), ("content-control", ("sdt",)), ("footnotes", ("footnoteReference", "endnoteReference")), ("comments", ("commentReference",)), ("embedded-object", ("object",)), ("chunk", ("altChunk",)))

    def rows(_, root):
        names = {n.tag.rpartition("}")[2] for n in root.iter()}
        found = next((f for f, tags in features if names & set(tags)), None)
        if found:
            yield {"feature": found}

    return _read(parts, F.col("part") == "word/document.xml", "feature string", rows).drop("part")


def border_width(eighths: Column) -> Column:
    """Twips of a width in eighths of a point."""
    return F.floor(eighths * 20 / 8 + 0.5).cast("long")


def fallback_allowed(mode: Column, needed: Column) -> Column:
    """Whether a reading mode is lenient enough: strict, then compatible, then lenient."""
    order = F.array(F.lit("strict"), F.lit("compatible"), F.lit("lenient"))
    return F.array_position(order, mode) >= F.array_position(order, needed)


def metadata(parts: DataFrame, name: str) -> DataFrame:
    """path, value: a JSON part beside the document, as a variant; null where it doesn't parse."""
    return parts.where(F.col("part") == name).select("path", F.try_parse_json(F.decode("content", "UTF-8")).alias("value"))


def paragraph_properties(parts: DataFrame) -> DataFrame:
    """path, paragraph and its alignment, spacing, indents, keeps, break before and list reference; a hanging indent is a negative first line."""
    fields = "paragraph int, align string, before int, after int, line int, line_rule string, start int, end int, first_line int, keep_next boolean, keep_lines boolean, break_before boolean, num_id int, level int"

    def rows(_, root):
        for i, node in enumerate(root.iter(f"{W}p")):
            props = node.find(f"{W}pPr")
            get = lambda name, attribute: None if props is None or props.find(f"{W}{name}") is None else _number(props.find(f"{W}{name}").get(f"{W}{attribute}"))  # noqa: B023, E731
            hanging, start, end = get("ind", "hanging"), get("ind", "start"), get("ind", "end")
            numbered = None if props is None else props.find(f"{W}numPr")
            yield {
                "paragraph": i, "align": ALIGNMENTS.get(_value(props, "jc")), "before": get("spacing", "before"), "after": get("spacing", "after"), "line": get("spacing", "line"), "line_rule": _value(props, "spacing", "lineRule"),
                "start": get("ind", "left") if start is None else start, "end": get("ind", "right") if end is None else end, "first_line": get("ind", "firstLine") if hanging is None else -hanging,
                "keep_next": _on(props, "keepNext"), "keep_lines": _on(props, "keepLines"), "break_before": _on(props, "pageBreakBefore"), "num_id": _number(_value(numbered, "numId")), "level": _number(_value(numbered, "ilvl")),
            }

    return _read(parts, F.col("part") == "word/document.xml", fields, rows)
