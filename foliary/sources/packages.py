"""Word-processing packages: opening, checks, classification, and their text.

A package comes in as a row (path, content), for instance from
``spark.read.format("binaryFile")``. Python opens it, since a ZIP archive is a
binary format; everything that follows works on tables of parts.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import is_safe_part_path

MAX_BYTES, MAX_ENTRIES, MAX_INFLATED = 20_000_000, 2_000, 100_000_000
MAX_DEPTH, MAX_NODES = 128, 1_000_000
REQUIRED = ("[Content_Types].xml", "_rels/.rels")
# fixed values: file extensions that can run
EXECUTABLE = ("bat", "chm", "class", "cmd", "com", "dll", "exe", "hta", "jar", "js", "jse", "lnk", "msi", "msp", "ps1", "reg", "scr", "sh", "vbe", "vbs", "wsf", "wsh")
PARTS = "path string, part string, ordinal int, content binary, size long, problem string"
PARAGRAPHS = "path string, ordinal int, style string, level int, text string, problem string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _ends_with(column: Column, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | column.endswith(name)
    return out


def classify_path(part: Column) -> Column:
    """What kind of active content a part's path names, or null."""
    path = F.lower(part)
    extension = F.substring_index(path, ".", -1)
    return (
        F.when(_ends_with(path, "/vbaproject.bin", "/vbadata.xml") | path.isin("vbaproject.bin", "vbadata.xml"), "vba")
        .when(path.startswith("word/activex/") | path.contains("/activex/"), "activex")
        .when(path.startswith("word/embeddings/") | path.contains("/embeddings/"), "ole")
        .when(extension.isin(*EXECUTABLE), "executable")
        .when(path.startswith("customui/") | path.startswith("word/webextensions/") | path.startswith("word/taskpanes/") | path.endswith("/attachedtoolbars.bin"), "active")
    )


def classify_relationship(kind: Column) -> Column:
    """The same for a relationship's type."""
    value = F.regexp_replace(F.lower(F.trim(kind)), "/+$", "")
    last = F.substring_index(value, "/", -1)
    return (
        F.when(last.isin("vbaproject", "vbadata"), "vba").when(last == "oleobject", "ole").when(last.isin("control", "activexcontrolbinary"), "activex").when(last == "package", "package")
        .when(last.isin("attachedtemplate", "attachedtoolbars", "customui", "webextension", "taskpanes", "afchunk") | value.endswith("/ui/extensibility"), "active")
    )


def classify_content_type(kind: Column) -> Column:
    """The same for a content type."""
    value = F.lower(F.trim(kind))
    has = lambda *names: F.lit(False) if not names else value.contains(names[0]) | has(*names[1:])
    # fixed values: content types of programs
    programs = ("application/javascript", "text/javascript", "application/java-archive", "application/vnd.microsoft.portable-executable", "application/x-bat", "application/x-msdownload", "application/x-msdos-program", "application/x-powershell", "application/x-sh")
    return (
        F.when(has("macroenabled", "ms-office.vbaproject", "ms-word.vbadata"), "vba").when(has("activex", "controlproperties"), "activex").when(has("officedocument.oleobject"), "ole")
        .when(value.isin(*programs), "executable").when(has("customui", "webextension", "taskpane", "attachedtoolbars"), "active")
    )


def open_packages(files: DataFrame) -> DataFrame:
    """path, part, ordinal, content, size, problem: the parts of each package, or one row with the reason it was refused."""

    def parts_of(content: bytes):
        if len(content) > MAX_BYTES:
            return [], "DOCX_TEMPLATE_SIZE_LIMIT"
        if content[:4] != b"PK\x03\x04":
            return [], "DOCX_INVALID_ZIP_MAGIC"
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                entries = [e for e in archive.infolist() if not e.is_dir()]
                if len(entries) > MAX_ENTRIES:
                    return [], "DOCX_ARCHIVE_ENTRY_LIMIT"
                if len({e.filename for e in entries}) < len(entries):
                    return [], "DOCX_DUPLICATE_PART"
                if any(e.flag_bits & 1 for e in entries):
                    return [], "DOCX_UNSUPPORTED_ZIP"
                if sum(e.file_size for e in entries) > MAX_INFLATED:
                    return [], "DOCX_DECOMPRESSED_SIZE_LIMIT"
                return [(e.filename, archive.read(e)) for e in entries], None
        except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, OSError):
            return [], "DOCX_INVALID_ZIP"

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, problem = parts_of(content or b"")
                rows = [(path, name, i, data, len(data), None) for i, (name, data) in enumerate(found)] or [(path, None, None, None, None, problem)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string()), strict=True)], names=["path", "part", "ordinal", "content", "size", "problem"])

    return files.select("path", "content").mapInArrow(run, PARTS)


def package_problems(parts: DataFrame) -> DataFrame:
    """path, code, part: everything against a package, one row each."""
    broken = parts.where(F.col("problem").isNotNull()).select("path", F.col("problem").alias("code"), F.lit(None).cast("string").alias("part"))
    named = parts.where(F.col("part").isNotNull())
    unsafe = named.where(~is_safe_part_path(F.col("part"))).select("path", F.lit("DOCX_UNSAFE_PART_PATH").alias("code"), "part")
    kind = named.withColumn("kind", classify_path(F.col("part"))).where(F.col("kind").isNotNull())
    first = kind.groupBy("path", "kind").agg(F.min_by("part", "ordinal").alias("part"))
    code = F.create_map(*(F.lit(x) for pair in (("vba", "DOCX_FORBIDDEN_VBA"), ("ole", "DOCX_FORBIDDEN_OLE_OBJECT"), ("activex", "DOCX_FORBIDDEN_ACTIVEX"), ("package", "DOCX_FORBIDDEN_ATTACHED_PACKAGE"), ("executable", "DOCX_FORBIDDEN_EXECUTABLE_CONTENT"), ("active", "DOCX_FORBIDDEN_ACTIVE_CONTENT")) for x in pair))
    active = first.select("path", code[F.col("kind")].alias("code"), "part")
    have = named.groupBy("path").agg(F.collect_set(F.when(F.col("part").isin(*REQUIRED), F.col("part"))).alias("have"))
    missing = have.select("path", F.explode(F.array_except(F.array(*map(F.lit, REQUIRED)), "have")).alias("part")).select("path", F.lit("DOCX_MISSING_REQUIRED_PART").alias("code"), "part")
    return broken.unionByName(unsafe).unionByName(active).unionByName(missing)


def check_xml(content: bytes) -> str | None:
    """The first reason why an XML part is refused."""
    try:
        text = content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
    except UnicodeDecodeError:
        return "DOCX_INVALID_XML_ENCODING"
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):
        return "DOCX_FORBIDDEN_XML_DECLARATION"
    depth = nodes = 0
    try:
        for event, _ in ElementTree.iterparse(io.BytesIO(text.encode()), events=("start", "end")):
            depth += 1 if event == "start" else -1
            nodes += event == "start"
            if depth > MAX_DEPTH:
                return "DOCX_XML_DEPTH_LIMIT"
            if nodes > MAX_NODES:
                return "DOCX_XML_NODE_LIMIT"
    except ElementTree.ParseError:
        return "DOCX_INVALID_XML"
    return None


def paragraphs(parts: DataFrame) -> DataFrame:
    """path, ordinal, style, level, text, problem: the body's paragraphs in order; tabs and breaks as characters."""

    def text_of(node) -> str:
        out = []
        for run in node.iter():
            if run.tag == f"{_W}t":
                out.append(run.text or "")
            elif run.tag == f"{_W}tab":
                out.append("\t")
            elif run.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return "".join(out)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                problem = check_xml(content)
                rows = []
                if problem is None:
                    for i, node in enumerate(ElementTree.fromstring(content).iter(f"{_W}p")):
                        style, level = node.find(f"{_W}pPr/{_W}pStyle"), node.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
                        rows.append((path, i, None if style is None else style.get(f"{_W}val"), None if level is None else int(level.get(f"{_W}val")), text_of(node), None))
                rows = rows or [(path, None, None, None, None, problem)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "ordinal", "style", "level", "text", "problem"])

    return parts.where(F.col("part") == "word/document.xml").select("path", "content").mapInArrow(run, PARAGRAPHS)


def minimal_package(texts: list[str]) -> bytes:
    """A package with one paragraph for each text."""
    from foliary.sinks.docx import write_package

    return write_package(texts)
