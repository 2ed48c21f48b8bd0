"""JSON with positions and bounds, rasters, page-file reports and page files read back."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, MAX_ITEMS, MAX_TEXT = 32, 100_000, 100_000, 10_000_000


def json_problems(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, problem, line, column: JSON that doesn't parse, isn't an object, or is beyond the bounds."""

    def check(raw):
        try:
            value = json.loads(raw)
        except json.JSONDecodeError as e:
            return "syntax", e.lineno, e.colno
        except RecursionError:
            return "depth", None, None
        if not isinstance(value, dict):
            return "root", 1, 1
        nodes = size = 0
        todo = [(value, 1)]
        while todo:
            node, depth = todo.pop()
            nodes += 1
            if depth > MAX_DEPTH:
                return "depth", None, None
            if isinstance(node, dict):
                size += sum(len(k.encode()) for k in node)
                todo += [(v, depth + 1) for v in node.values()]
            elif isinstance(node, list):
                if len(node) > MAX_ITEMS:
                    return "items", None, None
                todo += [(v, depth + 1) for v in node]
            elif isinstance(node, str):
                size += len(node.encode())
            if nodes > MAX_NODES or size > MAX_TEXT:
                return "nodes" if nodes > MAX_NODES else "text", None, None
        return None, None, None

    def run(batches):
        for batch in batches:
            found = [check(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True))] if found else [batch.column(key), pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=[key, "problem", "line", "column"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, problem string, line int, column int")


def read_ppm(content: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, samples) of a binary raster of eight-bit colours."""
    m = re.match(rb"P6\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", content)
    if m is None:
        return None
    width, height = int(m[1]), int(m[2])
    samples = content[m.end() :]
    return (width, height, samples) if len(samples) == width * height * 3 else None


def write_ppm(width: int, height: int, samples: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (width, height) + samples


def pixels(rasters: DataFrame, key: str = "img_id") -> DataFrame:
    """key, x, y, r, g, b of rasters (key, content); a file that isn't one gives no rows."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = read_ppm(content or b"")
                if found:
                    width, height, samples = found
                    rgb = np.frombuffer(samples, np.uint8).reshape(-1, 3).astype(np.int32)
                    at = np.arange(width * height, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), batch.schema.field(key).type), pa.array(at % width), pa.array(at // width), *(pa.array(rgb[:, i]) for i in range(3))], names=[key, "x", "y", "r", "g", "b"])

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "content").mapInArrow(run, f"{key} {kind}, x int, y int, r int, g int, b int")


def page_report(text: Column) -> Column:
    """(pages, width, height, rotation) of a page-file report of ``Name: value`` lines."""
    field = lambda pattern, kind: F.regexp_extract(text, pattern, 1).try_cast(kind)
    return F.struct(field(r"(?m)^Pages:\s+(\d+)", "int").alias("pages"), field(r"(?m)^Page\s*(?:\d+ )?size:\s+([\d.]+) x", "double").alias("width"), field(r"(?m)^Page\s*(?:\d+ )?size:\s+[\d.]+ x ([\d.]+)", "double").alias("height"), field(r"(?m)^Page\s*(?:\d+ )?rot:\s+(\d+)", "int").alias("rotation"))


def decode_literal(raw: bytes) -> bytes:
    """The bytes of an escaped string."""
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m):
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r", b"\r\n") else named.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.|\n)", one, raw, flags=re.S)


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, pages, problem: a row for each page file (doc_id, content), with the lines of each of its pages, after a check of the file's table."""
    shown = re.compile(rb"\(([^\\()]*(?:\\.[^\\()]*)*)\) Tj", re.S)

    def parse(content: bytes):
        at = re.search(rb"startxref\s+(\d+)\s+%%EOF\s*$", content)
        if not content.startswith(b"%PDF-") or at is None or content[int(at[1]) : int(at[1]) + 4] != b"xref":
            return None
        places = [int(m[1]) for m in re.finditer(rb"(?m)^(\d{10}) \d{5} n", content[int(at[1]) :])]
        if any(not re.match(rb"\d+ 0 obj", content[p : p + 20]) for p in places):
            return None
        objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(\d+) 0 obj\n(.*?)\nendobj", content)}
        root = next((o for o in objects.values() if b"/Type /Pages" in o), b"")
        out = []
        for kid in re.findall(rb"(\d+) 0 R", root[root.find(b"/Kids") : root.find(b"]")]):
            body = re.search(rb"/Contents (\d+) 0 R", objects[int(kid)])
            stream = objects[int(body[1])]
            out.append("\n".join(decode_literal(m).decode("cp1252") for m in shown.findall(stream)))
        return out

    def run(batches):
        for batch in batches:
            found = [parse(content or b"") for content in batch.column("content").to_pylist()]
            problems = [None if f is not None else "pdf/structure" for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.string())), pa.array(problems, pa.string())], names=["doc_id", "pages", "problem"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, pages array<string>, problem string")


def read_pages(files: DataFrame) -> DataFrame:
    """doc_id, page, text, problem: the lines of each page of page files (doc_id, content), after a check of the file's table."""
    return read_files(files).select("doc_id", F.posexplode_outer("pages").alias("page", "text"), "problem").where("page is not null or problem is not null")


def read_links(files: DataFrame) -> DataFrame:
    """doc_id, page, place, target of the links in page files (doc_id, content), in order; ``place`` is left, bottom, right and top in points."""
    link = re.compile(rb"/Subtype /Link /Rect \[([^\]]*)\].*?/URI \(((?:[^\\()]|\\.)*)\)", re.S)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                pages = re.findall(rb"(?s)<< /Type /Page /.*?endobj", content or b"")
                rows += [(doc, i, m[1].decode(), decode_literal(m[2]).decode("cp1252")) for i, page in enumerate(pages) for m in link.finditer(page)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "page", "place", "target"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, page int, place string, target string")
