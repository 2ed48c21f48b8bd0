"""Page files: PDF 1.7 with the standard face, from placed lines. No clock, no random id: equal input, equal bytes."""

from __future__ import annotations

import math
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators.layout import break_paragraph, char_widths, place

FILES = "doc_id long, pages int, content binary, problem string"


def point(twips: int) -> str:
    """A twentieth of a point, exactly."""
    whole, rest = divmod(abs(twips), 20)
    text = f"{whole}" + (f".{rest * 5:02d}".rstrip("0") if rest else "")
    return f"-{text}" if twips < 0 else text


def literal(text: str) -> tuple[bytes, bool]:
    """An escaped string of the standard face's encoding, and whether every character was in it."""
    raw = text.encode("cp1252", "replace")
    whole = raw.decode("cp1252") == text
    for c in (b"\\", b"(", b")"):
        raw = raw.replace(c, b"\\" + c)
    return b"(" + raw + b")", whole


def colour(value: str) -> tuple[float, float, float] | None:
    """#RRGGBB as shares of one."""
    try:
        r, g, b = bytes.fromhex(value.removeprefix("#"))
    except ValueError:
        return None
    return r / 255, g / 255, b / 255


def _shape(shape: tuple, height: int) -> bytes:
    """Drawing operators of ("rectangle", x, y, width, height, colour) or ("line", x1, y1, x2, y2, width, colour, dashes); y from the top."""
    numbers = lambda *v: " ".join(point(n) for n in v)
    shares = lambda value: " ".join(f"{c:.4f}".rstrip("0").rstrip(".") for c in colour(value) or (0, 0, 0))
    if shape[0] == "rectangle":
        _, x, y, w, h, fill = shape
        return f"q {shares(fill)} rg {numbers(x, height - y - h, w, h)} re f Q".encode()
    _, x1, y1, x2, y2, w, stroke, dashes = shape
    return f"q {shares(stroke)} RG {numbers(w)} w [{numbers(*dashes)}] 0 d {numbers(x1, height - y1)} m {numbers(x2, height - y2)} l S Q".encode()


def _link(box: tuple[int, int, int, int, str], height: int) -> bytes:
    """An annotation that opens a link from its box (x, y from the top, width, height, target)."""
    x, y, w, h, target = box
    address = literal(quote(target, safe="%/:=&?~#+!$,;'@()*[]"))[0]
    return f"<< /Type /Annot /Subtype /Link /Rect [{point(x)} {point(height - y - h)} {point(x + w)} {point(height - y)}] /Border [0 0 0] /A << /S /URI /URI ".encode() + address + b" >> >>"


def write_pdf(pages: list[list[tuple[int, int, str]]], width: int, height: int, size: int, title: str = "", links: list[list[tuple]] = (), shapes: list[list[tuple]] = (), **about: str) -> tuple[bytes, str | None]:
    """Bytes of a file whose pages hold lines (x, baseline y from the top, text), and a problem or null.

    ``links`` and ``shapes`` give each page's link boxes and, below its text, its
    rectangles and lines; ``about`` may name author, subject and keywords.
    """
    problem = None
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for number, lines in enumerate(pages):
        parts = [_shape(s, height) for s in (shapes[number] if number < len(shapes) else ())]
        boxes = [_link(b, height) for b in (links[number] if number < len(links) else ())]
        for x, y, text in lines:
            data, whole = literal(text)
            if not whole:
                problem = "pdf/text-encoding"
            parts.append(b"BT /F1 " + point(size).encode() + b" Tf 1 0 0 1 " + point(x).encode() + b" " + point(height - y).encode() + b" Tm " + data + b" Tj ET")
        stream = b"\n".join(parts)
        objects.append(b"<< /Length " + str(len(stream)).encode() + b" >>\nstream\n" + stream + b"\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {point(width)} {point(height)}] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects)} 0 R".encode() + (b" /Annots [" + b" ".join(boxes) + b"]" if boxes else b"") + b" >>")
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    known = {"Title": title, **{k.capitalize(): about[k] for k in ("author", "subject", "keywords") if k in about}}
    known = {k: v for k, v in known.items() if v}
    if known:
        objects.append(b"<< " + b" ".join(f"/{k} ".encode() + literal(v)[0] for k, v in known.items()) + b" >>")
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    info = f" /Info {len(objects)} 0 R" if known else ""
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R{info} >>\nstartxref\n{table}\n%%EOF\n".encode()
    return bytes(out), problem


def render_files(docs: DataFrame, width: int | None = 11906, height: int = 16838, margin: int = 1440, size: int = 220) -> DataFrame:
    """doc_id, pages, content, problem: a page file of each document's text, paragraphs parted at line feeds.

    Without a ``width`` a document's pages are as wide as its longest line, so that none is broken.
    """
    line = size * 6 // 5
    box = math.inf if width is None else width - 2 * margin

    def run(batches):
        widths = char_widths(size)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                broken = [break_paragraph(p, box, size, widths) for p in (text or "").split("\n")]
                wide = 2 * margin + max(w for b in broken for _, w in b) if width is None else width
                pages: list[list] = []
                for page, p, first, last, top in place([{"lines": len(b), "height": line} for b in broken], height - 2 * margin):
                    while len(pages) <= page:
                        pages.append([])
                    for i in range(first, last + 1):
                        pages[page].append((margin, margin + top + (i - first) * line + size * 4 // 5, broken[p][i][0]))
                content, problem = write_pdf(pages, wide, height, size)
                out.append((doc, len(pages), content, problem))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["doc_id", "pages", "content", "problem"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FILES)


def trace_json(items: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, trace: the placed items of each document as JSON with fixed field order."""
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    return items.groupBy(*keys).agg(F.to_json(ordered).alias("trace"))
