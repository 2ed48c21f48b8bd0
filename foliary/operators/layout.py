"""Line breaking, pagination and table geometry.

Measuring is a Column. Breaking and paginating are true folds over the order of
a document, so they run document by document in Arrow batches: documents are
independent, no shuffle is needed, and a task holds one batch.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.measure import OTHER, class_widths

LINES = "doc_id long, paragraph int, line int, text string, width long"
PAGES = "doc_id long, page int, paragraph int, first_line int, last_line int, top long"
_TOKEN = re.compile(r"\r\n|\r|\n|[\t ]+|[^\r\n\t ]+")


def char_widths(size: int) -> dict[str, int]:
    return {c: w for chars, w in class_widths(size) for c in chars}


def break_paragraph(text: str, box: int, size: int, widths: dict[str, int] | None = None) -> list[tuple[str, int]]:
    """(text, width) of the lines of a paragraph in a box.

    A token goes on the line if it still fits; blanks that don't are swallowed by
    the break; a token wider than the box is cut where it must be; blanks at a
    line's end don't count.
    """
    widths = char_widths(size) if widths is None else widths
    other = int(OTHER * size / 1000 + 0.5)
    if "\r" not in text and "\n" not in text:
        whole = sum(widths.get(c, other) * text.count(c) for c in set(text))
        if whole <= box:
            kept = text.rstrip("\t ")
            return [(kept, whole - sum(widths.get(c, other) for c in text[len(kept) :]))]
    lines: list[tuple[str, int]] = []
    line, used = "", 0

    def end(text: str, width: int) -> None:
        kept = text.rstrip("\t ")
        lines.append((kept, width - sum(widths.get(c, other) for c in text[len(kept) :])))

    for token in _TOKEN.findall(text):
        if token in ("\n", "\r", "\r\n"):
            end(line, used)
            line, used = "", 0
            continue
        width = sum(widths.get(c, other) for c in token)
        if used + width <= box:
            line, used = line + token, used + width
        elif token[0] in "\t ":
            end(line, used)
            line, used = "", 0
        else:
            if line:
                end(line, used)
                line, used = "", 0
            for c in token:
                w = widths.get(c, other)
                if line and used + w > box:
                    end(line, used)
                    line, used = "", 0
                line, used = line + c, used + w
    end(line, used)
    return lines


def wrap(docs: DataFrame, box: int, size: int) -> DataFrame:
    """doc_id, paragraph, line, text, width: the lines of each paragraph of each document (text parted at line feeds)."""

    def run(batches):
        widths = char_widths(size)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [(doc, p, i, t, w) for p, paragraph in enumerate((text or "").split("\n")) for i, (t, w) in enumerate(break_paragraph(paragraph, box, size, widths))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "paragraph", "line", "text", "width"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LINES)


def place(paragraphs: list[dict], room: int) -> list[tuple[int, int, int, int, int]]:
    """(page, paragraph, first line, last line, top) of the parts of a document's paragraphs.

    A paragraph has ``lines``, ``height`` (of a line), and maybe ``before``,
    ``after``, ``break_before``, ``keep_next``, ``keep_lines``. In this order: a
    break before; a chain of paragraphs kept with their next moves to a fresh page
    if it fits one; lines kept together do the same; then lines are placed as they
    fit. Of four lines or more, one alone is left at no page's end or beginning.
    """
    out = []
    page, y = 0, 0
    i = 0
    for i, p in enumerate(paragraphs):
        n, height = p["lines"], p["height"]
        before, after = p.get("before", 0), p.get("after", 0)
        if p.get("break_before") and y > 0:
            page, y = page + 1, 0
        if p.get("keep_next") and not (i and paragraphs[i - 1].get("keep_next")):
            chain, j = 0, i
            while j < len(paragraphs) and (j == i or paragraphs[j - 1].get("keep_next") and not paragraphs[j].get("break_before")):
                q = paragraphs[j]
                tail = q["lines"] if q.get("keep_next") else min(q["lines"], 1)
                chain += q.get("before", 0) + tail * q["height"] + (q.get("after", 0) if q.get("keep_next") else 0)
                j += 1
            if y > 0 and y + chain > room and chain <= room:
                page, y = page + 1, 0
        if p.get("keep_lines") and y > 0 and y + before + n * height > room and n * height <= room:
            page, y = page + 1, 0
        y += before if y > 0 else 0
        at = 0
        while at < n:
            fit = max(0, (room - y) // height)
            if fit == 0 and y > 0:
                page, y = page + 1, 0
                continue
            take = min(n - at, max(1, fit))
            if n >= 4 and at + take < n:
                if at == 0 and take == 1 and y > 0:
                    page, y = page + 1, 0
                    continue
                if n - at - take == 1 and take >= 2:
                    take -= 1
            out.append((page, i, at, at + take - 1, y))
            y += take * height
            at += take
            if at < n:
                page, y = page + 1, 0
        y += after
    return out


def paginate(docs: DataFrame, box: int, size: int, room: int, line: int, spacing: int = 0) -> DataFrame:
    """doc_id, page, paragraph, first_line, last_line, top: where each document's paragraphs come to stand."""

    def run(batches):
        widths = char_widths(size)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                paragraphs = [{"lines": len(break_paragraph(p, box, size, widths)), "height": line, "after": spacing} for p in (text or "").split("\n")]
                rows = [(doc, *r) for r in place(paragraphs, room)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "page", "paragraph", "first_line", "last_line", "top"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PAGES)


def column_boxes(width: int, count: int, gap: int) -> list[tuple[int, int]]:
    """(x, width) of equal columns; the first ones take one more each for the remainder."""
    inner = width - gap * (count - 1)
    base, rest = divmod(inner, count)
    out, x = [], 0
    for i in range(count):
        own = base + (i < rest)
        out.append((x, own))
        x += own + gap
    return out


def solve_widths(columns: list[dict], total: int) -> list[int]:
    """Widths of responsive columns: fixed ones, ones that hug their content, and ones that share what is left.

    A column has ``kind`` (fixed, hug, fill), ``width`` or ``content``, and maybe
    ``low`` and ``high``. Shares are evened out by filling up to the bounds; if the
    columns are too wide, hugging and filling ones shrink to their lower bounds.
    """
    low = [c.get("low", 1) for c in columns]
    high = [c.get("high", total) for c in columns]
    out = [c["width"] if c["kind"] == "fixed" else min(max(c.get("content", 1), low[i]), high[i]) if c["kind"] == "hug" else low[i] for i, c in enumerate(columns)]
    open_columns = [i for i, c in enumerate(columns) if c["kind"] == "fill"]
    left = total - sum(out)
    while left > 0 and open_columns:
        base, rest = divmod(left, len(open_columns))
        given = 0
        for k, i in enumerate(list(open_columns)):
            add = min(base + (k < rest), high[i] - out[i])
            out[i] += add
            given += add
            if out[i] >= high[i]:
                open_columns.remove(i)
        left -= given
        if given == 0:
            break
    over = sum(out) - total
    for i, c in reversed(list(enumerate(columns))):
        if over > 0 and c["kind"] != "fixed":
            cut = min(over, out[i] - low[i])
            out[i] -= cut
            over -= cut
    return out


def snap_page(width: int, height: int, tolerance: int = 20) -> tuple[int, int]:
    """A page size near an ISO one, in twips, becomes exactly that."""
    short, long = 841, 1189  # A0 in millimetres; each next size halves the longer side
    for _ in range(11):
        iso = (round(short * 1440 / 25.4), round(long * 1440 / 25.4))
        for size in (iso, iso[::-1]):
            if abs(size[0] - width) <= tolerance and abs(size[1] - height) <= tolerance:
                return size
        short, long = long // 2, short
    return width, height


def intrinsic_widths(cells: list[tuple[int, int, int]], columns: int) -> list[int]:
    """Content widths of a table's columns from (column, span, width) of its cells.

    Cells of one column set its width; what a wider cell lacks over its columns is
    shared out evenly, the first ones taking one more for the remainder.
    """
    out = [0] * columns
    for column, span, width in cells:
        if span == 1:
            out[column] = max(out[column], width)
    for column, span, width in sorted(c for c in cells if c[1] > 1):
        lack = width - sum(out[column : column + span])
        if lack > 0:
            base, rest = divmod(lack, span)
            for k in range(span):
                out[column + k] += base + (k < rest)
    return out


def row_heights(rows: list[dict], cells: list[tuple[int, int, int]]) -> list[int] | str:
    """Heights of a table's rows from (first row, rows merged, height) of its cells, or a diagnostic's code.

    A row may have ``rule`` (exact, atLeast) and ``height``. What a merged cell
    lacks over its rows is added to the last of them, unless that one is exact.
    """
    out = []
    for i, row in enumerate(rows):
        content = max((h for first, n, h in cells if first == i and n == 1), default=0)
        rule, fixed = row.get("rule"), row.get("height", 0)
        if rule == "exact" and content > fixed:
            return "layout/table-row-too-small"
        out.append(max(1, fixed if rule == "exact" else max(content, fixed)))
    for first, n, height in sorted(c for c in cells if c[1] > 1):
        lack = height - sum(out[first : first + n])
        last = first + n - 1
        if lack > 0:
            if rows[last].get("rule") == "exact":
                return "layout/table-vertical-merge-expanded-exact-row"
            out[last] += lack
    return out


def content_top(align: str, region: int, insets: int, content: int) -> int:
    """Offset of a cell's content in its region (for merged cells, of the whole chain)."""
    extra = max(0, region - insets - content)
    return extra // 2 if align == "center" else extra if align == "bottom" else 0


def justify(words: list[int], room: int) -> list[int]:
    """Additions to the gaps between words that fill a wrapped line: equal, the first ones one more."""
    gaps = len(words) - 1
    lack = room - sum(words)
    if gaps <= 0 or lack <= 0:
        return [0] * max(gaps, 0)
    base, rest = divmod(lack, gaps)
    return [base + (i < rest) for i in range(gaps)]


def baseline(top: int, ascent: int, height: int, natural: int) -> int:
    return top + ascent + max(0, height - natural) // 2


def page_field_width(limit: int, digit: int) -> int:
    """Room kept for a page number before the number of pages is known."""
    return len(str(limit)) * digit


def merge_breaks(automatic: list[dict], manual: list[dict]) -> list[dict]:
    """Page breaks in order of position; where both are at one, the manual one stays."""
    found = {b["at"]: {**b, "kind": "automatic"} for b in automatic}
    found |= {b["at"]: {**b, "kind": "manual"} for b in manual}
    return [found[k] for k in sorted(found)]
