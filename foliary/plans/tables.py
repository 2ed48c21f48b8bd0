"""Templates in tables: row blocks, their guards, and tables of records rendered row by row.

A row whose only visible paragraph is a block marker opens or closes a block of
rows; a marker beside anything else is a problem. Any other row is rendered cell
by cell, paragraph by paragraph. A whole table is one Column, as a whole
document is: a row loop is a ``transform`` over its array, flattened.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.plans.codegen import Renderer
from foliary.plans.template import MARKER, Branch, Compiled, Field, Loop, Problem, compile_template, manifest, path_problem

ROW = "array<struct<id:string,cells:array<string>,error:string>>"


@dataclass
class Cell:
    """Paragraphs of a cell; ``merge`` is restart or continue in a vertical merge; ``table`` says that a table is nested in it."""

    paragraphs: list[str]
    merge: str | None = None
    table: bool = False


@dataclass
class Row:
    cells: list[Cell]
    header: bool = False


@dataclass
class RowNode:
    """A plain row: the compiled paragraphs of each cell."""

    ordinal: int
    cells: list[list] = field(default_factory=list)


def row_marker(row: Row):
    """The match of a row's marker, a problem's code, or None for a plain row."""
    found, visible = [], 0
    for cell in row.cells:
        if cell.table:
            return "TEMPLATE_UNSUPPORTED_NESTED_TABLE"
        for text in cell.paragraphs:
            visible += bool(text.strip())
            if m := MARKER.fullmatch(text.strip()):
                found.append(m)
    if not found:
        return None
    return found[0] if len(found) == visible == 1 else "TEMPLATE_TABLE_ROW_MARKER_CONTENT"


def _guard(rows: list[Row], first: int, last: int) -> list[Problem]:
    """A block may neither hold header rows nor cut vertical merges."""
    inside = rows[first : last + 1]
    out = [Problem("TEMPLATE_TABLE_LOOP_HEADER", first)] if any(r.header for r in inside) else []
    return out + ([Problem("TEMPLATE_TABLE_LOOP_VERTICAL_MERGE", last)] if any(c.merge for r in inside for c in r.cells) else [])


def compile_table(rows: list[Row]) -> Compiled:
    """Tree, fields and diagnostics of a table; ordinals are those of rows."""
    problems: list[Problem] = []
    root: list = []
    into, stack = root, []
    for ordinal, row in enumerate(rows):
        marker = row_marker(row)
        if isinstance(marker, str):
            problems.append(Problem(marker, ordinal))
        elif marker is None:
            node = RowNode(ordinal)
            for cell in row.cells:
                inner = compile_template(cell.paragraphs)
                node.cells.append(inner.nodes)
                codes = {p.code for p in inner.problems} - {"TEMPLATE_TYPE_CONFLICT", "TEMPLATE_PATH_CONFLICT"}  # judged over the whole table
                problems += [Problem(c, ordinal) for c in sorted(codes)]
            into.append(node)
        else:
            opened, path, other, closed = marker.groups()
            top = stack[-1][0] if stack else None
            if opened:
                if problem := path_problem(path):
                    problems.append(Problem(problem, ordinal))
                node = Branch(ordinal, path) if opened == "if" else Loop(ordinal, path)
                into.append(node)
                stack.append((node, into))
                into = node.then if opened == "if" else node.body
            elif other:
                if not isinstance(top, Branch):
                    problems.append(Problem("TEMPLATE_UNBALANCED_TABLE_BLOCK", ordinal))
                elif top.has_else:
                    problems.append(Problem("TEMPLATE_DUPLICATE_ELSE", ordinal))
                else:
                    top.has_else, into = True, top.other
            elif not isinstance(top, Branch if closed == "if" else Loop):
                problems.append(Problem("TEMPLATE_UNBALANCED_TABLE_BLOCK", ordinal))
            else:
                problems += _guard(rows, top.ordinal, ordinal)
                into = stack.pop()[1]
    problems += [Problem("TEMPLATE_UNCLOSED_TABLE_BLOCK", node.ordinal) for node, _ in stack]
    fields = _fields(root)
    problems += [Problem("TEMPLATE_TYPE_CONFLICT", f.paragraphs[0]) for f in fields if len(f.kinds - {"unknown"}) > 1]
    return Compiled(root, fields, sorted(problems, key=lambda p: (p.paragraph, p.code)))


def _fields(root: list) -> list[Field]:
    """The fields of a table, with the rows that name them."""
    found: dict[str, Field] = {}

    def add(f: Field, base: str, ordinal: int):
        own = found.setdefault(base + f.path, Field(base + f.path))
        own.kinds |= f.kinds
        own.paragraphs += [ordinal] if ordinal not in own.paragraphs else []
        own.formatters += [n for n in f.formatters if n not in own.formatters]

    def walk(nodes: list, base: str):
        for node in nodes:
            if isinstance(node, RowNode):
                for cell in node.cells:
                    for f in manifest(cell):
                        add(f, base, node.ordinal)
                continue
            loop = isinstance(node, Loop)
            add(Field(node.path, {"array" if loop else "boolean"}), base, node.ordinal)
            for part in [node.body] if loop else [node.then, node.other]:
                walk(part, f"{base}{node.path}[]." if loop else base)

    walk(root, "")
    return [found[k] for k in sorted(found)]


class TableRenderer(Renderer):
    """Turns the tree of a table into a Column of rows."""

    EMPTY = ROW

    def _node(self, node, item, schema, suffix: Column) -> Column:
        if not isinstance(node, RowNode):
            return super()._node(node, item, schema, suffix)
        cells = Renderer(self.compiled, self.schema, self.locale, self.zone, self.permissive)
        lines = [cells._nodes(c, item, schema, suffix) for c in node.cells]
        cell_text = lambda c: F.array_join(F.transform(c, lambda line: line["text"]), "\n")
        first = lambda row: F.get(F.filter(F.transform(F.flatten(row), lambda line: line["error"]), lambda e: e.isNotNull()), F.lit(0))
        shaped = lambda row: F.struct(self._id(node.ordinal, suffix).alias("id"), F.transform(row, cell_text).alias("cells"), first(row).alias("error"))
        # over an array of one, so that the row's paragraphs are evaluated once
        return F.transform(F.array(F.array(*lines)), shaped)

    @staticmethod
    def _id(ordinal: int, suffix: Column) -> Column:
        return F.concat(F.lit(f"r{ordinal}"), suffix)

    def _problem(self, ordinal: int, suffix: Column, code: str) -> Column:
        return F.array(F.struct(self._id(ordinal, suffix).alias("id"), F.array().cast(T.ArrayType(T.StringType())).alias("cells"), F.lit(code).alias("error")))


def render_table(compiled: Compiled, records: DataFrame, keys: list[str], locale: str = "en-US", zone: str = "UTC", permissive: bool = False) -> DataFrame:
    """keys, ord, id, cells, error, severity of every row of every record's table."""
    column = TableRenderer(compiled, records.schema, locale, zone, permissive).lines()
    rows = records.select(*keys, F.posexplode(column).alias("ord", "row"))
    severity = F.when(F.col("row.error").isNotNull(), F.lit("warning" if permissive else "error"))
    return rows.select(*keys, "ord", "row.*", severity.alias("severity"))


def block_scopes(blocks: DataFrame, doc: str, order: str, kind: str) -> DataFrame:
    """``blocks`` with ``scope``: neighbouring paragraphs are one scope of blocks; a table or rule ends it (null for those)."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(order)
    starts = (F.col(kind) == "paragraph") & ~F.coalesce(F.lag(kind).over(w) == "paragraph", F.lit(False))
    marked = blocks.withColumn("__start", starts.cast("int"))
    number = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("scope", F.when(F.col(kind) == "paragraph", number - 1).cast("int")).drop("__start")
