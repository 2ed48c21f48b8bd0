"""Compiled templates as Columns.

The whole document is one expression: a paragraph is a ``concat``, a branch a
``when``, a loop a ``transform`` over its array, flattened. Rendering a table of
records is a projection and one ``posexplode``: no join, no shuffle, no Python.
Paths inside a loop are looked up in its item only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions import dates, numbers
from foliary.plans.template import Branch, Compiled, Loop, Tag

LINE = "array<struct<id:string,text:string,error:string>>"


class Renderer:
    """Turns the tree of one template into a Column for records of one schema."""

    EMPTY = LINE

    def __init__(self, compiled: Compiled, schema: T.StructType, locale: str, zone: str, permissive: bool = False):
        if not compiled.ok:
            raise ValueError(f"the template has errors: {compiled.problems}")
        self.compiled, self.locale, self.zone, self.permissive = compiled, locale, zone, permissive
        self.schema = schema

    def lines(self) -> Column:
        return self._nodes(self.compiled.nodes, None, self.schema, F.lit(""))

    def _lookup(self, path: str, item: Column | None, schema: T.DataType):
        """(column, type) of a path, or None if the schema lacks it."""
        column, kind = item, schema
        for name in path.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                return None
            column = F.col(f"`{name}`") if column is None else column[name]
            kind = kind[name].dataType
        return column, kind

    def _nodes(self, nodes: list, item, schema, suffix: Column) -> Column:
        parts = [self._node(n, item, schema, suffix) for n in nodes]
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(self.EMPTY)

    def _node(self, node, item, schema, suffix: Column) -> Column:
        if isinstance(node, Loop):
            found = self._lookup(node.path, item, schema)
            if found is None or not isinstance(found[1], T.ArrayType):
                return self._problem(node.ordinal, suffix, "TEMPLATE_VALUE_MISSING" if found is None else "TEMPLATE_VALUE_TYPE")
            inner = found[1].elementType

            def body(element, i):
                below = F.when(suffix == "", F.concat(F.lit("~each-"), i.cast("string"))).otherwise(F.concat(suffix, F.lit("-"), i.cast("string")))
                return self._nodes(node.body, element, inner, below)

            return F.coalesce(F.flatten(F.transform(found[0], body)), F.array().cast(self.EMPTY))
        if isinstance(node, Branch):
            found = self._lookup(node.path, item, schema)
            if found is None or not isinstance(found[1], T.BooleanType):
                return self._problem(node.ordinal, suffix, "TEMPLATE_VALUE_MISSING" if found is None else "TEMPLATE_VALUE_TYPE")
            then, other = self._nodes(node.then, item, schema, suffix), self._nodes(node.other, item, schema, suffix)
            return F.when(found[0], then).when(~found[0], other).otherwise(self._problem(node.ordinal, suffix, "TEMPLATE_VALUE_TYPE"))
        texts, errors = [], []
        for piece in node.pieces:
            if isinstance(piece, Tag):
                text, error = self._value(piece, item, schema)
                texts.append(F.coalesce(text, F.lit("")))
                errors.append(error)
            else:
                texts.append(F.lit(piece))
        error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
        return F.array(F.struct(self._id(node.ordinal, suffix).alias("id"), (F.concat(*texts) if texts else F.lit("")).alias("text"), error.alias("error")))

    @staticmethod
    def _id(ordinal: int, suffix: Column) -> Column:
        return F.concat(F.lit(f"p{ordinal}"), suffix)

    def _problem(self, ordinal: int, suffix: Column, code: str) -> Column:
        return F.array(F.struct(self._id(ordinal, suffix).alias("id"), F.lit("").alias("text"), F.lit(code).alias("error")))

    def _value(self, tag: Tag, item, schema) -> tuple[Column, Column]:
        none = F.lit(None).cast("string")
        found = self._lookup(tag.path, item, schema)
        if found is None:
            return none, F.lit("TEMPLATE_VALUE_MISSING")
        column, kind = found
        number = isinstance(kind, T.NumericType)
        fits = {"string": isinstance(kind, T.StringType), "number": number, "boolean": isinstance(kind, T.BooleanType), "date": isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType)), "unknown": number or isinstance(kind, (T.StringType, T.BooleanType))}
        if not fits.get(tag.kind, False):
            return none, F.lit("TEMPLATE_VALUE_TYPE")
        text = column
        for name, argument in tag.formatters:
            if name in ("upper", "lower"):
                text = F.upper(text) if name == "upper" else F.lower(text)
            elif name == "currency":
                text = numbers.currency(text.cast("double"), argument, self.locale)
            else:
                instant = dates.parse_iso(text) if isinstance(kind, T.StringType) else text.cast("timestamp")
                text = dates.format_instant(instant, argument, self.zone)
        if not tag.formatters:
            text = numbers.js_number(column.cast("double")) if number else column.cast("string")
        return text, F.when(text.isNull(), F.lit("TEMPLATE_VALUE_TYPE"))


def render(compiled: Compiled, records: DataFrame, keys: list[str], locale: str = "en-US", zone: str = "UTC", permissive: bool = False) -> DataFrame:
    """keys, ord, id, text, error, severity of every paragraph of every record."""
    column = Renderer(compiled, records.schema, locale, zone, permissive).lines()
    lines = records.select(*keys, F.posexplode(column).alias("ord", "line"))
    severity = F.when(F.col("line.error").isNotNull(), F.lit("warning" if permissive else "error"))
    return lines.select(*keys, "ord", "line.*", severity.alias("severity"))
