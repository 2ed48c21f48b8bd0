"""Paths into nested data and choice trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get_path(json: Column, path: str) -> Column:
    """The value at ``a.b[0].c`` of a JSON text, as text."""
    return F.get_json_object(json, f"$.{path}")


def pointer_to_path(pointer: Column) -> Column:
    """A JSON pointer as a concrete path: numbers become indexes."""
    parts = F.slice(F.split(pointer, "/"), 2, F.size(F.split(pointer, "/")))
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    marked = F.transform(plain, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("."), p)))
    return F.regexp_replace(F.array_join(marked, ""), r"^\.", "")


def concrete_path(path: Column, indexes: Column) -> Column:
    """Each ``[]`` of a canonical path filled with the next index."""

    def fill(p, i):
        head = F.substring_index(p, "[]", 1)
        return F.concat(head, F.lit("["), i.cast("string"), F.lit("]"), F.substring(p, F.length(head) + 3, F.length(p)))

    return F.aggregate(indexes, path, fill)


def add_item(items: Column, item: Column) -> Column:
    return F.array_append(items, item)


def remove_item(items: Column, at: Column) -> Column:
    return F.filter(items, lambda _, i: i != at)


def flat_options(text: Column) -> Column:
    """One option a line: trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def option_tree(text: str) -> list[tuple[str, str | None, str]]:
    """(value, parent, label) of an indented list, two spaces or a tab a level; values are paths of slugs."""
    import re

    out, stack = [], []
    for line in text.splitlines():
        if not line.strip():
            continue
        lead = line[: len(line) - len(line.lstrip(" \t"))].replace("\t", "  ")
        depth = min(len(lead) // 2, len(stack))
        slug = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", line.strip().lower())) or f"option_{len(out) + 1}"
        stack = stack[:depth]
        parent = stack[-1] if stack else None
        value = slug if parent is None else f"{parent}/{slug}"
        stack.append(value)
        out.append((value, parent, line.strip()))
    return out


def option_text(nodes: list[tuple[str, str | None, str]]) -> str:
    """The indented list of a choice tree."""
    return "\n".join("  " * value.count("/") + label for value, _, label in nodes)


def placeholder(slug: Column, kind: Column) -> Column:
    """The tag of a value; dates carry a formatter."""
    return F.when(kind == "date", F.concat(F.lit("{{"), slug, F.lit(":date | date}}"))).when(kind.isin("string", "number", "boolean"), F.concat(F.lit("{{"), slug, F.lit(":"), kind, F.lit("}}"))).otherwise(F.concat(F.lit("{{"), slug, F.lit("}}")))


def stored_date(answer: Column, include_time: bool, date_range: bool) -> Column:
    """A stored date answer cut down to the parts a question has now."""
    parts = F.split(answer, "/")
    kept = F.slice(parts, 1, 2 if date_range else 1)
    return F.array_join(F.transform(kept, lambda p: p if include_time else F.substring_index(p, "T", 1)), "/")


def set_path(data: Column, path: str, value: Column) -> Column:
    """A struct with the field at a dotted path replaced; nothing else changes."""
    return data.withField(path, value)


def schema_problems(compiled, schema) -> list[tuple[str, str]]:
    """(path, problem) of the fields of a template that a record schema can't give."""
    from pyspark.sql import types as T

    fits = {"string": T.StringType, "number": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "date": (T.StringType, T.TimestampType, T.TimestampNTZType), "image": T.StructType}
    out = []
    for f in compiled.fields:
        kind = schema
        for name in f.path.replace("[]", ".[]").split("."):
            if name == "[]":
                kind = kind.elementType if isinstance(kind, T.ArrayType) else None
            else:
                kind = kind[name].dataType if isinstance(kind, T.StructType) and name in kind.fieldNames() else None
            if kind is None:
                break
        if kind is None:
            out.append((f.path, "TEMPLATE_VALUE_MISSING"))
        elif f.kind in fits and not isinstance(kind, fits[f.kind]):
            out.append((f.path, "TEMPLATE_VALUE_TYPE"))
    return out
