"""The template language: parsing and analysis, on the driver.

A template is a list of paragraphs. A paragraph that is only ``{{#if p}}``,
``{{#each p}}``, ``{{else}}``, ``{{/if}}`` or ``{{/each}}`` is a marker; any other
text may hold value tags: ``{{path[:type] [| formatter]*}}`` or ``{{@image path}}``.
Analysis gives the tree, the fields with their kinds, a JSON Schema and starter
data, and diagnostics; nothing is raised for a faulty template.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from foliary.functions.dates import DEFAULT_PATTERN, check_pattern
from foliary.functions.text import RESERVED

MAX_DEPTH = 32
KINDS = ("string", "number", "boolean", "date")
# fixed values: the grammar of paths, values, markers and quoted arguments, and the image tags that are refused
_SEGMENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_PATH = r"[A-Za-z_$][A-Za-z0-9_$.]*"
_VALUE = re.compile(rf"({_PATH})(?:\s*:\s*([A-Za-z]+))?")
MARKER = re.compile(rf"\{{\{{\s*(?:#(if|each)\s+({_PATH})|(else)|/(if|each))\s*\}}\}}")
_QUOTED = re.compile(r"""(["'])([^"']*)\1""")
_OLD_IMAGE = re.compile(r"image(?:\s|:|\()|.*:\s*image(?:\s*\|.*)?$", re.I | re.S)


@dataclass(frozen=True)
class Problem:
    code: str
    paragraph: int
    severity: str = "error"


@dataclass(frozen=True)
class Tag:
    path: str
    kind: str
    explicit: bool
    formatters: tuple[tuple[str, str], ...] = ()


@dataclass
class Paragraph:
    ordinal: int
    pieces: list[str | Tag]


@dataclass
class Branch:
    """An ``if``."""

    ordinal: int
    path: str
    then: list = field(default_factory=list)
    other: list = field(default_factory=list)
    has_else: bool = False


@dataclass
class Loop:
    """An ``each``."""

    ordinal: int
    path: str
    body: list = field(default_factory=list)


@dataclass
class Field:
    path: str
    kinds: set[str] = field(default_factory=set)
    paragraphs: list[int] = field(default_factory=list)
    formatters: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        known = sorted(self.kinds - {"unknown"})
        return known[0] if len(known) == 1 else "unknown"


@dataclass
class Compiled:
    nodes: list
    fields: list[Field]
    problems: list[Problem]

    @property
    def ok(self) -> bool:
        return not any(p.severity == "error" for p in self.problems)


def path_problem(path: str) -> str | None:
    parts = path.split(".")
    if not all(_SEGMENT.fullmatch(p) for p in parts):
        return "TEMPLATE_INVALID_EXPRESSION"
    if any(p in RESERVED for p in parts):
        return "TEMPLATE_UNSAFE_PATH"
    return "TEMPLATE_EXPRESSION_LIMIT" if len(parts) > MAX_DEPTH else None


def split_formatters(body: str) -> list[str] | None:
    """Parts between pipes outside quotes; None for unbalanced quotes or a backslash in quotes."""
    unit = r"""(?:"[^"\\]*"|'[^'\\]*'|[^"'|])*"""
    if not re.fullmatch(rf"{unit}(?:\|{unit})*", body, re.S):
        return None
    return [m[0].strip() for m in re.finditer(rf"(?:(?<=^)|(?<=\|)){unit}", body, re.S)]


def parse_formatter(text: str) -> tuple[str, str, str] | str:
    """(name, argument, kind it works on), or a problem's code."""
    m = re.fullmatch(r"([A-Za-z]+)(?:\s*:\s*(.*))?", text, re.S)
    name, argument = (m[1].lower(), m[2]) if m else (None, None)
    if name in ("upper", "lower"):
        return "TEMPLATE_FORMATTER_ARGUMENT" if argument is not None else (name, "", "string")
    if name not in ("currency", "date"):
        return "TEMPLATE_UNKNOWN_FORMATTER"
    if argument is None:
        return (name, DEFAULT_PATTERN, "date") if name == "date" else "TEMPLATE_FORMATTER_ARGUMENT"
    quoted = _QUOTED.fullmatch(argument.strip())
    fits = re.compile(r"[A-Z]{3}").fullmatch if name == "currency" else check_pattern
    if quoted is None or not fits(quoted[2]):
        return "TEMPLATE_FORMATTER_ARGUMENT"
    return name, quoted[2], "number" if name == "currency" else "date"


def parse_value(raw: str) -> Tag | str:
    """A value tag, or a problem's code; the first failing check wins."""
    body = raw.strip()
    if body[:1] in ("#", "/") or body == "else" or body.startswith("else "):
        return "TEMPLATE_BLOCK_MARKER_PLACEMENT"
    if _OLD_IMAGE.match(body):
        return "TEMPLATE_UNSUPPORTED_IMAGE_TAG"
    if body.startswith("@image"):
        m = re.fullmatch(rf"@image\s+({_PATH})", body)
        return "TEMPLATE_INVALID_IMAGE_TAG" if m is None else path_problem(m[1]) or Tag(m[1], "image", True)
    if body.startswith("@"):
        return "TEMPLATE_INVALID_EXPRESSION"
    parts = split_formatters(body)
    if parts is None:
        return "TEMPLATE_MALFORMED_QUOTE"
    m = _VALUE.fullmatch(parts[0])
    if m is None or not all(parts[1:]):
        return "TEMPLATE_INVALID_EXPRESSION"
    if problem := path_problem(m[1]):
        return problem
    declared = m[2].lower() if m[2] else None
    if declared is not None and declared not in KINDS:
        return "TEMPLATE_INVALID_EXPRESSION"
    needed, formatters = None, []
    for text in parts[1:]:
        parsed = parse_formatter(text)
        if isinstance(parsed, str):
            return parsed
        name, argument, kind = parsed
        if needed not in (None, kind):
            return "TEMPLATE_FORMATTER_TYPE"
        needed = kind
        formatters.append((name, argument))
    if needed and declared not in (None, needed):
        return "TEMPLATE_FORMATTER_TYPE"
    return Tag(m[1], needed or declared or "unknown", declared is not None, tuple(formatters))


def parse_paragraph(text: str, ordinal: int, problems: list[Problem]) -> Paragraph:
    """Text and tags in turn; a faulty tag stays as text."""
    pieces: list[str | Tag] = []
    at = 0
    while (start := text.find("{{", at)) >= 0:
        pieces.append(text[at:start])
        end, inner = text.find("}}", start + 2), text.find("{{", start + 2)
        if end < 0 or 0 <= inner < end:
            problems.append(Problem("TEMPLATE_MALFORMED_TAG", ordinal))
            to = len(text) if end < 0 and inner < 0 else inner if inner >= 0 and (end < 0 or inner < end) else end + 2
            pieces.append(text[start:to])
            at = to
            continue
        parsed = parse_value(text[start + 2 : end])
        if isinstance(parsed, str):
            problems.append(Problem(parsed, ordinal))
            pieces.append(text[start : end + 2])
        else:
            pieces.append(parsed)
        at = end + 2
    rest = text[at:]
    if "}}" in rest:
        problems.append(Problem("TEMPLATE_MALFORMED_TAG", ordinal))
    pieces.append(rest)
    return Paragraph(ordinal, [p for p in pieces if p != ""])


def compile_template(paragraphs: list[str]) -> Compiled:
    """Tree, fields and diagnostics of a template."""
    problems: list[Problem] = []
    root: list = []
    stack: list[tuple[object, list]] = []
    into = root
    for ordinal, text in enumerate(paragraphs):
        m = MARKER.fullmatch(text.strip())
        if m is None:
            into.append(parse_paragraph(text, ordinal, problems))
            continue
        opened, path, other, closed = m.groups()
        if opened:
            if problem := path_problem(path):
                problems.append(Problem(problem, ordinal))
            node = Branch(ordinal, path) if opened == "if" else Loop(ordinal, path)
            into.append(node)
            stack.append((node, into))
            into = node.then if opened == "if" else node.body
            if len(stack) > MAX_DEPTH:
                problems.append(Problem("TEMPLATE_EXPRESSION_LIMIT", ordinal))
        elif other:
            node = stack[-1][0] if stack else None
            if not isinstance(node, Branch):
                problems.append(Problem("TEMPLATE_UNBALANCED_BLOCK", ordinal))
            elif node.has_else:
                problems.append(Problem("TEMPLATE_DUPLICATE_ELSE", ordinal))
            else:
                node.has_else, into = True, node.other
        else:
            node = stack[-1][0] if stack else None
            if not isinstance(node, Branch if closed == "if" else Loop):
                problems.append(Problem("TEMPLATE_UNBALANCED_BLOCK", ordinal))
            else:
                into = stack.pop()[1]
    problems += [Problem("TEMPLATE_UNCLOSED_BLOCK", node.ordinal) for node, _ in stack]
    fields = manifest(root)
    problems += [Problem("TEMPLATE_TYPE_CONFLICT", f.paragraphs[0]) for f in fields if len(f.kinds - {"unknown"}) > 1]
    paths = {f.path: f for f in fields}
    for f in fields:
        for other in paths:
            if other.startswith(f"{f.path}.") and not f.kinds & {"array", "object", "unknown"}:
                problems.append(Problem("TEMPLATE_PATH_CONFLICT", paths[other].paragraphs[0]))
    return Compiled(root, fields, sorted(problems, key=lambda p: (p.paragraph, p.code)))


def manifest(nodes: list) -> list[Field]:
    """Every field by its canonical path (``items[].name`` inside a loop), in order of path."""
    found: dict[str, Field] = {}

    def add(path: str, kind: str, ordinal: int, formatters=()):
        f = found.setdefault(path, Field(path))
        f.kinds.add(kind)
        if ordinal not in f.paragraphs:
            f.paragraphs.append(ordinal)
        f.formatters += [n for n, _ in formatters if n not in f.formatters]

    def walk(nodes: list, base: str):
        for node in nodes:
            if isinstance(node, Paragraph):
                for piece in node.pieces:
                    if isinstance(piece, Tag):
                        add(base + piece.path, piece.kind, node.ordinal, piece.formatters)
            elif isinstance(node, Branch):
                add(base + node.path, "boolean", node.ordinal)
                walk(node.then, base)
                walk(node.other, base)
            else:
                add(base + node.path, "array", node.ordinal)
                walk(node.body, f"{base}{node.path}[].")

    walk(nodes, "")
    return [found[k] for k in sorted(found)]


def _nested(fields: list[Field]) -> dict:
    """Fields as a tree of names; an array's items under ``[]``."""
    tree: dict = {}
    for f in fields:
        at = tree
        for name in f.path.replace("[]", ".[]").split("."):
            at = at.setdefault(name, {})
        at[""] = f.kind
    return tree


def json_schema(compiled: Compiled) -> dict:
    """JSON Schema (2020-12) of the data a template needs: all required, nothing more allowed."""
    leaf = {"string": {"type": "string"}, "number": {"type": "number"}, "boolean": {"type": "boolean"}, "date": {"type": "string", "format": "date-time"}, "image": {"type": "object"}, "unknown": {"type": ["string", "number", "boolean"]}}

    def build(tree: dict) -> dict:
        names = sorted(k for k in tree if k not in ("", "[]"))
        if "[]" in tree or tree.get("") == "array":
            return {"type": "array", "items": build(tree.get("[]", {}))}
        if names or "" not in tree:
            return {"type": "object", "properties": {n: build(tree[n]) for n in names}, "required": names, "additionalProperties": False}
        return leaf[tree[""]]

    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | build(_nested(compiled.fields))


def starter_data(compiled: Compiled):
    """Data of the right shape: lists of one item, typed zeros, the epoch."""
    zero = {"string": "", "number": 0, "boolean": False, "date": "1970-01-01T00:00:00.000Z", "image": {}, "unknown": ""}

    def build(tree: dict):
        names = sorted(k for k in tree if k not in ("", "[]"))
        if "[]" in tree or tree.get("") == "array":
            return [build(tree.get("[]", {}))]
        return {n: build(tree[n]) for n in names} if names or "" not in tree else zero[tree[""]]

    return build(_nested(compiled.fields))
