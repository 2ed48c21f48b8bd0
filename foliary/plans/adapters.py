"""Forms to and from flat field lists, and from template fields. What a flat list can't say is a warning, not an error."""

from __future__ import annotations

from foliary.plans.rules import Condition, Question, Rule
from foliary.plans.template import Field

#: Question kinds and the flat kinds that stand for them.
FLAT = {"short_text": "text", "long_text": "textarea", "number": "number", "boolean": "checkbox", "date": "date", "select": "dropdown", "autocomplete": "dropdown", "cascader": "dropdown", "multi_select": "checkboxes"}
_BACK = {"text": "short_text", "textarea": "long_text", "number": "number", "checkbox": "boolean", "date": "date", "dropdown": "select", "checkboxes": "multi_select"}
_OPS = {"eq": "is", "neq": "is not", "is_set": "is filled", "is_empty": "is blank"}


def to_fields(form: list[Question]) -> tuple[list[dict], list[tuple[str, str]]]:
    """Flat fields, and (key, code) of what was lost: kinds, conditions and the levels of options."""
    fields, lost = [], []
    for q in form:
        kind = FLAT.get(q.kind)
        if kind is None:
            lost.append((q.key, "UNREPRESENTABLE_KIND"))
            continue
        field = {"key": q.key, "label": q.label, "kind": kind, "required": q.required}
        if q.options is not None:
            if any("/" in o for o in q.options):
                lost.append((q.key, "NESTED_OPTIONS_FLATTENED"))
            field["options"] = [o.rpartition("/")[2] for o in q.options]
        known = [r for r in q.visible.rules if r.op in _OPS]
        if q.visible.rules and not known:
            lost.append((q.key, "UNREPRESENTABLE_CONDITION"))
        elif q.visible.rules:
            if len(q.visible.rules) > 1:
                lost.append((q.key, "CONDITION_SIMPLIFIED"))
            field["show_if"] = (known[0].key, _OPS[known[0].op], known[0].value)
        fields.append(field)
    return fields, lost


def from_fields(fields: list[dict]) -> list[Question]:
    """Questions of flat fields; an unknown kind becomes a short text."""
    back = {v: k for k, v in _OPS.items()}
    out = []
    for f in fields:
        shown = Condition((Rule(f["show_if"][0], back[f["show_if"][1]], f["show_if"][2]),)) if f.get("show_if") else Condition()
        out.append(Question(f["key"], f["label"], _BACK.get(f["kind"], "short_text"), required=bool(f.get("required")), options=tuple(f["options"]) if "options" in f else None, visible=shown))
    return out


def questions_from_fields(fields: list[Field]) -> list[Question]:
    """A question for each value of a template; lists and what lies in them are left to repeaters."""
    from foliary.functions.text import RESERVED

    kinds = {"string": "short_text", "unknown": "short_text", "number": "number", "boolean": "boolean", "date": "date"}
    label = lambda path: " ".join(w[:1].upper() + w[1:] for w in path.replace("_", ".").split(".") if w)
    return [Question(f.path, label(f.path), kinds[f.kind]) for f in fields if "[]" not in f.path and f.kind in kinds and f.path not in RESERVED]
