"""Form rules as Columns: conditions, visibility, validation, defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "__other__"  # fixed value: the choice that stands for free text


@dataclass(frozen=True)
class Rule:
    key: str
    op: str  # eq neq in not_in is_set is_empty gt lt
    value: object = None


@dataclass(frozen=True)
class Condition:
    rules: tuple[Rule, ...] = ()
    match: str = "all"


@dataclass(frozen=True)
class Question:
    key: str
    label: str
    kind: str
    required: bool = False
    options: tuple[str, ...] | None = None
    allow_other: bool = False
    low: float | None = None
    high: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    include_time: bool = False
    date_range: bool = False
    visible: Condition = field(default_factory=Condition)


def comparable(answer: Column) -> Column:
    """The text an answer is compared by; null for blank and for the other-choice."""
    text = F.trim(answer.cast("string"))
    return F.when(text.isin("", OTHER), F.lit(None)).otherwise(text)


def satisfied(rule: Rule, answers: Mapping[str, Column]) -> Column:
    """Whether one rule holds. A missing answer isn't equal to anything, isn't in any list, and counts as 0 in gt and lt."""
    current = comparable(answers.get(rule.key, F.lit(None).cast("string")))
    if rule.op in ("eq", "neq"):
        same = current.eqNullSafe(F.lit(rule.value)) if isinstance(rule.value, str) else F.lit(False)
        return same & current.isNotNull() if rule.op == "eq" else ~same
    if rule.op in ("in", "not_in"):
        inside = F.coalesce(current.isin(*rule.value), F.lit(False))
        return inside if rule.op == "in" else ~inside
    if rule.op in ("is_set", "is_empty"):
        return current.isNotNull() if rule.op == "is_set" else current.isNull()
    if rule.op in ("gt", "lt"):
        number = F.coalesce(F.when(current.isNull(), 0.0).otherwise(current.try_cast("double")), F.lit(float("nan")))
        ordered = number > rule.value if rule.op == "gt" else number < rule.value
        return F.when(F.isnan(number), False).otherwise(ordered)
    return F.lit(True)


def holds(condition: Condition, answers: Mapping[str, Column]) -> Column:
    """All or any of the rules; no rules always hold."""
    out = None
    for rule in condition.rules:
        one = satisfied(rule, answers)
        out = one if out is None else (out & one if condition.match == "all" else out | one)
    return F.lit(True) if out is None else out


def is_blank(answer: Column) -> Column:
    text = F.trim(answer.cast("string"))
    return answer.isNull() | text.isin("", OTHER)


def problems(question: Question, answer: Column) -> Column:
    """The message for one answer, or null; the last failing bound is reported, a missing required value before all."""
    label, text = question.label, answer.cast("string")
    length = F.length(F.trim(text))
    checks: list[tuple[Column, str]] = []
    if question.kind in ("short_text", "long_text", "select", "autocomplete", "cascader", "reference"):
        if question.options is not None and not question.allow_other:
            checks.append((~text.isin(*question.options), f"{label} has an invalid option"))
        if question.max_length is not None:
            checks.append((length > question.max_length, f"{label} must be at most {question.max_length} characters"))
        if question.min_length is not None:
            checks.append((length < question.min_length, f"{label} must be at least {question.min_length} characters"))
    elif question.kind == "number":
        value = answer.try_cast("double")
        checks.append((value.isNull(), f"{label} must be a number"))
        if question.high is not None:
            checks.append((value > question.high, f"{label} must be at most {question.high:g}"))
        if question.low is not None:
            checks.append((value < question.low, f"{label} must be at least {question.low:g}"))
    elif question.kind == "boolean":
        checks.append((~text.isin("true", "false"), f"{label} must be yes or no"))
    elif question.kind == "date":
        from foliary.functions.dates import is_complete

        message = "needs a start and end date" if question.date_range else "needs a date and time" if question.include_time else "must be a date"
        checks.append((~is_complete(text, question.include_time, question.date_range), f"{label} {message}"))
    out = F.lit(None).cast("string")
    for failed, message in reversed(checks):
        out = F.when(failed, message).otherwise(out)
    missing = F.when(is_blank(answer), F.lit(f"{label} is required")) if question.required else F.lit(None).cast("string")
    return F.coalesce(missing, F.when(answer.isNotNull() & (text != ""), out))


def validate(records: DataFrame, keys: list[str], form: list[Question], answers: Mapping[str, Column]) -> DataFrame:
    """keys, field, message of every failing visible answer."""
    found = F.array(*(F.struct(F.lit(q.key).alias("field"), F.when(holds(q.visible, answers), problems(q, answers[q.key])).alias("message")) for q in form))
    return records.select(*keys, F.explode(F.filter(found, lambda x: x["message"].isNotNull())).alias("e")).select(*keys, "e.*")


def visible_fields(records: DataFrame, keys: list[str], form: list[Question], answers: Mapping[str, Column]) -> DataFrame:
    """keys, field of every visible question."""
    found = F.array(*(F.struct(F.lit(q.key).alias("field"), holds(q.visible, answers).alias("shown")) for q in form))
    return records.select(*keys, F.explode(F.filter(found, lambda x: x["shown"])).alias("e")).select(*keys, "e.field")


def strip_hidden(form: list[Question], answers: Mapping[str, Column]) -> dict[str, Column]:
    """Answers with those of hidden questions set to null."""
    shown = {q.key: holds(q.visible, answers) for q in form}
    return {k: F.when(shown[k], c) if k in shown else c for k, c in answers.items()}


def default_for(question: Question, raw: object, today: str) -> object:
    """A question's default answer; ``today`` is an argument, the clock is never read."""
    if question.kind == "date":
        return today if raw == "today" else raw
    if question.kind == "number":
        try:
            return float(raw)
        except (TypeError, ValueError):
            return None
    if question.kind == "boolean":
        return raw is True or raw == "true"
    if question.kind == "multi_select":
        return [x for x in raw or [] if question.allow_other or x in (question.options or ())]
    if question.kind in ("select", "autocomplete", "cascader") and not question.allow_other and question.options is not None and raw not in question.options:
        return None
    return raw
