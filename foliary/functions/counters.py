"""List counters and label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("bullet", "decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman")


def roman(value: Column) -> Column:
    """Digit by digit; thousands repeat. Nothing for zero."""

    def digit(power: int, one: str, five: str, ten: str) -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), (F.floor(value / power) % 10 + 1).cast("int"))

    thousands = F.repeat(F.lit("M"), F.floor(value / 1000).cast("int"))
    return F.when(value > 0, F.concat(thousands, digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))).otherwise(F.lit(""))


def letters(value: Column) -> Column:
    """a..z, aa..: bijective base 26. Nothing for zero."""
    step = lambda s, _: F.when(s["left"] > 0, F.struct(F.concat(F.char(F.lit(97) + (s["left"] - 1) % 26), s["text"]).alias("text"), F.floor((s["left"] - 1) / 26).cast("long").alias("left"))).otherwise(s)
    start = F.struct(F.lit("").alias("text"), value.cast("long").alias("left"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["text"])


def counter(value: Column, form: Column) -> Column:
    return (
        F.when(form == "bullet", F.lit("•")).when(form == "decimal", value.cast("string"))
        .when(form == "lowerLetter", letters(value)).when(form == "upperLetter", F.upper(letters(value)))
        .when(form == "lowerRoman", F.lower(roman(value))).when(form == "upperRoman", roman(value))
    )


def level_text(template: Column, labels: list[Column]) -> Column:
    """%1 .. %9 replaced by the counters' texts."""
    for i, label in enumerate(labels, 1):
        template = F.replace(template, F.lit(f"%{i}"), F.coalesce(label, F.lit("")))
    return template
