"""Text widths by the standard face's character classes, in thousandths of the size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes and their widths, the first that fits counts
CLASSES = (
    (" ", 278),
    ("ilI.,'`!|:;", 222),
    ("mwMW@%&", 833),
    ("fjrt()[]{}", 333),
    ("-_=+<>~", 584),
    ("0123456789", 556),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 667),
    ("abcdefghijklmnopqrstuvwxyz", 500),
)
OTHER = 556


def class_widths(size: int = 1000) -> list[tuple[str, int]]:
    """Disjoint classes and the width of one of their characters at a size, rounded."""
    seen, out = set(), []
    for chars, width in CLASSES:
        own = "".join(c for c in chars if c not in seen)
        seen |= set(own)
        out.append((own, int(width * size / 1000 + 0.5)))
    return out


def width(text: Column, size: int = 1000) -> Column:
    """Width of a text: every character is rounded by itself."""
    total = F.lit(0)
    left = F.length(text)
    for chars, units in class_widths(size):
        count = F.length(text) - F.length(F.translate(text, chars, ""))
        total, left = total + count * units, left - count
    return (total + left * int(OTHER * size / 1000 + 0.5)).cast("long")


def char_width(char: str, size: int = 1000) -> int:
    return next((w for chars, w in class_widths(size) if char in chars), int(OTHER * size / 1000 + 0.5))
