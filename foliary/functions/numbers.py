"""Numbers as text, money, units and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE = (1 << 53) - 1
# fixed values: currencies without minor unit, with three digits, and their signs by locale
NO_DIGITS = ("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF")
THREE_DIGITS = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")
SIGNS = {
    "en-US": {"CNY": "CN¥", "EUR": "€", "GBP": "£", "JPY": "¥", "USD": "$"},
    "en-ZA": {"CNY": "CN¥", "EUR": "€", "GBP": "£", "JPY": "JP¥", "USD": "US$", "ZAR": "R"},
}


def locale_of(name: str) -> str | None:
    """The supported locale behind a locale tag."""
    tag = name.strip().replace("_", "-").lower()
    return next((known for known in SIGNS if tag == known.lower() or tag.startswith(f"{known.lower()}-u-")), None)


def fixed(value: Column, digits: int) -> Column:
    """Grouped decimal text of a non-negative double, rounded half up on its exact binary value."""
    halves = value * float(1 << (digits + 1))
    tie = (halves == F.floor(halves)) & (halves % 2 == 1)
    up = F.floor(value * float(10**digits) + 0.5) / float(10**digits)
    return F.format_number(F.when(tie, up).otherwise(value), digits)


def currency(value: Column, code: str, locale: str) -> Column:
    """Money text; null outside the safe integers."""
    known = locale_of(locale)
    if known is None:
        raise ValueError(f"locale {locale} isn't supported")
    digits = 0 if code in NO_DIGITS else 3 if code in THREE_DIGITS else 2
    amount = fixed(F.abs(value), digits)
    if known == "en-ZA":
        amount = F.translate(amount, ",.", " ,")
    sign = SIGNS[known].get(code)
    label = (sign or code) + (" " if sign is None or known == "en-ZA" else "")
    # the text of a negative zero begins with a minus, too
    minus = F.when((value < 0) | value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(~F.isnan(value) & (F.abs(value) <= MAX_SAFE), F.concat(minus, F.lit(label), amount))


def js_number(value: Column) -> Column:
    """A double as JavaScript prints it: no trailing ``.0``, plain digits from 1e-6 up to 1e21."""
    text = value.cast("string")
    shape = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    tail, power = F.regexp_replace(part(3), "0+$", ""), part(4).cast("int")
    spread = F.when(F.length(tail) <= power, F.concat(part(2), F.rpad(tail, power, "0"))).otherwise(F.concat(part(2), F.substring(tail, F.lit(1), power), F.lit("."), F.substring(tail, power + 1, F.length(tail))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), part(2), tail)
    scientific = F.concat(part(2), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(F.lit("")), F.when(power > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(power).cast("string"))
    exponent = F.concat(part(1), F.when((power >= 0) & (power < 21), spread).when((power < 0) & (power >= -6), small).otherwise(scientific))
    plain = F.when(value == 0, F.lit("0")).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return F.when(text.rlike(shape), exponent).otherwise(plain)


def js_round(value: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(value + 0.5).cast("long")


def points_to_twips(points: Column) -> Column:
    return js_round(points * 20)


def twips_to_points_text(twips: Column) -> Column:
    """Exact decimal text of a twentieth."""
    cents = F.abs(twips) * 5
    whole, rest = F.floor(cents / 100).cast("long"), (cents % 100).cast("long")
    digits = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 2, "0"), "0$", "")))
    return F.concat(F.when(twips < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), digits)


def script_size(size: Column) -> Column:
    return js_round(size * 2 / 3)


def script_shift(size: Column, vertical: Column) -> Column:
    return F.when(vertical == "superscript", -js_round(size / 3)).when(vertical == "subscript", js_round(size / 6)).otherwise(F.lit(0).cast("long"))


def line_height(natural: Column, rule: Column, value: Column) -> Column:
    """Height of a line under its spacing rule, one at least."""
    ruled = F.when(rule == "auto", js_round(natural * value / 240)).when(rule == "exact", value).when(rule == "atLeast", F.greatest(natural, value)).otherwise(natural)
    return F.greatest(F.lit(1), ruled).cast("long")


def aligned_x(align: Column, left: Column, box: Column, width: Column) -> Column:
    room = F.greatest(F.lit(0), box - width)
    return (left + F.when(align == "right", room).when(align == "center", F.floor(room / 2)).otherwise(0)).cast("long")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return js_round((r * 299 + g * 587 + b * 114) / 1000)


def fit(width: Column, height: Column, ratio_width: Column, ratio_height: Column) -> Column:
    """(width, height) shrunk on one side to a ratio, one at least."""
    wide = width * ratio_height > height * ratio_width
    w = F.when(wide, F.greatest(F.lit(1), js_round(height * ratio_width / ratio_height))).otherwise(width)
    h = F.when(wide, height).otherwise(F.greatest(F.lit(1), js_round(width * ratio_height / ratio_width)))
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
