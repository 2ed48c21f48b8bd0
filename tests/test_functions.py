"""Scalar functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from foliary.functions import counters, dates, measure, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "code", "locale", "expected"),
    [
        (1234.5, "ZAR", "en-ZA", "R\u00a01\u00a0234,50"), (1.005, "USD", "en-US", "$1.00"), (0.125, "USD", "en-US", "$0.13"), (-0.0, "USD", "en-US", "-$0.00"), (2.5, "JPY", "en-US", "¥3"),
        (1e6, "CHF", "en_us", "CHF\u00a01,000,000.00"), (-5.0, "USD", "en-ZA", "-US$\u00a05,00"), (1.0, "BHD", "en-US", "BHD\u00a01.000"), (1e300, "USD", "en-US", None),
    ],
)
def test_currency(spark, value, code, locale, expected):
    assert one(spark, numbers.currency(F.lit(value), code, locale)) == expected


@pytest.mark.parametrize(("value", "expected"), [(23.0, "23"), (1e7, "10000000"), (1.5e10, "15000000000"), (1e21, "1e+21"), (1.25e-7, "1.25e-7"), (0.000001, "0.000001"), (-1234.5, "-1234.5"), (0.0, "0"), (-0.0, "0"), (123456789.125, "123456789.125")])
def test_js_number(spark, value, expected):
    assert one(spark, numbers.js_number(F.lit(value))) == expected


@pytest.mark.parametrize(("label", "expected"), [("Café del Mar", "cafe_del_mar"), ("it's", "its"), ("--", "field"), ("9 lives", "field_9_lives"), ("constructor", "constructor_field"), ("Ünïcode Straße", "unicode_stra_e")])
def test_slug(spark, label, expected):
    assert one(spark, text.slugify(F.lit(label))) == expected


def test_other_text(spark):
    assert one(spark, text.prettify(F.lit("first_name.lastPart"))) == "First Name LastPart"
    assert one(spark, text.find_all(F.lit("aXbXc"), "X")) == [1, 3]
    assert one(spark, text.split_pipes(F.lit("a | b:\"x|y\" | c"))) == ["a", 'b:"x|y"', "c"]
    assert one(spark, text.split_pipes(F.lit("a | 'x"))) is None
    assert one(spark, text.sanitise_markup(F.lit('<a onclick="x()" href="https://x">t</a><script>1</script>'))) == '<a href="">t</a>'
    assert one(spark, text.tokens(F.lit("a b\r\nc"))) == ["a", " ", "b", "\r\n", "c"]
    assert one(spark, text.bullets(F.lit("- a\n  - b"))) == "• a\n  • b"


@pytest.mark.parametrize(("value", "roman", "letter"), [(0, "", ""), (1, "I", "a"), (4, "IV", "d"), (26, "XXVI", "z"), (27, "XXVII", "aa"), (702, "DCCII", "zz"), (703, "DCCIII", "aaa"), (1994, "MCMXCIV", "bxr")])
def test_counters(spark, value, roman, letter):
    assert one(spark, counters.roman(F.lit(value))) == roman
    assert one(spark, counters.letters(F.lit(value))) == letter


@pytest.mark.parametrize(("pattern", "good"), [("yyyy-MM-dd", True), ("d MMMM yy h:mm a", True), ("yyyy-MM", False), ("dd/MM/yyyy HH:ss", False), ("yyyy-MM-dd HH a", False), ("", False), ("yyyy-MM-dd QQ", False)])
def test_date_patterns(pattern, good):
    assert dates.check_pattern(pattern) is good


def test_dates(spark):
    assert one(spark, dates.format_instant(dates.parse_iso(F.lit("2026-03-01T22:30:00Z")), "dd MMM yyyy HH:mm", "Africa/Johannesburg")) == "02 Mar 2026 00:30"
    assert one(spark, dates.parse_iso(F.lit("2026-03-01 22:30:00"))) is None
    assert one(spark, dates.wall_to_instant(F.lit("2026-03-29 02:30:00").cast("timestamp"), "Europe/Berlin")) is None


def test_widths(spark):
    assert one(spark, measure.width(F.lit("Ai m"))) == 667 + 222 + 278 + 833
    assert one(spark, numbers.twips_to_points_text(F.lit(-25))) == "-1.25"
