"""String functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = ("__proto__", "prototype", "constructor")  # fixed values: names that no path may use


def _accent_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII character plus marks, and that character."""
    source, target = [], []
    for point in range(0xA0, 0x2000):
        parts = [c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)]
        if len(parts) == 1 and ord(parts[0]) < 128 and parts[0] != chr(point):
            source.append(chr(point))
            target.append(parts[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def without_accents(text: Column) -> Column:
    """Decompose Latin letters and drop their marks."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}", "")


def slugify(label: Column, empty: str = "field") -> Column:
    """A property key made from a label."""
    plain = F.lower(F.regexp_replace(without_accents(label), "['’]", ""))
    slug = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9$]+", "_"), "^_+|_+$", "")
    slug = F.when(slug == "", F.lit(empty)).otherwise(slug)
    slug = F.when(slug.rlike("^[A-Za-z_$]"), slug).otherwise(F.concat(F.lit(f"{empty}_"), slug))
    return F.when(slug.isin(*RESERVED), F.concat(slug, F.lit(f"_{empty}"))).otherwise(slug)


def option_slug(label: Column, ordinal: Column) -> Column:
    """An ASCII slug for a choice; ``option_n`` where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.concat(F.lit("option_"), ordinal.cast("string"))).otherwise(slug)


def prettify(key: Column) -> Column:
    """Words of a dotted or underscored key, each with its first character in upper case."""
    words = F.filter(F.split(key, "[._]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def is_valid_key(key: Column) -> Column:
    return key.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$") & ~key.isin(*RESERVED)


def path_error(path: Column, max_depth: int = 32) -> Column:
    """The first reason why a dotted path is refused, else null."""
    segments = F.split(path, r"\.")
    shaped = F.forall(segments, lambda s: s.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$"))
    unsafe = F.exists(segments, lambda s: s.isin(*RESERVED))
    return F.when(~shaped, "TEMPLATE_INVALID_EXPRESSION").when(unsafe, "TEMPLATE_UNSAFE_PATH").when(F.size(segments) > max_depth, "TEMPLATE_EXPRESSION_LIMIT")


def bullets(text: Column) -> Column:
    """Hyphens that begin a line become bullet signs."""
    return F.regexp_replace(text, r"(?m)^(\s*)- ", "$1• ")


def normalise_spaces(text: Column) -> Column:
    """No-break spaces count as spaces; runs of white space become one; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, " ", " "), r"\s+", " "))


def normalise_family(family: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(family, r"[ \t\r\n\f]+", " ")))


def tokens(text: Column) -> Column:
    """Line breaks, runs of blanks, and runs of anything else, in order."""
    return F.regexp_extract_all(text, F.lit(r"\r\n|\r|\n|[\t ]+|[^\r\n\t ]+"), F.lit(0))


def split_pipes(body: Column) -> Column:
    """Parts of a tag body between pipes outside quotes; null where quotes are unbalanced or hold a backslash."""
    quoted = r"""(?:"[^"\\]*"|'[^'\\]*'|[^"'|])"""
    parts = F.transform(F.regexp_extract_all(F.concat(body, F.lit("|")), F.lit(rf"({quoted}*)\|"), F.lit(1)), lambda p: F.trim(p))
    return F.when(body.rlike(rf"^(?:{quoted}|\|)*$"), parts)


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_pdf_literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_at(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(F.substring_index(before, "\n", -1)) + 1).cast("int")


def count_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\r?\n")))


def excerpt(text: Column, at: Column, before: int = 40, after: int = 80) -> Column:
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at + after - start)


def find_all(text: Column, needle: str) -> Column:
    """0-based starts of the occurrences of a literal that don't overlap."""
    parts = F.split(text, F.lit("\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"))
    widths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    return F.aggregate(widths, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end")), lambda s, w: F.struct(F.array_append(s["at"], s["end"] + w).alias("at"), (s["end"] + w + len(needle)).alias("end")), lambda s: s["at"])


def sanitise_markup(text: Column) -> Column:
    """Drop doctypes, active elements, event attributes and links that leave the document."""
    # fixed values: the patterns and the elements that can run or load something
    out = F.regexp_replace(text, "^\ufeff", "")
    out = F.regexp_replace(out, r"(?is)<!(?:DOCTYPE|ENTITY).*?>", "")
    for name in ("script", "foreignobject", "handler", "animate", "animatetransform", "animatemotion", "set", "audio", "video", "iframe", "object", "embed"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*(?:/>|>.*?</{name}\s*>)", "")
    out = F.regexp_replace(out, r"""\s(?:[oO][nN][a-zA-Z]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "")
    for quote in ('"', "'"):
        out = F.regexp_replace(out, rf"(?i)\s(?:xlink:)?href\s*=\s*{quote}\s*(?:javascript:|data:text/html|https?:|//|file:)[^{quote}]*{quote}", f" href={quote}{quote}")
    return out


def is_safe_part_path(path: Column) -> Column:
    """Relative, without backslash, NUL, or an empty or dotted segment."""
    return ~path.startswith("/") & ~path.contains("\\") & ~path.contains("\u0000") & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def continue_bullet(text: str, at: int) -> tuple[str, int]:
    """Text and place after Enter at ``at``: a list goes on with its bullet; Enter on an empty bullet ends it."""
    start = text.rfind("\n", 0, at) + 1
    line = text[start:at]
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    mark = line[len(lead) : len(lead) + 2]
    if mark not in ("• ", "- "):
        return text[:at] + "\n" + text[at:], at + 1
    if line[len(lead) + 2 :].strip() == "":
        return text[:start] + text[at:], start
    added = f"\n{lead}• "
    return text[:at] + added + text[at:], at + len(added)
