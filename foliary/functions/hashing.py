"""Content hashes and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def framed(*fields: Column) -> Column:
    """Fields as bytes, each after its length as four big-endian bytes, so that no two lists of fields run together."""
    parts = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(f)), 8, "0")), F.encode(f, "UTF-8")) for f in fields]
    return F.concat(*parts)


def cache_identity(*fields: Column) -> Column:
    return F.sha2(framed(*fields), 256)


def canonical_json(entries: Column) -> Column:
    """JSON text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
