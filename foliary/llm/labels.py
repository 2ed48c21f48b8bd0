"""Labelled rows for the classifiers.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: no classifier sees
their labels. A null doc_id counts as the empty text (held out). A training
sample is bounded by a hash threshold on doc_id, so it is the same however the
rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(labels: DataFrame, target: str) -> DataFrame:
    """doc_id, y: usable labels of rows that aren't held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))


def bounded(rows: DataFrame, bound: int, count: int | None = None, *key: str) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key`` (of doc_id)."""
    n = rows.count() if count is None else count
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(*(key or ("doc_id",)), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def bounded_rows(rows: DataFrame, bound: int, *key: str) -> DataFrame:
    """One row of each ``key``, and of those about a quarter more than ``bound`` at most.

    For rows that met a bounded sample of doc_ids, of which one may have any number of them.
    """
    single = rows.dropDuplicates(list(key))
    n = single.count()
    return single if n <= bound * 1.25 else bounded(single, bound, n, *key)
