"""Display items: borders, layers, runs, page fields, headers, and table fragments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAGMENTS = "doc_id long, page int, row_no int, from_height long, to_height long, top long, repeated boolean"


def border_lines(edges: DataFrame) -> DataFrame:
    """Edges with one row for each line to draw: ``offset``, ``line_width``, ``dash``, ``cap``.

    Dotted lines are at least 20 wide and have round caps; dashes are four widths
    and two; a double border is two lines, one width to either side.
    """
    w = F.col("width")
    dots = F.ceil(F.greatest(w, F.lit(20)) / 20).cast("long") * 20
    none = F.array().cast("array<bigint>")
    line = lambda offset, width, dash, cap: F.struct(offset.cast("long").alias("offset"), width.cast("long").alias("line_width"), dash.alias("dash"), F.lit(cap).alias("cap"))
    lines = (
        F.when(F.col("style") == "single", F.array(line(F.lit(0), w, none, "butt")))
        .when(F.col("style") == "dotted", F.array(line(F.lit(0), dots, F.array(F.lit(1).cast("long"), F.greatest(F.lit(20).cast("long"), dots * 2 - 1)), "round")))
        .when(F.col("style") == "dashed", F.array(line(F.lit(0), w, F.array((w * 4).cast("long"), (w * 2).cast("long")), "butt")))
        .when(F.col("style") == "double", F.array(line(-w, w, none, "butt"), line(w, w, none, "butt")))
    )
    return edges.select("*", F.explode(lines).alias("l")).select(*edges.columns, "l.*")


def layered(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``z`` of items: shading below text below borders, else in order."""
    layer = F.when(F.col("type") == "rectangle", 0).when(F.col("type") == "line", 2).otherwise(1)
    return items.withColumn("z", F.row_number().over(Window.partitionBy(*keys).orderBy(layer, *order)) - 1)


def merge_runs(clusters: DataFrame, keys: list[str], order: str, style: list[str]) -> DataFrame:
    """keys, first, style, text, width: neighbours of one style as one run."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.lit(True)
    for c in style:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    starts = (F.lag(order).over(w).isNull() | ~same).cast("int")
    runs = clusters.withColumn("__start", starts)
    runs = runs.withColumn("__run", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return runs.groupBy(*keys, "__run", *style).agg(F.min(order).alias("first"), F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"), F.sum("width").alias("width")).drop("__run")


def fill_page_fields(items: DataFrame, doc: str) -> DataFrame:
    """Items with {page} and {pages} replaced, once all pages of a document are known."""
    total = items.groupBy(doc).agg((F.max("page") + 1).alias("__pages"))
    text = F.replace(F.replace("text", F.lit("{pages}"), F.col("__pages").cast("string")), F.lit("{page}"), (F.col("page") + 1).cast("string"))
    return items.join(total, doc).withColumn("text", text).drop("__pages")


def stamp(pages: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The prepared header and footer of a document on each of its pages; its first page takes the variant ``first`` if there is one."""
    has_first = blocks.groupBy(*keys, "place").agg(F.max(F.col("variant") == "first").alias("__first"))
    both = pages.join(blocks.join(has_first, [*keys, "place"]), keys)
    wanted = F.when((F.col("page") == 0) & F.col("__first"), "first").otherwise("default")
    return both.where(F.col("variant") == wanted).drop("__first", "variant")


def valid_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that can be written, and a diagnostic for each of the others."""
    sound = (F.col("width") > 0) & (F.col("height") > 0)
    bad = pages.where(~F.coalesce(sound, F.lit(False)))
    return pages.where(sound), bad.withColumn("code", F.lit("pdf/page-geometry-invalid"))


def link_boxes(items: DataFrame) -> DataFrame:
    return items.where(F.col("href").isNotNull()).select("doc_id", "page", "x", "y", "width", "height", "href")


def numbering_reference(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """Paragraphs with their level's text, or why there is none: no such definition or level, or more than one."""
    definitions = levels.select("num_id").distinct().withColumn("__defined", F.lit(True))
    known = levels.groupBy("num_id", "level").agg(F.count("*").alias("__n"), F.min("text").alias("text"))
    out = paragraphs.join(definitions, "num_id", "left").join(known, ["num_id", "level"], "left")
    code = F.when(F.col("__defined").isNull(), "layout/numbering-definition-missing").when(F.col("__n").isNull(), "layout/numbering-level-missing").when(F.col("__n") > 1, "layout/numbering-level-duplicate")
    return out.withColumn("code", F.when(F.col("num_id").isNotNull(), code)).withColumn("text", F.when(F.col("code").isNull(), F.col("text"))).drop("__defined", "__n")


def place_rows(rows: list[dict], room: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(page, row, from height, to height, top, repeated) of a table's rows.

    A row has ``height``, a ``step`` (its line height, the only places to cut) and
    maybe ``header`` and ``cant_split``. Header rows are repeated on every page if
    they leave room for a step. A row that can't be split moves to the next page,
    unless it is taller than one.
    """
    head = []
    for i, r in enumerate(rows):
        if not r.get("header"):
            break
        head.append((i, r["height"]))
    head_height = sum(h for _, h in head)
    repeat = bool(head) and len(head) < len(rows) and head_height + max(r["step"] for r in rows) <= room
    out, page, y = [], 0, 0

    def fresh():
        nonlocal page, y
        page, y = page + 1, 0
        if repeat:
            for i, h in head:
                out.append((page, i, 0, h, y, True))
                y += h

    for i, r in enumerate(rows):
        top = head_height if repeat and page else 0
        if r.get("cant_split") and y > top and y + r["height"] > room and r["height"] <= room - (head_height if repeat else 0):
            fresh()
        done = 0
        while True:
            left = r["height"] - done
            if y + left <= room:
                out.append((page, i, done, r["height"], y, False))
                y += left
                break
            fit = max(0, (room - y) // r["step"]) * r["step"]
            if fit == 0:
                if y > (head_height if repeat and page else 0):
                    fresh()
                    continue
                fit = min(left, r["step"])  # nothing fits an empty page: one step is forced
            out.append((page, i, done, done + fit, y, False))
            done += fit
            y += fit
            if done >= r["height"]:
                break
            fresh()
    return out


def paginate_tables(tables: DataFrame, room: int) -> DataFrame:
    """doc_id, page, row_no, from_height, to_height, top, repeated of tables (doc_id, rows array<struct<height, step, header, cant_split>>)."""

    def run(batches):
        for batch in batches:
            rows = [(doc, *p) for doc, own in zip(batch.column("doc_id").to_pylist(), batch.column("rows").to_pylist(), strict=True) for p in place_rows(own or [], room)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "page", "row_no", "from_height", "to_height", "top", "repeated"])

    return tables.select(F.col("doc_id").cast("long").alias("doc_id"), "rows").mapInArrow(run, FRAGMENTS)


def upload_states(events: DataFrame, key: str, at: str, kind: str, ttl_minutes: int = 65) -> DataFrame:
    """key, state of uploads from their events: awaiting -> registered -> consumed, and expired where registration came too late."""
    first = lambda name: F.min(F.when(F.col(kind) == name, F.col(at)))
    found = events.groupBy(key).agg(first("created").alias("created"), first("registered").alias("registered"), first("consumed").alias("consumed"))
    late = F.col("registered") > F.col("created") + F.expr(f"INTERVAL {ttl_minutes} MINUTES")
    state = F.when(F.col("created").isNull(), "unknown").when(late, "expired").when(F.col("registered").isNull(), "awaiting").when(F.col("consumed") >= F.col("registered"), "consumed").otherwise("registered")
    return found.select(key, state.alias("state"))


def find_placeholders(text: Column) -> Column:
    """Bodies of the tags in a text; whatever isn't one stays text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1)), lambda b: F.trim(b))


def fill_placeholders(text: Column, values: dict[str, Column]) -> Column:
    """A text with the tags of known slugs replaced; unknown ones stay."""
    for slug, value in values.items():
        text = F.regexp_replace(text, r"\{\{\s*" + slug.replace(".", r"\.") + r"\s*(?:[:|][^{}]*)?\}\}", F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1"))
    return text
