"""Wrapping, pagination, page files and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.functions import hashing
from foliary.operators import layout
from foliary.plans.catalog import query
from foliary.session import spread, table


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("wrap_lines")
def wrap_lines(spark, sf_dir):
    talks = spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), "doc_id")
    return layout.wrap(talks, 9000, 220)


_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents"


@query("wrap_unbounded", f"SELECT doc_id, pos::INT AS paragraph, 0 AS line, length(rtrim(line, ' ' || chr(9)))::INT AS n FROM ({_LINES})")
def wrap_unbounded(spark, sf_dir):
    return layout.wrap(_documents(spark, sf_dir), 1 << 40, 220).select("doc_id", "paragraph", "line", F.length("text").alias("n"))


@query("paginate_fixed", f"SELECT doc_id, (pos // 50)::INT AS page, pos::INT AS paragraph, 0 AS first_line, 0 AS last_line, (pos % 50 * 264)::BIGINT AS top FROM ({_LINES})")
def paginate_fixed(spark, sf_dir):
    return layout.paginate(_documents(spark, sf_dir), 1 << 40, 220, 50 * 264, 264)


@query("paginate_widow")
def paginate_widow(spark, sf_dir):
    return layout.paginate(_documents(spark, sf_dir), 9026, 220, 13958, 264, spacing=120)


@query("page_counts", "SELECT doc_id, ((len(string_split(text, chr(10))) - 1) // 50 + 1)::INT AS pages FROM documents")
def page_counts(spark, sf_dir):
    placed = layout.paginate(_documents(spark, sf_dir), 1 << 40, 220, 50 * 264, 264)
    return placed.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))


@query("page_files")
def page_files(spark, sf_dir):
    from foliary.sinks.pdf import render_files

    return render_files(_documents(spark, sf_dir)).select("doc_id", "pages", F.octet_length("content").alias("size"), hashing.sha256(F.col("content")).alias("digest"), "problem")


@query("stored_artifact_check", "SELECT doc_id, true AS is_pdf FROM documents")
def stored_artifact_check(spark, sf_dir):
    from foliary.sinks.pdf import render_files

    return render_files(_documents(spark, sf_dir)).select("doc_id", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


@query("package_round_trip", "SELECT doc_id, sha256(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]', '', 'g')) AS digest FROM documents")
def package_round_trip(spark, sf_dir):
    """Every document as a package, opened and read again."""
    import pyarrow as pa

    from foliary.sinks.docx import write_package
    from foliary.sources.packages import open_packages, paragraphs

    def pack(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([write_package(t.split("\n")) for t in texts], pa.binary())], names=["path", "content"])

    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]", "")
    files = _documents(spark, sf_dir).select("doc_id", clean.alias("text")).mapInArrow(pack, "path string, content binary")
    lines = paragraphs(open_packages(files)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("p"))
    return lines.select(F.col("path").cast("long").alias("doc_id"), hashing.sha256(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("digest"))


@query("package_refusals", "SELECT * FROM (VALUES ('empty', 'DOCX_INVALID_ZIP_MAGIC'), ('cut', 'DOCX_INVALID_ZIP'), ('bare', 'DOCX_MISSING_REQUIRED_PART'), ('bare', 'DOCX_MISSING_REQUIRED_PART'), ('macro', 'DOCX_FORBIDDEN_VBA'), ('climb', 'DOCX_UNSAFE_PART_PATH')) t(path, code)")
def package_refusals(spark, sf_dir):
    import io
    import zipfile

    from foliary.sinks.docx import write_package
    from foliary.sources.packages import open_packages, package_problems

    def packed(base: list[str] | None, *more: str) -> bytes:
        out = io.BytesIO(write_package(base) if base is not None else b"")
        with zipfile.ZipFile(out, "a") as archive:
            for name in more:
                archive.writestr(zipfile.ZipInfo(name), b"x")
        return out.getvalue()

    files = [("empty", b""), ("cut", write_package(["a"])[:60]), ("bare", packed(None, "x.txt")), ("macro", packed(["a"], "word/vbaProject.bin", "word/vbaData.xml")), ("climb", packed(["a"], "../x.txt")), ("fine", write_package(["a"]))]
    return package_problems(open_packages(spark.createDataFrame(files, "path string, content binary"))).select("path", "code")


@query("trace_items", "SELECT doc_id, '[' || string_agg('{\"page\":' || (pos // 50) || ',\"paragraph\":' || pos || ',\"top\":' || (pos % 50 * 264) || '}', ',' ORDER BY pos) || ']' AS trace FROM (" + _LINES + ") GROUP BY 1")
def trace_items(spark, sf_dir):
    from foliary.sinks.pdf import trace_json

    placed = layout.paginate(_documents(spark, sf_dir), 1 << 40, 220, 50 * 264, 264)
    return trace_json(placed, ["doc_id"], ["page", "paragraph", "top"])


@query("image_headers", "SELECT p_partkey, 'image/png' AS kind, p_size::BIGINT AS width, (p_size % 7 + 1)::BIGINT AS height FROM part WHERE p_size > 0")
def image_headers(spark, sf_dir):
    from foliary.sources.images import size_of, sniff

    parts = table(spark, sf_dir, "part").where("p_size > 0")
    number = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    header = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(F.col("p_size")), number(F.col("p_size") % 7 + 1))
    found = parts.select("p_partkey", header.alias("content"))
    return found.select("p_partkey", sniff(F.col("content")).alias("kind"), size_of(F.col("content")).alias("s")).select("p_partkey", "kind", "s.width", "s.height")


@query("page_links", "SELECT page_id AS doc_id, 0 AS page, '72 ' || (800 - page_id % 700) || ' 172 ' || (812 - page_id % 700) AS place, url AS target FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, 1, '10 790 20 800', 'https://example.com/a%20b(' || page_id || ')' FROM pages WHERE url IS NOT NULL")
def page_links(spark, sf_dir):
    """Every page's address as a link in a file of two pages, read back."""
    import pyarrow as pa

    from foliary.sinks.pdf import write_pdf
    from foliary.sources.data import read_links

    def pack(batches):
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            links = [[[(1440, (30 + i % 700) * 20, 2000, 240, url)], [(200, 840, 200, 200, f"https://example.com/a b({i})")]] for i, url in zip(ids, urls, strict=True)]
            files = [write_pdf([[], []], 11900, 16840, 220, links=own)[0] for own in links]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "content"])

    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), "url")
    return read_links(pages.mapInArrow(pack, "doc_id long, content binary"))


@query("page_shapes", "SELECT p_partkey AS doc_id, 'q 1 0 0.502 rg ' || p_size || ' 100 20 10 re f Q|q 0 0 0 RG 0.5 w [2 1] 0 d 0 192 m ' || p_size || ' 192 l S Q' AS drawn, 'Part ' || p_partkey AS title, 'Somebody' AS author FROM part")
def page_shapes(spark, sf_dir):
    """A rectangle and a dashed line for each part, and who wrote it, from the bytes of its page file."""
    import pyarrow as pa

    from foliary.sinks.pdf import write_pdf

    def pack(batches):
        for batch in batches:
            rows = list(zip(batch.column("p_partkey").to_pylist(), batch.column("p_size").to_pylist(), strict=True))
            shapes = [[[("rectangle", s * 20, 1800, 400, 200, "#FF0080"), ("line", 0, 160, s * 20, 160, 10, "#000000", (40, 20))]] for _, s in rows]
            files = [write_pdf([[]], 4000, 4000, 220, f"Part {k}", shapes=own, author="Somebody")[0] for (k, _), own in zip(rows, shapes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "content"])

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"))
    body = F.decode("content", "ISO-8859-1")
    drawn = F.array_join(F.regexp_extract_all(body, F.lit("(?m)^(q .* Q)$"), F.lit(1)), "|")
    named = lambda k: F.regexp_extract(body, rf"/{k} \(([^)]*)\)", 1)
    return parts.mapInArrow(pack, "doc_id long, content binary").select("doc_id", drawn.alias("drawn"), named("Title").alias("title"), named("Author").alias("author"))
