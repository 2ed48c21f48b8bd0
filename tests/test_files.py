"""Packages, page files and images."""

import re

from pyspark.sql import functions as F

from foliary.sinks.docx import write_package
from foliary.sinks.pdf import point, render_files, write_pdf
from foliary.sources import images
from foliary.sources.packages import check_xml, classify_content_type, classify_path, classify_relationship, open_packages, paragraphs


def test_xml_checks():
    assert check_xml(b"<a><b/></a>") is None
    assert check_xml(b"<!DOCTYPE a><a/>") == "DOCX_FORBIDDEN_XML_DECLARATION"
    assert check_xml(b"<a><b></a>") == "DOCX_INVALID_XML"
    assert check_xml(b"\xff\xfe\x00") == "DOCX_INVALID_XML_ENCODING"
    assert check_xml(b"<a>" * 130 + b"</a>" * 130) == "DOCX_XML_DEPTH_LIMIT"


def test_packages_round_trip(spark):
    files = spark.createDataFrame([("a", write_package(["x & <y>", "", "tab\there\nline"]))], "path string, content binary")
    rows = paragraphs(open_packages(files)).orderBy("ordinal").collect()
    assert [r.text for r in rows] == ["x & <y>", "", "tab\there\nline"]


def test_classifiers(spark):
    row = spark.range(1).select(classify_path(F.lit("word/vbaProject.bin")).alias("a"), classify_path(F.lit("x/run.EXE")).alias("b"), classify_relationship(F.lit("http://x/oleObject/")).alias("c"), classify_content_type(F.lit(" application/x-sh ")).alias("d"), classify_path(F.lit("word/document.xml")).alias("e")).first()
    assert tuple(row) == ("vba", "executable", "ole", "executable", None)


def test_page_files_are_sound_and_repeatable(spark):
    content, problem = write_pdf([[(1440, 1640, "a (b) \\ é")], []], 11906, 16838, 220)
    assert problem is None and content == write_pdf([[(1440, 1640, "a (b) \\ é")], []], 11906, 16838, 220)[0]
    at = int(re.search(rb"startxref\n(\d+)", content)[1])
    assert content[at : at + 4] == b"xref" and content.count(b"/Type /Page ") == 2
    for m in re.finditer(rb"(?m)^(\d{10}) 00000 n", content):
        assert re.match(rb"\d+ 0 obj", content[int(m[1]) :])
    assert write_pdf([[(0, 0, "日")]], 100, 100, 20)[1] == "pdf/text-encoding"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 5000)], "doc_id long, text string")
    assert {r.doc_id: r.pages for r in render_files(docs).collect()}[3] > 1


def test_page_files_read_back_row_by_row(spark, tmp_path):
    """Repeated and null ids, null and empty texts, empty lines, words and lines of any length: as the SQL has them."""
    from collections import Counter

    import duckdb

    from foliary.plans import catalog

    long = " ".join(f"w{i}(\\)" for i in range(3000))
    texts = [(1, "one"), (1, "two\n\nthree"), (1, "one"), (2, None), (None, "none"), (None, None), (3, ""), (4, " \n \n"), (5, "a\n \n\n b  c \n"), (6, "x" * 9000 + " y\n" + "z" * 5000), (7, long), (8, "\n".join(f"{i} {long[:40]}" for i in range(300))), (9, "日本\n日本\nab\tc\r\nd é f"), (10, "\\101 \\n ) Tj")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["page_files_read_back"](spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(map(tuple, got)) == Counter(connection.sql(catalog.oracle_sql()["page_files_read_back"]).fetchall())


def test_lines_of_page_files_are_broken_to_a_width_only(spark):
    from foliary.sources.data import read_pages

    docs = spark.createDataFrame([(1, "word " * 500 + "\n" + "x" * 3000)], "doc_id long, text string")
    assert len(read_pages(render_files(docs)).first().text.split("\n")) > 20
    assert read_pages(render_files(docs, width=None)).first().text.split("\n") == [("word " * 500).rstrip(), "x" * 3000]
    bad = spark.createDataFrame([(1, b"%PDF-"), (2, None)], "doc_id long, content binary")
    assert [tuple(r) for r in read_pages(bad).orderBy("doc_id").collect()] == [(1, None, None, "pdf/structure"), (2, None, None, "pdf/structure")]


def test_points():
    assert [point(v) for v in (0, 20, 25, 1, -30)] == ["0", "1", "1.25", "0.05", "-1.5"]


def test_images(spark):
    good = images.png(3, 2, bytes(18))
    assert images.check_png(good) is None
    assert images.check_png(good[:-1]) == "images/png-chunk" and images.check_png(b"x") == "images/png-signature"
    broken = bytearray(good)
    broken[20] ^= 1
    assert images.check_png(bytes(broken)) == "images/png-crc"
    rows = spark.createDataFrame([(good,), (b"GIF89a\x05\x00\x07\x00",), (b"\xff\xd8\xff",), (b"RIFF0000WEBP",), (b"<svg/>",), (b"",)], "c binary").select(images.sniff(F.col("c")).alias("k"), images.size_of(F.col("c")).alias("s")).collect()
    assert [r.k for r in rows] == ["image/png", "image/gif", "image/jpeg", "image/webp", "image/svg+xml", None]
    assert tuple(rows[0].s) == (3, 2) and tuple(rows[1].s) == (5, 7)


def test_png_is_decoded():
    import random

    rng = random.Random(2)
    samples = bytes(rng.randrange(256) for _ in range(5 * 4 * 3))
    assert images.decode_png(images.png(5, 4, samples)) == (5, 4, 3, samples)
    assert images.split_alpha(4, bytes([1, 2, 3, 9, 4, 5, 6, 8])) == (bytes([1, 2, 3, 4, 5, 6]), bytes([9, 8]))


def test_png_filters():
    import zlib

    # two rows of one channel; every filter gives back 10 20 30 / 11 22 33
    first = {0: [10, 20, 30], 1: [10, 10, 10], 2: [10, 20, 30], 3: [10, 15, 20], 4: [10, 10, 10]}
    second = {0: [11, 22, 33], 1: [11, 11, 11], 2: [1, 2, 3], 3: [6, 7, 7], 4: [1, 2, 3]}

    def chunk(name, data):
        return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")

    for mode in range(5):
        raw = bytes([mode, *first[mode], mode, *second[mode]])
        content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        assert images.decode_png(content)[3] == bytes([10, 20, 30, 11, 22, 33]), mode


def test_jpeg_headers():
    frame = b"\xff\xc0\x00\x0b\x08\x00\x07\x00\x05\x01\x11\x00\x00"
    scan = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x00"
    assert images.check_jpeg(b"\xff\xd8" + frame + scan + b"\xff\xd9") == (5, 7)
    assert images.check_jpeg(b"\xff\xd8" + scan + b"\xff\xd9") == "images/jpeg-scan"
    assert images.check_jpeg(b"\xff\xd8" + frame + scan) == "images/jpeg-end" and images.check_jpeg(b"") == "images/jpeg-signature"


def test_rasters_and_literals():
    from foliary.sources.data import decode_literal, read_ppm, write_ppm

    assert read_ppm(write_ppm(2, 1, bytes(6))) == (2, 1, bytes(6)) and read_ppm(b"P6 2 2 255\n123") is None
    assert decode_literal(rb"a\(b\)\\\101\n\
c") == b"a(b)\\A\nc"


def test_paragraph_properties_and_metadata(spark):
    import io
    import zipfile

    from foliary.sources import ooxml

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:jc w:val="end"/><w:spacing w:before="120" w:line="276" w:lineRule="auto"/><w:ind w:left="720" w:hanging="360"/><w:keepNext/><w:pageBreakBefore w:val="0"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr></w:p><w:p/></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", body)
        archive.writestr("meta.json", '{"a": 1}')
    parts = open_packages(spark.createDataFrame([("p", out.getvalue())], "path string, content binary"))
    first, second = ooxml.paragraph_properties(parts).orderBy("paragraph").drop("path", "part", "paragraph").collect()
    assert tuple(first) == ("right", 120, None, 276, "auto", 720, None, -360, True, None, False, 3, 1)
    assert all(v is None for v in second)
    assert ooxml.metadata(parts, "meta.json").selectExpr("variant_get(value, '$.a', 'int') AS a").first().a == 1
    allowed = spark.createDataFrame([("strict", "lenient"), ("lenient", "compatible")], "m string, n string").select(ooxml.fallback_allowed(F.col("m"), F.col("n")).alias("x"))
    assert [r.x for r in allowed.collect()] == [False, True]
