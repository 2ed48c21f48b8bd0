"""Row blocks, trees and page files, case by case."""

from pyspark.sql import functions as F

from foliary.operators import joins, trees
from foliary.plans.tables import Cell, Row, compile_table, render_table, row_marker


def row(*texts, **more):
    return Row([Cell([t]) for t in texts], **more)


def codes(rows):
    return [(p.paragraph, p.code) for p in compile_table(rows).problems]


def test_row_markers():
    assert row_marker(row("a {{x}}", "")) is None
    assert row_marker(row("", " {{#each items}} "))[2] == "items"
    assert row_marker(row("{{#if a}}", "text")) == "TEMPLATE_TABLE_ROW_MARKER_CONTENT"
    assert row_marker(row("{{#if a}}", "{{/if}}")) == "TEMPLATE_TABLE_ROW_MARKER_CONTENT"
    assert row_marker(Row([Cell([], table=True)])) == "TEMPLATE_UNSUPPORTED_NESTED_TABLE"


def test_problems_of_tables():
    assert codes([row("{{#if a}}"), row("x"), row("{{else}}"), row("{{else}}"), row("{{/if}}")]) == [(3, "TEMPLATE_DUPLICATE_ELSE")]
    assert codes([row("{{/each}}")]) == [(0, "TEMPLATE_UNBALANCED_TABLE_BLOCK")]
    assert codes([row("{{#each a}}"), row("{{/if}}")]) == [(0, "TEMPLATE_UNCLOSED_TABLE_BLOCK"), (1, "TEMPLATE_UNBALANCED_TABLE_BLOCK")]
    assert codes([Row([Cell(["{{#if a}}", "x"])])]) == [(0, "TEMPLATE_TABLE_ROW_MARKER_CONTENT")]
    assert codes([row("{{#each a}}"), row("x", header=True), row("{{/each}}")]) == [(0, "TEMPLATE_TABLE_LOOP_HEADER")]
    merged = Row([Cell(["x"], merge="continue")])
    assert codes([row("{{#each a}}"), merged, row("{{/each}}")]) == [(2, "TEMPLATE_TABLE_LOOP_VERTICAL_MERGE")]
    assert codes([merged, row("{{#each a}}"), row("x"), row("{{/each}}")]) == []
    assert codes([row("{{a:number}}"), row("{{a:string}}")]) == [(0, "TEMPLATE_TYPE_CONFLICT")]


def test_paragraphs_of_cells_and_nested_loops(spark):
    table = compile_table([row("{{#each groups}}"), Row([Cell(["{{name}}", "of {{name}}"])]), row("{{#each items}}"), row("{{n:number}}", "{{missing}}"), row("{{/each}}"), row("{{/each}}")])
    records = spark.createDataFrame([(1, [("a", [(1,), (2,)]), ("b", [])]), (2, None)], "k int, groups array<struct<name:string,items:array<struct<n:int>>>>")
    got = [(r.k, r.ord, r.id, list(r.cells), r.error) for r in render_table(table, records, ["k"]).orderBy("k", "ord").collect()]
    assert got == [
        (1, 0, "r1~each-0", ["a\nof a"], None),
        (1, 1, "r3~each-0-0", ["1", ""], "TEMPLATE_VALUE_MISSING"),
        (1, 2, "r3~each-0-1", ["2", ""], "TEMPLATE_VALUE_MISSING"),
        (1, 3, "r1~each-1", ["b\nof b"], None),
    ]


def test_chains_of_any_length(spark):
    styles = spark.createDataFrame([(f"s{i}", "paragraph", f"s{i + 1}" if i < 40 else None) for i in range(41)], "id string, type string, based_on string")
    chain = joins.style_chains(styles).where("id = 's0'")
    assert chain.count() == 41 and chain.agg(F.max("depth")).first()[0] == 40
    aliases = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(20)] + [("x", "y"), ("y", "x")], "alias string, target string")
    found = {r.alias: r.target for r in joins.resolve_aliases(aliases).collect()}
    assert found["a0"] == "a20" and found["x"] is None
    nodes = spark.createDataFrame([("v0", None, "0"), *((f"v{i}", f"v{i - 1}", str(i)) for i in range(1, 19))], "value string, parent string, label string")
    assert [(r.value, r.label) for r in joins.flatten_choices(nodes).collect()] == [("v18", " / ".join(map(str, range(19))))]


def test_orders_by_letters_before_case(spark):
    names = ["b", "A", "a", "B", "é", "e", "f", "Z"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(trees.locale_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["a", "A", "b", "B", "e", "é", "f", "Z"]
