"""Rules, ordered operators, joins and layout on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from foliary.operators import joins, layout, ordered, store
from foliary.plans import rules
from foliary.plans.rules import Condition, Question, Rule


def test_missing_answers(spark):
    answers = {"x": F.lit(None).cast("string")}
    row = spark.range(1).select(*(rules.satisfied(Rule("x", op, v), answers).alias(op) for op, v in (("eq", "a"), ("neq", "a"), ("in", ("a",)), ("not_in", ("a",)), ("lt", 5.0), ("gt", 5.0), ("is_empty", None)))).first()
    assert tuple(row) == (False, True, False, True, True, False, True)


def test_required_comes_first(spark):
    q = Question("n", "Number", "number", required=True, low=1, high=3)
    texts = [r.m for r in spark.createDataFrame([("",), ("0",), ("9",), ("x",), ("2",)], "n string").select(rules.problems(q, F.col("n")).alias("m")).collect()]
    assert texts == ["Number is required", "Number must be at least 1", "Number must be at most 3", "Number must be a number", None]


def test_hidden_answers_are_not_checked(spark):
    form = [Question("a", "A", "short_text"), Question("b", "B", "short_text", required=True, visible=Condition((Rule("a", "eq", "y"),)))]
    rows = spark.createDataFrame([(1, "y", None), (2, "n", None)], "k int, a string, b string")
    found = rules.validate(rows, ["k"], form, {"a": F.col("a"), "b": F.col("b")}).collect()
    assert [(r.k, r.message) for r in found] == [(1, "B is required")]


def test_unique_keys_pass_over_taken_names(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a")], "i int, base string")
    assert {r.i: r.key for r in store.unique_keys(rows, "base", ["i"]).collect()} == {1: "a", 2: "a_3", 3: "a_2", 4: "a_4"}


def test_counters_restart_below_a_higher_level(spark):
    rows = spark.createDataFrame(list(enumerate([0, 1, 1, 0, 2, 1])), "i int, lv int")
    got = [r.counters for r in ordered.list_counters(rows.withColumn("d", F.lit(1)), ["d"], ["i"], F.col("lv")).orderBy("i").collect()]
    assert got == [[1], [1, 1], [1, 2], [2], [2, 1, 1], [2, 1]]


def test_fragments(spark):
    lines = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 25)], "k int, top int")
    parts = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b")], "k int, start int, end int, name string")
    assert sorted((r.top, r.name) for r in joins.fragments_of(lines, parts, ["k"], "top", "start", "end").collect()) == [(0, "a"), (9, "a"), (10, "b")]


def test_breaking_keeps_the_text():
    rng = random.Random(1)
    for _ in range(50):
        words = ["".join(rng.choice("abcmwil ") for _ in range(rng.randint(1, 30))) for _ in range(20)]
        text = " ".join(words).strip()
        lines = layout.break_paragraph(text, 3000, 220)
        assert "".join(t for t, _ in lines).replace(" ", "") == text.replace(" ", "")
        assert all(w <= 3000 for _, w in lines)


def test_a_long_word_is_cut():
    assert [t for t, _ in layout.break_paragraph("aaaaa", 220, 220)] == ["aa", "aa", "a"]


@pytest.mark.parametrize(
    ("paragraphs", "room", "expected"),
    [
        ([{"lines": 3, "height": 10}], 20, [(0, 0, 0, 1, 0), (1, 0, 2, 2, 0)]),
        ([{"lines": 4, "height": 10}], 30, [(0, 0, 0, 1, 0), (1, 0, 2, 3, 0)]),  # 3 + 1 becomes 2 + 2
        ([{"lines": 2, "height": 10}, {"lines": 4, "height": 10}], 30, [(0, 0, 0, 1, 0), (1, 1, 0, 1, 0), (2, 1, 2, 3, 0)]),  # no lone first line
        ([{"lines": 2, "height": 10}, {"lines": 2, "height": 10, "keep_lines": True}], 30, [(0, 0, 0, 1, 0), (1, 1, 0, 1, 0)]),
        ([{"lines": 2, "height": 10}, {"lines": 1, "height": 10, "keep_next": True}, {"lines": 1, "height": 10}], 30, [(0, 0, 0, 1, 0), (1, 1, 0, 0, 0), (1, 2, 0, 0, 10)]),
        ([{"lines": 1, "height": 10}, {"lines": 1, "height": 10, "break_before": True}], 30, [(0, 0, 0, 0, 0), (1, 1, 0, 0, 0)]),
        ([{"lines": 1, "height": 50}], 30, [(0, 0, 0, 0, 0)]),  # taller than the page: forced
    ],
)
def test_pagination(paragraphs, room, expected):
    assert layout.place(paragraphs, room) == expected


def test_widths_are_solved():
    assert layout.solve_widths([{"kind": "fixed", "width": 100}, {"kind": "fill"}, {"kind": "fill", "high": 50}], 300) == [100, 150, 50]
    assert layout.solve_widths([{"kind": "hug", "content": 400, "low": 80}, {"kind": "fixed", "width": 100}], 300) == [200, 100]
    assert layout.column_boxes(1000, 3, 20) == [(0, 320), (340, 320), (680, 320)]
    assert layout.snap_page(11900, 16840) == (11906, 16838)


@pytest.mark.parametrize(
    ("rows", "room", "expected"),
    [
        ([{"height": 250, "step": 100}], 200, [(0, 0, 0, 200, 0, False), (1, 0, 200, 250, 0, False)]),
        ([{"height": 100, "step": 100}, {"height": 150, "step": 50, "cant_split": True}], 200, [(0, 0, 0, 100, 0, False), (1, 1, 0, 150, 0, False)]),
        ([{"height": 50, "step": 50, "header": True}, {"height": 200, "step": 50}], 150, [(0, 0, 0, 50, 0, False), (0, 1, 0, 100, 50, False), (1, 0, 0, 50, 0, True), (1, 1, 100, 200, 50, False)]),
        ([{"height": 90, "step": 90}], 50, [(0, 0, 0, 90, 0, False)]),
    ],
)
def test_table_fragments(rows, room, expected):
    from foliary.operators.paint import place_rows

    assert place_rows(rows, room) == expected


def test_trees_of_options_and_bullets():
    from foliary.functions.nested import option_text, option_tree
    from foliary.functions.text import continue_bullet

    nodes = option_tree("Fruit\n  Red apple\n\tPear\nOther")
    assert nodes == [("fruit", None, "Fruit"), ("fruit/red_apple", "fruit", "Red apple"), ("fruit/pear", "fruit", "Pear"), ("other", None, "Other")]
    assert option_text(nodes) == "Fruit\n  Red apple\n  Pear\nOther"
    assert continue_bullet("• a", 3) == ("• a\n• ", 6) and continue_bullet("• a\n• ", 6) == ("• a\n", 4) and continue_bullet("x", 1) == ("x\n", 2)


def test_schema_problems(spark):
    from foliary.functions.nested import schema_problems
    from foliary.plans.template import compile_template

    compiled = compile_template(["{{a:number}} {{b.c | upper}}", "{{#each rows}}", "{{n:boolean}}", "{{/each}}"])
    schema = spark.sql("SELECT 'x' AS a, named_struct('c', 1) AS b, array(named_struct('n', true)) AS rows").schema
    assert schema_problems(compiled, schema) == [("a", "TEMPLATE_VALUE_TYPE"), ("b.c", "TEMPLATE_VALUE_TYPE")]
    assert ("rows[].n", "TEMPLATE_VALUE_MISSING") in schema_problems(compiled, spark.sql("SELECT 1 AS a").schema)


def test_table_geometry():
    assert layout.intrinsic_widths([(0, 1, 10), (1, 1, 20), (0, 2, 41), (2, 1, 5)], 3) == [16, 25, 5]
    assert layout.row_heights([{}, {"rule": "atLeast", "height": 50}], [(0, 1, 20), (1, 1, 30), (0, 2, 90)]) == [20, 70]
    assert layout.row_heights([{"rule": "exact", "height": 10}], [(0, 1, 20)]) == "layout/table-row-too-small"
    assert [layout.content_top(a, 100, 10, 31) for a in ("top", "center", "bottom")] == [0, 29, 59]
    assert layout.justify([10, 10, 10], 41) == [6, 5] and layout.justify([10], 40) == []
    assert layout.baseline(100, 80, 130, 101) == 194 and layout.page_field_width(500, 111) == 333
    assert layout.merge_breaks([{"at": 5}, {"at": 2}], [{"at": 5}]) == [{"at": 2, "kind": "automatic"}, {"at": 5, "kind": "manual"}]


def test_adapters():
    from foliary.plans.adapters import from_fields, questions_from_fields, to_fields
    from foliary.plans.template import compile_template

    form = [
        Question("a", "A", "short_text", required=True), Question("b", "B", "select", options=("x/y", "z"), visible=Condition((Rule("a", "eq", "1"), Rule("a", "is_set")))),
        Question("c", "C", "signature"), Question("d", "D", "number", visible=Condition((Rule("a", "gt", 1.0),))),
    ]
    fields, lost = to_fields(form)
    assert lost == [("b", "NESTED_OPTIONS_FLATTENED"), ("b", "CONDITION_SIMPLIFIED"), ("c", "UNREPRESENTABLE_KIND"), ("d", "UNREPRESENTABLE_CONDITION")]
    again = from_fields(fields)
    assert again[0] == form[0] and again[1].options == ("y", "z") and again[1].visible == Condition((Rule("a", "eq", "1"),))
    assert [(q.key, q.label, q.kind) for q in questions_from_fields(compile_template(["{{due_date | date}} {{x.total:number}}", "{{#each r}}", "{{n}}", "{{/each}}"]).fields)] == [("due_date", "Due Date", "date"), ("x.total", "X Total", "number")]
