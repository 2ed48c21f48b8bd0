"""The template language: parsing, analysis and rendering."""

import pytest
from pyspark.sql import functions as F

from foliary.plans.codegen import render
from foliary.plans.template import compile_template, json_schema, parse_value, starter_data


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("a..b", "TEMPLATE_INVALID_EXPRESSION"), ("__proto__.x", "TEMPLATE_UNSAFE_PATH"), (".".join("a" * 33), "TEMPLATE_EXPRESSION_LIMIT"), ("a|nope", "TEMPLATE_UNKNOWN_FORMATTER"),
        ("a|upper:1", "TEMPLATE_FORMATTER_ARGUMENT"), ("a|currency:'usd'", "TEMPLATE_FORMATTER_ARGUMENT"), ("a|date:'yyyy-MM'", "TEMPLATE_FORMATTER_ARGUMENT"), ("a|date:'yyyy", "TEMPLATE_MALFORMED_QUOTE"),
        ("a:string|currency:'USD'", "TEMPLATE_FORMATTER_TYPE"), ("a|upper|date", "TEMPLATE_FORMATTER_TYPE"), ("#if a", "TEMPLATE_BLOCK_MARKER_PLACEMENT"), ("@image", "TEMPLATE_INVALID_IMAGE_TAG"), ("image a", "TEMPLATE_UNSUPPORTED_IMAGE_TAG"), ("a|", "TEMPLATE_INVALID_EXPRESSION"),
    ],
)
def test_faulty_tags(body, code):
    assert parse_value(body) == code


@pytest.mark.parametrize(
    ("paragraphs", "code"),
    [
        (["{{#if a}}", "x"], "TEMPLATE_UNCLOSED_BLOCK"), (["{{/if}}"], "TEMPLATE_UNBALANCED_BLOCK"), (["{{#if a}}", "{{else}}", "{{else}}", "{{/if}}"], "TEMPLATE_DUPLICATE_ELSE"),
        (["{{#each a}}", "{{/if}}"], "TEMPLATE_UNBALANCED_BLOCK"), (["{{a"], "TEMPLATE_MALFORMED_TAG"), (["a}}"], "TEMPLATE_MALFORMED_TAG"), (["{{a:number}} {{a:string}}"], "TEMPLATE_TYPE_CONFLICT"), (["{{a:number}} {{a.b}}"], "TEMPLATE_PATH_CONFLICT"),
    ],
)
def test_faulty_templates(paragraphs, code):
    assert code in [p.code for p in compile_template(paragraphs).problems]


def test_known_vector(spark):
    records = spark.sql("SELECT named_struct('name', 'Amara') AS patient, named_struct('total', 1234.5D) AS invoice, 1 AS k")
    compiled = compile_template(['Patient {{patient.name | upper}} owes {{invoice.total:number | currency:"ZAR"}}.'])
    assert [f.path for f in compiled.fields] == ["invoice.total", "patient.name"]
    row = render(compiled, records, ["k"], "en-ZA", "Africa/Johannesburg").first()
    assert row.text == "Patient AMARA owes R\u00a01\u00a0234,50." and row.error is None


def test_schema_and_starter():
    compiled = compile_template(["{{a.b:number}}", "{{#each rows}}", "{{when | date}}", "{{/each}}"])
    schema = json_schema(compiled)
    assert schema["required"] == ["a", "rows"] and schema["properties"]["rows"]["items"]["properties"]["when"]["format"] == "date-time"
    assert starter_data(compiled) == {"a": {"b": 0}, "rows": [{"when": "1970-01-01T00:00:00.000Z"}]}


def test_loops_branches_and_missing_values(spark):
    records = spark.sql("SELECT 1 AS k, array(named_struct('n', 1, 'ok', true), named_struct('n', 2, 'ok', false), named_struct('n', CAST(NULL AS INT), 'ok', CAST(NULL AS BOOLEAN))) AS rows, 'root' AS outer")
    compiled = compile_template(["{{#each rows}}", "n={{n}} {{outer}}", "{{#if ok}}", "yes", "{{else}}", "no", "{{/if}}", "{{/each}}"])
    got = [(r.id, r.text, r.error, r.severity) for r in render(compiled, records, ["k"], permissive=True).orderBy("ord").collect()]
    # a loop sees its item only
    assert got[:4] == [("p1~each-0", "n=1 ", "TEMPLATE_VALUE_MISSING", "warning"), ("p3~each-0", "yes", None, None), ("p1~each-1", "n=2 ", "TEMPLATE_VALUE_MISSING", "warning"), ("p5~each-1", "no", None, None)]
    assert got[4][2] == "TEMPLATE_VALUE_TYPE" and got[5] == ("p2~each-2", "", "TEMPLATE_VALUE_TYPE", "warning")


def test_empty_loop_has_no_lines(spark):
    records = spark.sql("SELECT 1 AS k, CAST(array() AS array<struct<n:int>>) AS rows")
    assert render(compile_template(["{{#each rows}}", "{{n}}", "{{/each}}"]), records, ["k"]).count() == 0


def test_same_result_on_any_partitioning(spark):
    records = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("v"))
    compiled = compile_template(['{{v | currency:"USD"}}'])
    once = {tuple(r) for r in render(compiled, records.repartition(1), ["k"]).collect()}
    assert once == {tuple(r) for r in render(compiled, records.repartition(7), ["k"]).collect()}


def test_no_shuffle_and_no_python(spark):
    records = spark.range(5).select(F.col("id").alias("k"), F.array(F.struct(F.col("id").alias("n"))).alias("rows"))
    plan = render(compile_template(["{{#each rows}}", "{{n}}", "{{/each}}"]), records, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
