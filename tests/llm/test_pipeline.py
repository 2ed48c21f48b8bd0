"""The corpus pipeline, stage by stage, on a small table."""

import pytest
from pyspark.sql import functions as F


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf_dir).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert before * 0.7 <= docs.count() <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()


def test_verdicts_fall_on_their_own_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline

    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {passage} after"), (None, "clean one"), (5, f"again {passage}"), (5, "clean two"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()} == {(None, "clean one"), (5, "clean two"), (6, None)}
    # the same texts without an id, or all under one, get the verdicts they get under their own
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.text for r in corpus_pipeline.quality_stage(spark, docs, sf_dir).collect()}
    extra = docs.withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.withColumn("doc_id", F.lit(-1).cast("long")))
    both = corpus_pipeline.quality_stage(spark, docs.unionByName(extra), sf_dir)
    texts = [r.text for r in docs.collect()]
    assert 0 < len(kept) < len(set(texts))
    good = sum(t in kept for t in texts)
    assert both.where("doc_id IS NULL").count() == both.where("doc_id = -1").count() == good


def test_stages_take_odd_tables(spark, sf_dir):
    """Nulls, empty and very long texts, equal rows, columns with clashing names; empty tables."""
    import corpus_pipeline

    long = " ".join(f"word{i % 977} and {i % 31}" for i in range(10_000))
    line = "all rights reserved by somebody else"
    rows = [(None, None), (None, ""), (1, None), (1, ""), (2, long), (2, long), (None, long), (3, "short"), *((10 + i, f"{line}\nown words of number {'abcdefghijkl'[i]} here") for i in range(12))]
    names = ["__id", "__key", "block", "key", "n_lines", "part", "row_key", "hash", "label", "slice", "Id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(f"own {n}") for n in names if n != "n_lines"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == [*docs.columns, *(["n_chars"] if name == "lines" else [])], name
        found = [r.asDict() for r in got.collect()]
        assert all(r[n] == f"own {n}" for r in found for n in names if n != "n_lines"), name
        texts = [(r["doc_id"], r["text"]) for r in found]
        if name in ("lines", "benchmark"):
            assert len(texts) == len(rows), name
        if name == "lines":
            assert sum(line in t for _, t in texts) == 1 and texts.count((2, long)) == 2 and (None, "") in texts
        if name == "near":  # one of the empty texts, one of the long ones, the short one, and the twelve, which are classes of their own or of each other
            assert sum(not t for _, t in texts) == 1 and sum(t == long for _, t in texts) == 1 and (3, "short") in texts
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and empty.columns == got.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(rows) and last.where("text IS NULL" if "text" in last.columns else "ids IS NULL").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_a_shared_folder_is_asked_for(spark):
    from foliary.llm import shared

    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared.shared_dir(Elsewhere)


def test_queries_are_registered():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
