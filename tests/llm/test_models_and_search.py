"""Classifiers by held-out accuracy, tokenisation by round trip, search by recall, the URL filter by hand."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import nearest, pieces, quality, toxicity, url_filter


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    from conftest import prose

    rng = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        text, bad, toxic = prose(rng, rng.randint(30, 120)), i % 4 == 0, i % 5 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "vileness", "dreck"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(10_000, ""), (10_001, None), (None, "some text")]
    labels += [(20_000, 1, 1), (3, None, None), (5, 7, 7), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("model", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(labelled, model, column):
    docs, labels = labelled
    found = {r.doc_id: r for r in model.classify(docs, labels).collect()}
    assert len(found) == 703 and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == held_out(i) for i, r in found.items())
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None and r.doc_id < 700}
    unseen = [i for i in truth if held_out(i) and truth[i] in (0, 1)]
    assert len(unseen) > 80 and np.mean([found[i].predicted == truth[i] for i in unseen]) >= 0.93


@pytest.mark.parametrize("model", [quality, toxicity])
def test_classifiers_without_labels(labelled, model):
    docs, labels = labelled
    assert model.classify(docs, labels.limit(0)).count() == 703
    assert model.classify(docs.limit(0), labels).count() == 0


def test_additive_model_sums_its_tables():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5)).astype(np.float32)
    y = (x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.AdditiveModel(x, y, rounds=20, pairs=3, pair_rounds=60)

    def by_hand(row):
        bins = [sum(float(v) >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        margin = model.base + sum(table[b] for table, b in zip(model.tables, bins, strict=True))
        margin += sum(table[bins[i]][bins[j]] for table, (i, j) in zip(model.pair_tables, model.pairs, strict=True))
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(model.score(x), [by_hand(r) for r in x])
    assert np.mean((model.score(x) > 0.5) == y) > 0.9
    assert (1, 2) in model.pairs


def test_trees_take_the_best_cut():
    rng = np.random.default_rng(4)
    for _ in range(30):
        g, h = rng.standard_normal(9), rng.random(9)
        gains = [g[:c].sum() ** 2 / (h[:c].sum() + 1) + g[c:].sum() ** 2 / (h[c:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1) for c in range(1, 9)]
        gain, cut = quality._best_cut(g, h)
        assert np.isclose(gain, max(gains)) and cut == 1 + int(np.argmax(gains))


@pytest.mark.parametrize("seed", range(6))
def test_risk_of_ten_rows(seed):
    rng = np.random.default_rng(seed)
    sets = [rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(10)]
    positive, unlabelled, prior, w = sets[:4], sets[4:], 0.3, 2 * rng.standard_normal(7)

    def parts(w):
        loss = lambda s, sign: np.log1p(np.exp(-sign * (sum(w[f] for f in s) + w[-1])))
        plus = prior * np.mean([loss(s, 1) for s in positive])
        return plus, np.mean([loss(s, -1) for s in unlabelled]) - prior * np.mean([loss(s, -1) for s in positive])

    plus, rest = parts(w)
    risk, grad = toxicity.PuClassifier.risk(w, positive, unlabelled, prior)
    assert np.isclose(risk, plus + max(0, rest))
    descend = (lambda w: sum(parts(w))) if rest >= 0 else (lambda w: -parts(w)[1])
    slope = [(descend(w + d) - descend(w - d)) / 2e-6 for d in np.eye(7) * 1e-6]
    assert np.allclose(grad, slope, atol=1e-6)


def test_scores_are_means_of_sigmoids():
    model = toxicity.PuClassifier([np.array([0, 1])] * 5, [np.array([1]), np.array([2])] * 8, 3, 0.2, models=2, epochs=3)
    sets = [[0, 1], [], [2]]
    expected = [np.mean([1 / (1 + np.exp(-(sum(w[f] for f in s) + w[-1]))) for w in model.weights]) for s in sets]
    assert np.allclose(model.score(np.array([0, 0, 2]), np.array([0, 1, 2]), 3), expected)


def test_samples_stay_bounded_under_one_doc_id(spark):
    from foliary.llm.labels import bounded_rows

    rows = spark.range(4000).selectExpr("1L AS doc_id", "CASE WHEN id < 2000 THEN 'same' ELSE string(id) END AS text")
    assert bounded_rows(rows, 5000, "doc_id", "text").count() == 2001
    assert 0 < bounded_rows(rows, 100, "doc_id", "text").count() < 200


@pytest.mark.parametrize(("model", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_tables(labelled, spark, model, column):
    # repeated doc_ids, equal rows, a very long text, column names that labels have, repeated and contradictory labels
    docs, labels = labelled
    long = "word " * 200_000
    more = spark.createDataFrame([(1, "other text"), (1, "other text"), (2, long), (None, None), (None, "")], "doc_id long, text string")
    both = docs.unionByName(more).withColumns({"quality": F.lit(1), "toxic": F.lit(1), "y": F.lit(5), "x": F.lit(2), "row_key": F.lit("k")})
    found = model.classify(both, labels.unionByName(labels).unionByName(labels.withColumn(column, F.lit(1))))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == 708 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id is None}) <= 2  # null and empty texts score alike


def test_held_out_labels_are_not_used(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda table: sorted((str(r.doc_id), r.score) for r in quality.classify(docs, table).collect())
    assert scores(labels) == scores(flipped)


@pytest.fixture(scope="module")
def model(spark):
    return pieces.PieceModel.read(spark, f"file://{pieces.MODEL}")


def test_pieces_match_the_library(spark, docs, rows, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["  a  b ", "\n\n\t", "<0x0A><s>", "▁x", "日本語" * 30, "🙂🙂", "tion" * 60, ";\r\n", "    " * 9, "a\u0000b"]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    coded = pieces.decode(pieces.encode(table, model, block_bytes=8_000, slice_bytes=10_000), model)
    got = coded.collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == library.encode(r.text)
            assert r.decoded == r.text.replace("▁", " ")


def test_characters_without_a_piece(spark, model):
    ids = np.array([5, -1 - ord("é"), 7, -1 - ord("日"), -1 - ord("é")])
    for byte_ids, code in ((list(range(1000, 1256)), lambda c: [1000 + b for b in c.encode()]), (None, lambda c: [3])):
        out, grown = pieces.spelled_out(ids, byte_ids, 3)
        expected = [[5], code("é"), [7], code("日"), code("é")]
        assert out.tolist() == [x for part in expected for x in part]
        assert grown.tolist() == [0, *np.cumsum([len(p) for p in expected]).tolist()]
    rare = "".join(chr(0x4E00 + i % 9000) for i in range(60_000))
    got = pieces.decode(pieces.encode(spark.createDataFrame([(1, rare)], "doc_id long, text string"), model), model).first()
    assert got.decoded == rare


def test_unigram_models_take_the_best_path(spark):
    scored = [("▁", -2.0, 1), ("a", -2.0, 2), ("b", -2.0, 3), ("ab", -2.5, 4), ("▁a", -3.5, 5), ("bb", -2.2, 6), ("abb", -9.0, 7)]
    small = pieces.PieceModel(scored, None, 0, "unigram", ["<unk>", *(p for p, _, _ in scored)])
    table = spark.createDataFrame([(1, "abb"), (2, "ab"), (3, "bqb"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode(table, small).collect()}

    def best(text):
        known = {p: (s, i) for p, s, i in scored}
        table = [(0.0, [])]
        for at in range(1, len(text) + 1):
            options = [(table[a][0] + known[text[a:at]][0], table[a][1] + [known[text[a:at]][1]]) for a in range(at) if text[a:at] in known]
            options += [(table[at - 1][0] - 19.0, table[at - 1][1] + [0])] if text[at - 1] not in known else []
            table.append(max(options))
        return table[-1][1]

    assert got == {1: best("▁abb"), 2: best("▁ab"), 3: best("▁bqb"), 4: []}


def test_pieces_of_nothing(no_docs, model):
    assert pieces.encode(no_docs, model).count() == 0


def search_by_force(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in good:
        if q % 50 == 0:
            score = {i: float(v @ good[q] / np.linalg.norm(v) / np.linalg.norm(good[q])) for i, v in good.items() if i != q and len(v) == len(good[q])}
            out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
    return out


@pytest.mark.parametrize("options", [{}, {"region_rows": 100, "leaf_rows": 10}, {"region_rows": 40, "leaf_rows": 10, "query_rows": 3}])
def test_search(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # a vector that many share
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [1.0, None] * 8), (2250, [1.0, 2.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, bound string")
    got = {}
    for r in nearest.search(table, table.where("vec_id % 50 = 0"), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    expected = {q: v for q, v in search_by_force(rows).items() if v}
    assert got.keys() == expected.keys()
    assert np.mean([len(set(got[q]) & set(v)) / len(v) for q, v in expected.items()]) >= 0.9
    assert got[50] == [1000, 1001, 1002, 1003, 1004]


def test_a_task_holds_a_bounded_number_of_queries(spark):
    indexed = spark.range(60).selectExpr("4 AS width", "int(id % 2) AS region", "0 AS part", "binary(string(id)) AS vec")
    visited = spark.range(1000).selectExpr("4 AS width", "int(id % 10 = 0) AS region", "0 AS part", "id AS query_id", "binary(string(id)) AS vec")
    left, right = nearest._meetings(indexed, visited, 50)
    by = ["width", "region", "part", "cut"]
    sizes = {(r.region, r.cut): r["count"] for r in right.groupBy(*by).count().collect()}
    assert max(sizes.values()) < 100 and sum(sizes.values()) == 1000 and len([k for k in sizes if k[0] == 0]) == 18
    assert {r["count"] for r in left.groupBy(*by).count().collect()} == {30} and {(r.region, r.cut) for r in left.collect()} == set(sizes)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(empty, empty).count() == 0


def test_urls(spark):
    pages = [
        (1, "http://a.com/x", '<a href="http://B.com/q">'), (2, "http://b.com/en/", "<a href='//c.org/'>"), (3, "HTTP://C.org/es/1", None), (4, None, "x"), (5, "nope", None), (6, "http://x.Example.com?q=/en/7", ""),
        (7, "http://x.Example.com/en/71#a", ""), (8, "http://x.example.com/en/8", ""), (9, "http://notnet/de/1", ""), (10, "http://net/de/1?x", ""), (11, "http://d.net/de/", ""), (11, "http://d.net/de/", ""),
    ]
    table = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, rule_verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.classify(table, rules).collect()}
    assert got == {
        1: ("a.com", "/x", None, "block"), 2: ("b.com", "/en/", "com/en/", "block"), 3: ("c.org", "/es/1", "org/es/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("x.example.com", "", None, "allow"), 7: ("x.example.com", "/en/71", "example.com/en/7", "allow"), 8: ("x.example.com", "/en/8", "com/en/", "block"), 9: ("notnet", "/de/1", None, "allow"),
        10: ("net", "/de/1", "net/de/", "block"), 11: ("d.net", "/de/", "net/de/", "block"),
    }
    assert url_filter.classify(table.limit(0), rules).count() == 0


def test_rules_of_the_contract(spark, tmp_path):
    # "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/", the longest wins
    urls = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://b.example.com/en/6": ("com/en/", "block"), "http://net/de/1?x": ("net/de/", "allow"),
        "http://C.net/de/": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://d.example.net/de/8#a": ("example.net/de/8", "block"), "http://e.net/de/8": ("net/de/", "allow"), "http://f.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(urls.values()))


def test_ranks_reach_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(36)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 100.0)], "host string, seed double")
    got = {r.host: r["rank"] for r in url_filter.propagate(edges, seeds).collect()}
    assert len(got) == 37 and np.allclose([got[f"h{i}"] for i in range(37)], 100 * 0.85 ** np.arange(37), atol=1e-6)


def test_ranks_against_dense_iteration(spark):
    links = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0)]
    edges = spark.createDataFrame(links, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0), ("d", 2.0)], "host string, seed double")
    names = "abcd"
    step = np.zeros((4, 4))
    for s, d, w in links:
        step[names.index(d), names.index(s)] += w / sum(x for t, _, x in links if t == s)
    seed = np.array([1.0, 0, 0, 2.0])
    rank = seed
    for _ in range(20):
        rank = seed + 0.85 * step @ rank
    got = {r.host: r["rank"] for r in url_filter.propagate(edges, seeds, steps=20, tolerance=0).collect()}
    assert np.allclose([got.get(n, 0) for n in names], rank, atol=1e-9)
