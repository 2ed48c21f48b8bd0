"""Near duplicates, line templates and decontamination, against brute force or SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np

from foliary.llm import components, decontaminate, line_dedup, near_dedup


def test_near_duplicates(docs, rows):
    weights = near_dedup.word_weights(docs)
    sets = []
    for _, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        terms, words = decontaminate.terms_of(np.array([0, len(data)]), data, np.zeros(1, bool))
        _, shingle, weight = near_dedup.shingle_sets(terms, words, weights, near_dedup.WORDS)
        sets.append(near_dedup.pack_set(shingle, weight))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    ids = [near_dedup._NULL_ID if i is None else i for i, _ in rows]
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    expected = Counter((i, least[root(k)]) for k, i in enumerate(ids))
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()) == expected
    kept = near_dedup.keep_of_class(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(k) for k in range(len(rows))})


def test_one_row_of_each_class_is_kept(spark):
    import corpus_pipeline

    texts = [" ".join(random.Random(k).choices([a + b for a in "bdfgklmnprst" for b in "aeiou"], k=60)) for k in range(6)]
    # unrelated texts under one doc_id and under null; a copy whose doc_id heads another class; equal rows
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (2, texts[0]), (1, texts[0]), (3, texts[5]), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert kept == Counter([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (3, texts[5])])


def test_weighted_similarity():
    pack = lambda d: near_dedup.pack_set(np.array(sorted(d), np.uint64) << np.uint64(32), np.array([d[k] for k in sorted(d)], np.float32))
    assert near_dedup.similarity(pack({1: 1, 2: 2}), pack({2: 1, 3: 1})) == 0.25
    assert near_dedup.similarity(pack({}), pack({})) == 1.0


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 1 << 63, 400, np.uint64))
    b = np.sort(np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, np.uint64)]))
    sampler = near_dedup.WeightedSampler(600)
    one, two = (sampler.of(np.array([0]), s, np.ones(400, np.float32))[0] for s in (a, b))
    assert abs((one == two).mean() - 300 / 500) < 0.08


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "y")], "a string, b string")
    assert {r.node: r.label for r in components.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_lines_match_their_sql(docs, rows):
    got = line_dedup.dedup(docs.select("doc_id", "text"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect())
    connection = duckdb.connect()
    connection.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == Counter(connection.sql(line_dedup.ORACLE).fetchall())
    assert sum(n for _, _, n, _ in got.elements()) >= 11  # the line that only its year sets apart


def by_sql(rows):
    connection = duckdb.connect()
    connection.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return Counter(connection.sql(line_dedup.ORACLE).fetchall())


def answers(frame):
    return Counter((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in frame.collect())


def test_a_leaf_forms_any_number_of_templates(spark):
    """Seven templates of one leaf whose fields are words, one of them long with scattered fields, beside one very common line."""
    rng = random.Random(11)
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    pick = lambda n: rng.sample(words, n)
    lines = []
    for _ in range(6):
        frame = pick(17)
        lines += [" ".join(["the", "same", "lead", *(w if k % 5 else rng.choice(words) for k, w in enumerate(frame))]) for _ in range(12)]
    lines += [" ".join(["the", "same", "lead", *pick(17)])] * 30
    long = pick(80)
    lines += [" ".join(["other", "lead", "here", *(w if k % 9 else rng.choice(words) for k, w in enumerate(long))]) for _ in range(12)]
    lines += [" ".join(["the", "same", "lead", *pick(17)]) for _ in range(40)]  # prose
    rng.shuffle(lines)
    rows = [(i, f"{' '.join(pick(9))}\n{line}") for i, line in enumerate(lines)]
    got = answers(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == by_sql(rows)
    assert sum(n for _, _, n, _ in got.elements()) == 6 * 11 + 29 + 11


def test_lines_of_odd_tables(spark):
    # column names that the operator uses inside, ids and texts that are null, a very long text, equal rows
    line = "all rights reserved by somebody"
    long = "\n".join(f"word{i} and nothing else of note {i}" for i in range(30_000))
    rows = [(i, f"{line}\ntext {'xyz'[i % 3]}") for i in range(12)] + [(None, line), (None, None), (3, None), (4, ""), (5, long), (5, long)]
    docs = spark.createDataFrame([(i, t, -7, "k", 1, 2) for i, t in rows], "doc_id long, text string, __id int, `key` string, n_lines int, `id` int")
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "__id", "key", "id", "n_lines", "n_removed"]
    assert got.where("__id <> -7 OR key <> 'k' OR id <> 2").count() == 0
    assert answers(got) == by_sql(rows)


def test_lines_use_no_python(docs):
    plan = line_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


BENCHMARK = [(1, "ban kora list mura reran solo tami veke wip zato ban list"), (2, "short one"), (3, ""), (4, None), (5, "short one"), (None, "x x x")]


def contaminated(rows, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wanted = {}
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("null" if name is None else str(name))
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(k) for k in wanted}:
            for j in range(len(w) - n + 1):
                if (found := wanted.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(spark, docs, rows):
    planted = [(900, "Before. BAN kora, list mura reran solo tami veke wip zato ban list. After"), (901, "A short\none here; x x x x")]
    both = rows + planted
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    expected = contaminated(both, BENCHMARK, 10)
    assert Counter(tuple(r) for r in decontaminate.decontaminate(table, items).collect()) == expected
    index = decontaminate.build_index(table, index_bytes=3_000)
    by_shards = decontaminate.report(index, decontaminate.search(index, items, shard_bytes=40))
    assert Counter(tuple(r) for r in by_shards.collect()) == expected
    assert not [r for r in decontaminate.decontaminate(table, items.limit(0)).collect() if r.contaminated]


def test_proximity(spark):
    table = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta"), (3, "gamma " + "z " * 40 + "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "gamma beta alpha")], "item_id long, text string")
    index = decontaminate.build_index(table)
    assert decontaminate.search(index, items).count() == 0
    found = decontaminate.search(index, items, slop=6).collect()
    assert [(r.doc, r.start, r.length) for r in found] == [(0, 0, 5)] or len(found) == 1


def test_empty_tables(no_docs, spark):
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    assert decontaminate.decontaminate(no_docs, items).count() == 0
    assert line_dedup.dedup(no_docs).count() == 0
    assert near_dedup.classes(no_docs).count() == 0


def test_near_copies_in_a_large_family(spark):
    """Near copies among 600 documents that share about 0.76 of their text, so that buckets hold far more than a chunk."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    shared_text, texts = rng.choices(words, k=200), []
    for i in range(300):
        tail, other = rng.choices(words, k=31), rng.choices(words, k=31)
        texts.append(shared_text + tail)
        texts.append(shared_text + tail[: (n := rng.randint(11, 15))] + other[n:] if i % 2 else shared_text + other)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weights, sets = near_dedup.word_weights(docs), []
    for _, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        terms, n_words = decontaminate.terms_of(np.array([0, len(data)]), data, np.zeros(1, bool))
        sets.append(near_dedup.pack_set(*near_dedup.shingle_sets(terms, n_words, weights, near_dedup.WORDS)[1:]))
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= near_dedup.THRESHOLD:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    assert 100 < len(rows) - len(set(least)) < 250
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == dict(enumerate(least))
