import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "re", "so", "ta", "ve", "wi", "za") for b in ("n", "ra", "st", "lo", "mi", "ke", "du", "p", "shi", "to")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", "", ",", "."]))
        if i % 23 == 22:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def corpus(seed: int = 7) -> list[tuple]:
    """(doc_id, text): prose with copies, near copies, shared passages, and every odd case."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 260)) for _ in range(40)]
    passage, line = prose(rng, 90).replace("\n", " "), "Copyright 2024 by somebody, all rights reserved here."
    texts = list(base)
    texts += [base[3], base[3], base[5]]
    for i in (1, 2, 4, 8):
        words = base[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}" for _ in range(6)]
    texts += [f"{prose(rng, 25)}\n{line.replace('2024', str(2000 + i))}\n{prose(rng, 25)}" for i in range(12)]
    texts += ["", "", "   ", "one", "a b c", "é ü 日本 🙂 ß", "x" * 1500, "ab " * 700, "A\u0000B\r\nC\x0bD", "word " * 3000]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(9, None), (None, base[0]), (None, None), rows[2], (6, "another text under a doc_id that is there already")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    # more columns than needed, with names that operators use inside
    frame = spark.createDataFrame([(i, t, "b", 1, "k") for i, t in rows], "doc_id long, text string, block string, slice int, key string")
    return frame.repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
