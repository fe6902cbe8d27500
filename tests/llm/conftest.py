import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()


def prose(draw, n):
    return [draw.choice(SYLLABLES) + draw.choice(SYLLABLES) + draw.choice(SYLLABLES) for _ in range(n)]


def document(draw, lines=6, width=14):
    return "\n".join(" ".join(prose(draw, draw.randint(3, width))) for _ in range(draw.randint(1, lines)))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, and odd ones."""
    draw = random.Random(3)
    texts = [document(draw) for _ in range(40)]
    passage = "\n".join(" ".join(prose(draw, 20)) for _ in range(3))
    for k in range(3):
        texts.append(document(draw) + "\n" + passage + "\n" + document(draw))
    texts.append(texts[0])
    base = " ".join(prose(draw, 120))
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[draw.randrange(len(w))] = "x" + str(draw.randrange(10**6))
        texts.append(" ".join(w))
    line = " ".join(prose(draw, 60))
    texts += [f"{document(draw)}\n{line}\n{document(draw)}" for _ in range(2)]
    texts += [None, "", "  \n\t ", "one", "two words", "a b c d", "a b c d", "É é\xa0x \x1c y", "\n\nq w e r t y\n\n", "x " * 30000]
    return list(enumerate(texts))


CLASHES = ["node", "key", "n", "row", "id", "part", "chunk", "rank", "kept", "n_lines", "value", "comp", "place"]


def table(spark, rows):
    """Documents with further columns of names that the operators use inside."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(i, t, None if i is None else ("en" if i % 3 else None), "hot" if i is None or i % 2 else None, len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, schema)
    for k, name in enumerate(CLASHES):
        df = df.selectExpr("*", f"{k} AS {name}")
    return df


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return table(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    return table(spark, [(None, "a b c d e f"), (None, None), (7, "same text here"), (7, "same text here"), (8, None), (8, ""), (9, "same text here")])


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])
