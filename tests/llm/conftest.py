import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}é"[: 2 + rng.randrange(4)] for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty, short, very long and repeated texts."""
    rng = random.Random(11)
    base = [" ".join(words(rng, rng.randrange(5, 160), 4000)) for _ in range(60)]
    passage = " ".join(words(rng, 60, 4000))
    texts = list(base)
    for i in range(40):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"x{i}"
        texts.append(" ".join(t))
    texts += [f"{rng.choice(base)}\n{passage}\t{i} {rng.choice(base)}" for i in range(30)]
    texts += [base[0], base[0], base[1].upper(), None, "", "   \n ", "a", "a b", "A  b", "Ünï cödé 日本語 😀", "ab" * 300, "ab" * 300, " ".join(["spam"] * 200), " ".join(words(rng, 9000, 4000)), "\x0b\x0c\x1c x \x85 y"]
    rows = [(7 * i % 1009, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, and further columns with names that the operators use inside."""
    rows = [(None, "some words that are here " * 9), (1, "some words that are here " * 9), (2, None), (None, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("chunk", "bucket", "names", "kept_text", "n_words", "lang_pred", "key", "node", "spans", "row", "n_symbols", "score"):
        df = df.withColumn(c, F.lit("mine"))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
