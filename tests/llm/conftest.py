import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
# Extra columns whose names operators use inside.
CLASH = ["i", "t", "row", "k", "key", "n", "tok", "dk", "kind", "norm", "spans", "items", "score", "size", "class", "slot"]


def words(rnd, n, size=3000):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, ties, clashing columns."""
    rnd = random.Random(7)
    long_text = words(rnd, 30_000)
    rows = [
        (1, "The cat sat on the mat with the other cat.", "en", "a"),
        (1, "The cat sat on the mat with the other cat.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, " \n\t", None, "b"),
        (5, long_text, "en", None),
        (6, long_text + " tail", "en", "c"),
        (7, "1234 !!", "de", "c"),
        (None, "Der Hund und die Katze.", "de", "c"),
        (8, "日本語のテキスト é Привет <|endoftext|> x", "ja", "d"),
        (9, "a" * 5_000, "en", "d"),
        (5, "same id, other text", "en", "d"),
    ]
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)
