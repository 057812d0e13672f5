import pytest


@pytest.fixture(scope="session")
def words():
    """Invented words of two made-up languages."""
    import random

    rng = random.Random(4)
    one = ["".join(rng.choice("bdgklm") + rng.choice("aeo") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    two = ["".join(rng.choice("prstvz") + rng.choice("iuy") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    return one, two


@pytest.fixture(scope="session")
def documents(spark, words):
    """Texts with nulls, blanks, copies, near copies, long texts, null ids and a clashing column."""
    import random

    rng = random.Random(5)
    one, two = words
    rows = []
    for i in range(120):
        lang, pool = ("xx", one) if i % 2 else ("yy", two)
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(5, 120)))
        rows.append((i, text, lang, "s", 0, "clash"))
    long = " ".join(rng.choice(one) for _ in range(3000))
    rows += [
        (200, None, "xx", "s", 0, None),
        (201, "", "xx", None, 0, None),
        (202, " \t\n ", None, "s", None, "c"),
        (203, "12 34 !!", "xx", "s", 0, "c"),
        (204, long, "xx", "s", 0, "c"),
        (205, long[:-3] + "zzz", "xx", "s", 0, "c"),
        (206, rows[3][1], "xx", "s", 0, "c"),
        (207, rows[3][1], None, "s", 0, "c"),
        (207, rows[3][1], None, "s", 0, "c"),
        (None, rows[5][1], "xx", "s", 0, "c"),
        (208, "Ünïcödé 😀 x'll <|endoftext|>  　 y", "xx", "s", 0, "c"),
        (209, "a" * 5000 + " " * 300 + "b", "xx", "s", 0, "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
