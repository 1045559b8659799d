import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k + k * seed) % len(WORDS)] + str((k * seed) % 11) for k in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    long = prose(3, 30_000)
    rows = [
        (1, prose(1, 60), "a"),
        (2, prose(1, 60), None),
        (3, None, "a"),
        (4, "", "b"),
        (5, long, "b"),
        (6, long + " tail", "b"),
        (7, " \t\n ", "a"),
        (8, "one two", "a"),
        (9, "ONE\tTwo", None),
        (10, prose(5, 40), "a"),
        (10, prose(5, 40), "a"),
        (None, prose(6, 50), "a"),
        (None, None, None),
        (11, "é日本\u2581 x\u0000y", "\u00e9"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    for name in ("id", "row", "order", "class", "component", "digest", "size", "lang", "n_chars", "raw", "batch", "mark"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
