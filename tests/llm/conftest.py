import pytest

from runlore.session import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, a long text, ties, repeated rows, and extra columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977} the" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"), (5, long, "en", "b"),
        (6, "THE quick brown fox jumps over the lazy dog again and again", None, "a"), (7, "123 456 !!", "en", "c"),
        (8, "der schnelle braune fuchs springt über den faulen hund", "de", None), (9, "ein", "de", "c"), (9, "ein", "de", "c"),
        (None, "no key at all here", "en", "a"),
    ]
    extra = "score double, size string, key int, n int, u string, copies int, shard int, curve string, lang_pred string, held_out int"
    values = (0.5, "x", 1, 2, "u", 3, 4, "c", "xx", 0)
    return spark.createDataFrame([r + values for r in rows], f"doc_id bigint, text string, lang string, source string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
