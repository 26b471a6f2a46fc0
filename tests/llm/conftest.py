import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, score string, stats string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, and columns whose names clash."""
    long = " ".join(f"word{i % 397} thing{i % 11}." for i in range(30_000)) + "\n" + "x" * 9_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", None), (4, "one", "en", "a"), (5, "one two", "en", "b"), (5, "one two", "en", "b"), (6, long, "de", "b"), (None, "no id here at all", None, "a"), (8, "ONE two", "en", "a"), (9, "é日本\u2028 @ 1", "xx", "a")]
    return spark.createDataFrame([(i, t, a, b, len(t or ""), "clash", 1, "s", "q") for i, t, a, b in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def learn_once():
    """Training is the same for the same pieces of text; several tests ask for it."""
    from factloom.llm import pii

    real, held = pii.learn, {}

    def learn(pieces, made):
        key = (tuple(pieces), made)
        if key not in held:
            held[key] = real(pieces, made)
        return held[key]

    pii.learn = learn
    yield
    pii.learn = real
