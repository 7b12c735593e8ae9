import pytest

EXTRA = {"size": 1, "u": "x", "row": 2, "n": 3, "h": "y", "rep": 4, "block": 5, "part": 6, "target": 7, "copies": 8, "toxicity": 0.5, "place": 9, "a.b": 10}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use too."""
    long = " ".join(f"word{i % 997} filler{i % 31}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nAnother line of quite a few words stands here, see it now.", "a"),
        (2, "THE QUICK brown fox jumps over the lazy dog.\nAnother line of quite a few words stands here, see it now.", "a"),
        (3, None, "b"), (4, "", None), (5, " \n\t ", "b"), (6, long, "c"), (7, long, "c"), (7, long, "c"), (8, "one", "a"), (9, "One", None),
        (None, "no id here", "a"), (10, "Ünïcode <|endoftext|> tokens\n日本語 🙂 don't", "é"),
    ]
    names = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'string' if isinstance(v, str) else 'int'}" for k, v in EXTRA.items())
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], f"doc_id long, text string, source string, {names}").coalesce(2)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
