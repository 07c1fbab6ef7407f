import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, a long text, special spellings."""
    long = prose(1, 120_000)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, prose(2, 40), "en", "a", 9), (None, None, None, None, None),
        (4, "one", "en", None, 3), (5, "one two", None, "a", 7), (6, prose(3, 60), "en", "a", 1), (6, prose(3, 60), "en", "a", 1), (7, prose(3, 60), "de", "b", 1),
        (8, long, "en", "a", len(long)), (9, "<|endoftext|>  x ~ \x00 <|startoftext|>", "en", "a", 1), (10, "Ünïcode ßtraße 中文 \U0001f600 ́", "de", "b", 1), (11, "12345 !!! ###", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names the operators use inside."""
    frame = spark.createDataFrame(odd_rows(), DOCS)
    clash = ["score", "kept", "size", "token", "part", "length", "crowd", "x", "y", "u", "v", "w", "cid", "id", "rank", "html", "host", "refers_to", "label", "ids", "items"]
    return frame.selectExpr("*", *(f"'clash' AS {c}" for c in clash)).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
