import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew some coffee near an old stone bridge".split()


def prose(seed: int, words: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] for i in range(words))


LONG = prose(3, 40_000)

# id, text, lang, source: nulls in every column, empty and blank texts, a very long one, copies, a repeated row
ROWS = [
    (1, prose(1, 30), "en", "b"), (2, prose(2, 50), "en", "a"), (3, None, "en", "a"), (None, prose(4, 20), "en", "a"),
    (5, "", None, "b"), (6, " \n\t ", "de", None), (7, LONG, "de", "a"), (8, prose(1, 30), None, None),
    (9, prose(9, 3), "de", "c"), (9, prose(9, 3), "de", "c"), (10, "12345 678", "de", "c"), (None, None, None, None),
    (11, "Äpfel\u00a0und  Birnen\r\n\r\nfür 3 € ", "de", "c"), (12, "x", "de", "d"),
]

# Names that the operators use for their results or on the way to them.
CLASHES = (
    "Score keep_id group_size kept text_digest fingerprint component_id copies size target hits host path rule verdict answer judged_0 "
    "clean_text n_lines dropped_lines line_owner lang_pred predicted n_tokens base_score n_known start shard ids row text_key same_text"
).split()


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return frame.selectExpr("*", *[f"'own' AS `{c}`" for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def plain_rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
