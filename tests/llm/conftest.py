import public_tokenizers
import pytest

from tradespec.llm.shipping import shipped


@pytest.fixture(scope="session", autouse=True)
def on_workers(spark):
    shipped(spark)


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron " * 400
AWKWARD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", None, "s", 5),
    (4, "one", "en", None, 3),
    (5, LONG, "en", "s", None),
    (6, LONG, "en", "s", None),
    (7, "Grüße, 日本語 🙂 it's \x1c odd <|endoftext|>", "de", "s", 0),
    (9, "one", "en", "s", 3),
    (9, "one", "en", "s", 3),
    (None, "nobody's text " * 9, "en", "s", 0),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, v long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame([(*r, "k", 7) for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
