"""Windows whose words were made to agree in a polynomial hash stay apart."""

import pytest

from tradespec.llm import substring_dedup
from tradespec.llm.wordhash import PIECE, texts_word_pairs


def thue_morse(size, one, other):
    return "".join(one if i.bit_count() % 2 == 0 else other for i in range(size))


def test_thue_morse_words_are_different(spark):
    common = " ".join(f"w{i}" for i in range(12))
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame(
        [(1, f"{common} {a}"), (2, f"{common} {b}"), (3, f"{common} {b}")],
        "doc_id long, text string",
    )
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated(docs).collect()}
    assert found == {1: 0, 2: 0, 3: 13}


def test_words_are_split_at_ascii_white_space_only():
    text = "a\x0bb\x1cc d\x85e\xa0f\tg".encode()
    one, other, counts = texts_word_pairs([text, b"", b" \n ", b"g a"])
    assert counts.tolist() == [4, 0, 0, 2]
    assert one[3] == one[4] and one[0] == one[5] and other[0] == other[5]
    assert len(set(one.tolist())) == 4 and not (one == other).any()


@pytest.mark.parametrize("size", [32, 64, 65, 128, 1024])
def test_words_hash_by_content_at_any_place(size):
    a, b = thue_morse(size, "a", "b").encode(), thue_morse(size, "b", "a").encode()
    filler = b"x " * (PIECE - 7)
    one, other, counts = texts_word_pairs([a + b" " + b, filler + a, b"", b, a[:-1]])
    assert counts.tolist() == [2, PIECE - 6, 0, 1, 1]
    assert one[0] == one[-3] and other[0] == other[-3]
    assert one[1] == one[-2] and other[1] == other[-2]
    assert len({*one[[0, 1, -1]].tolist(), *other[[0, 1, -1]].tolist()}) == 6


def test_very_long_word_and_repeated_rows(spark):
    text = " ".join(["x" * 3_000_000, *(f"w{i}" for i in range(15))])
    docs = spark.createDataFrame(
        [(1, text, "u"), (1, text, "u"), (2, text, "v"), (None, text, "v"), (4, None, "v")],
        "doc_id long, text string, n_words string",
    )
    rows = substring_dedup.remove_repeated(docs, with_text=False).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [
        (0, 16, 16), (1, 16, 0), (1, 16, 0), (2, 16, 16), (4, 0, 0)
    ]
