"""Cross-tokenizer alignment against the two libraries, and the perfect hash."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD
from tradespec.llm import alignment
from tradespec.llm.perfect_hash import PerfectHash
from tradespec.llm.words import byte_characters

FILES = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
ODD = [
    "plain words and <|endoftext|> as text", "▁not spelled", "two  blanks ", " ", "\n\ttabs\r\n",
    "日本語 mixed 🙂 \x00 bytes", "x" * 5000, "word " * 3000, "<0x41> <s></s>", "ﬁne “quotes”",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(rows, tokenizers):
    """Every row's groups and links, and the counts over all rows."""
    a, b = tokenizers
    back = {c: byte for byte, c in byte_characters().items()}

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    texts = []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        sides = [bytes(back[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if any(b"".join(side) != whole for side in sides):
            x, y, sides = [], [], ([], [])
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in sides]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        texts.append((len(x), len(y), groups, links))
    counts = Counter(link for t in texts for link in t[3])
    best: dict[int, int] = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, texts):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        n_best = sum(counts[x] == best[x[1]] for x in links)
        total = sum(counts[x] for x in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), n_best, total, digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, "k", 7) for r in AWKWARD] + [(100 + i, t, "en", "s", 0, "k", 7) for i, t in enumerate(ODD)]
    rows.append((2**53 + 1, "a large id", "en", "s", 0, "k", 7))
    schema = "doc_id long, text string, lang string, a string, n_a long, pairs string, links long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def wanted(table, tokenizers):
    return brute([(r.doc_id, r.text) for r in table.collect()], tokenizers)


def test_equals_brute_force(table, wanted):
    found = alignment.align(table, *FILES)
    assert found.columns[0] == "doc_id"
    assert sorted(map(tuple, found.collect()), key=str) == wanted


def test_equals_brute_force_with_joined_counts_and_many_segments(table, wanted, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT_PAIRS", 64)
    monkeypatch.setattr(alignment, "BRANCH_ROWS", 8)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    found = alignment.align(table.repartition(5), *FILES, broadcast_pairs=0)
    assert sorted(map(tuple, found.collect()), key=str) == wanted


def test_nothing_and_only_empty_texts(table):
    assert alignment.align(table.limit(0), *FILES).count() == 0
    empty = table.filter("text IS NULL OR text = ''")
    for broadcast in (0, 10):
        rows = alignment.align(empty, *FILES, broadcast_pairs=broadcast).collect()
        assert len(rows) == 3 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows)


def test_a_text_that_a_piece_tokenizer_changes_has_no_tokens(wanted):
    assert (101, 0, 0, 0, 0, 0, 0, "") in wanted


@pytest.mark.parametrize("size", [0, 1, 2, 17, 5000])
def test_perfect_hash_numbers_its_keys_and_no_others(size):
    chance = np.random.default_rng(size)
    keys = np.unique(chance.integers(0, 2**63, size * 2, dtype=np.uint64))
    known, others = keys[: len(keys) // 2], keys[len(keys) // 2 :]
    index = PerfectHash(known)
    assert sorted(index.numbers(known)) == list(range(len(known))) and len(index) == len(known)
    assert (index.keys[index.numbers(known)] == known).all()
    assert (index.numbers(others) == -1).all()


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectHash(np.array([1, 2, 2], np.uint64))
