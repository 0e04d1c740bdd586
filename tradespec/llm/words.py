"""Splitting texts into the words of a byte-level BPE tokenizer file, as that file says."""

from __future__ import annotations

import functools
import json
import re

from tokenizers import Tokenizer

# The letters and numbers of Latin-1 after lower-casing, its white
# space, and the word pattern of the tokenizer file written for them.
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+"
)
#: White space to Python, yet not to the pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")
WORD_END = "</w>"


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words:
    """Cuts texts into words; texts beyond Latin-1 go through the file's own rules."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self._hints = tuple({t[:2] for t in self.added})
        self.character = byte_characters()
        self._byte = {c: b for b, c in self.character.items()}

    def split(self, text: str) -> list[str]:
        """The words of a text; added tokens appear as themselves."""
        return [w for c in self.chunks(text) for w in self.words_in(c)]

    def chunks(self, text: str) -> list[str]:
        """A text cut at white space only, which no word crosses; lower case.

        Texts beyond Latin-1 come as words already.
        """
        if any(h in text for h in self._hints):
            parts = self._added.split(text)
            if len(parts) > 1:
                return [c for p in parts for c in ([p] if p in self.added else self._plain(p))]
        return self._plain(text)

    def words_in(self, chunk: str) -> list[str]:
        if chunk in self.added or not _is_latin(chunk):
            return [chunk]
        return _LATIN_WORDS.findall(chunk)

    def _plain(self, text: str) -> list[str]:
        lower = text.lower()
        if _is_latin(text) and _is_latin(lower):
            return _LATIN_WORDS.findall(lower) if _SEPARATORS.search(text) else lower.split()
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [
            bytes(map(self._byte.__getitem__, w)).decode("utf-8", "surrogatepass")
            for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        ]

    def spelled(self, word: str) -> str:
        """A word in the characters that stand for its bytes."""
        return "".join(map(self.character.__getitem__, word.encode("utf-8", "surrogatepass")))


@functools.lru_cache(maxsize=4)
def words_of(path: str) -> Words:
    """The splitter of a tokenizer file, made once in a Python worker."""
    return Words(path)


class WordCache(dict):
    """What was found for a word. Holds up to twice ``limit`` words; those not asked
    for since the last ``limit`` new ones are forgotten."""

    def __init__(self, find, limit: int = 250_000):
        super().__init__()
        self.find, self.limit, self.older = find, limit, {}

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self.find(word)
        self[word] = found
        return found
