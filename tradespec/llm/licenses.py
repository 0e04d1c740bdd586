"""Licence notices in texts, by a trained classifier of spans of words.

Texts are cut into paragraphs at blank lines; line breaks inside a paragraph are
white space. For every template the words of a paragraph are scanned with a sliding
span, half as long again as the template, that counts the template's word pairs in
it. A span with enough of them is named by a sparse multinomial logistic regression
over words and word pairs, which knows the licence families and an unknown class. It
is trained on notices made from the templates and, for the unknown class, on spans
from all over a bounded sample of documents; its temperature is calibrated on
notices and spans that it has not seen. A prediction counts once the best template
of its family agrees with the span.

SPDX identifiers and short forms ("CC BY 4.0", "MIT License", "GPLv3") are read as
they are, with score 1; where a span of their family overlaps, both are one notice,
and overlapping spans of other families are dropped. SPDX identifiers outside the
families are reported under their own name in lower case.

All words of all paragraphs are scanned. ``n_paragraphs`` counts lines that are not
blank, as it always did.

Defined results: null and empty texts have no paragraphs; texts without confirmed
notices have the licence ``none``.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tradespec.llm.common import texts_of
from tradespec.llm.learning import fitted, plain_sample

#: Documents whose words train the unknown class, and spans of each.
SAMPLE_ROWS = 1_500
SAMPLE_PARAGRAPHS = 4
#: Words of such a span.
SPAN_WORDS = 40
LEAST_PROBABILITY = 0.5
LEAST_AGREEMENT = 0.6
UNKNOWN = "unknown"

# How notices of each family are commonly worded.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU General Public License version 2 or later.",
    ),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1 or later.",),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.",),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0.",
    ),
    "proprietary": ("All rights reserved.", "Copyright by the author. All rights reserved."),
}
#: Families of SPDX identifiers, by how these begin; the first that fits counts.
SPDX = (
    ("CC-BY-NC", "cc-by-nc"),
    ("CC-BY-SA", "cc-by-sa"),
    ("CC-BY-ND", "cc-by-nd"),
    ("CC-BY", "cc-by"),
    ("CC0", "public-domain"),
    ("Unlicense", "public-domain"),
    ("MPL-2.0", "mpl-2.0"),
    ("Apache-2.0", "apache-2.0"),
    ("AGPL", "agpl"),
    ("LGPL", "lgpl"),
    ("GPL", "gpl"),
    ("BSD", "bsd"),
)
_SPDX = re.compile(
    r"SPDX-License-Identifier:[ \t]*"
    r"(\(*[A-Za-z0-9.+:-]+\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9.+:-]+\)*)*)"
)
_SHORT = tuple(
    (family, re.compile(rf"(?<![^\W_])(?:{form})(?![^\W_])"))
    for family, form in {
        "mit": r"(?i:MIT\s+Licen[sc]e|(?<=licen[sc]e: )MIT)",
        "apache-2.0": r"(?i:Apache\s+Licen[sc]e,?\s+(?:Version\s+|v\.?\s*)?2\.0|Apache-2\.0)",
        "gpl": r"(?:GNU\s+)?GPL[\s-]?v?[123](?:\.\d)?\+?|GNU\s+GPL",
        "lgpl": r"(?:GNU\s+)?LGPL[\s-]?v?[23](?:\.\d)?\+?|GNU\s+LGPL",
        "agpl": r"(?:GNU\s+)?AGPL[\s-]?v?[13](?:\.\d)?\+?|GNU\s+AGPL",
        "bsd": r"(?i:BSD[\s-][0-4]-Clause|[0-4]-Clause\s+BSD)(?i:\s+Licen[sc]e)?|BSD\s+[Ll]icen[sc]e",
        "mpl-2.0": r"MPL[\s-]?v?2\.0|(?i:Mozilla\s+Public\s+Licen[sc]e,?\s+(?:Version\s+|v\.?\s*)?2\.0)",
        "cc-by-nc": r"CC[\s-]BY-NC(?:-(?:SA|ND))?(?:[\s-]\d\.\d)?",
        "cc-by-sa": r"CC[\s-]BY-SA(?:[\s-]\d\.\d)?",
        "cc-by-nd": r"CC[\s-]BY-ND(?:[\s-]\d\.\d)?",
        "cc-by": r"CC[\s-]BY(?:[\s-]\d\.\d)?(?!-)",
        "public-domain": r"CC0(?:[\s-]1\.0)?",
    }.items()
)
#: What every short form has, in lower case.
_SHORT_HINTS = ("mit", "apache", "gpl", "bsd", "mpl", "mozilla", "cc0", "cc-by", "cc by", "cc\nby", "cc\tby", "cc\rby")
#: The most that a prediction scores; exact forms score 1.
_SUREST = 1 - 1e-9
_LINE = re.compile(r"[^\n]*\S[^\n]*")
_PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_MARKS = re.compile(r"[^\w\s]*")


def words_of(paragraph: str) -> list[str]:
    return list(map(str.lower, _WORD.findall(paragraph)))


def features(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


#: Every template: its words, its word pairs, and how many of them a span needs.
_FORMS = [
    (len(words_of(t)), _pairs(words_of(t)))
    for templates in TEMPLATES.values()
    for t in templates
]
_FORMS_WITH: dict[tuple[str, str], list[int]] = defaultdict(list)
for _i, (_, _wanted) in enumerate(_FORMS):
    for _pair in _wanted:
        _FORMS_WITH[_pair].append(_i)


def agreement(words: list[str], family: str) -> float:
    """The largest share of a template's word pairs that a span has."""
    own = _pairs(words)
    return max(
        (len(own & wanted) / len(wanted) for wanted in (_pairs(words_of(t)) for t in TEMPLATES.get(family, ()))),
        default=0.0,
    )


def spans_of(words: list[str]) -> list[tuple[int, int]]:
    """Spans of words that agree with a template, from the most pairs to the fewest."""
    places: dict[int, list[tuple[int, tuple[str, str]]]] = defaultdict(list)
    for at, pair in enumerate(zip(words, words[1:])):
        if pair in _FORMS_WITH:
            for form in _FORMS_WITH[pair]:
                places[form].append((at, pair))
    found: dict[tuple[int, int], tuple[int, float]] = {}
    for form, hits in places.items():
        size, wanted = _FORMS[form]
        reach, least = size + max(2, size // 2), LEAST_AGREEMENT * len(wanted)
        if len(hits) < least:
            continue
        inside: Counter = Counter()
        first = distinct = 0
        for at, pair in hits:
            inside[pair] += 1
            distinct += inside[pair] == 1
            # The span starts at a pair that it does not have once more.
            while at + 2 - hits[first][0] > reach or inside[hits[first][1]] > 1:
                gone = hits[first][1]
                inside[gone] -= 1
                distinct -= inside[gone] == 0
                first += 1
            if distinct >= least:
                span = (hits[first][0], at + 2)
                found[span] = max(found.get(span, (0, 0.0)), (distinct, distinct / len(wanted)))
    return sorted(found, key=lambda x: (-found[x][0], -found[x][1], x[1] - x[0], x))


def short_forms(text: str) -> list[tuple[str, int, int]]:
    """``(family, start, end)`` of SPDX identifiers and short forms."""
    found = []
    for m in _SPDX.finditer(text):
        parts = m[1].replace("(", " ").replace(")", " ").split()
        for before, name in zip(["", *parts], parts):
            if name not in ("OR", "AND", "WITH") and before != "WITH":
                own = name.lower().rstrip("+.").replace(":", "-")
                known = (f for start, f in SPDX if own.startswith(start.lower()))
                found.append((next(known, own), m.start(), m.end()))
    lower = text.lower()
    if any(h in lower for h in _SHORT_HINTS) or "CC" in text:
        declared = [(a, b) for _, a, b in found]
        for family, form in _SHORT:
            for m in form.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b in declared):
                    found.append((family, m.start(), m.end()))
    return found


def notices(rng: np.random.Generator, filler: list[str], each: int = 60) -> list[tuple[str, list[str]]]:
    """Training notices: templates with words lost, and with other words around them."""
    found = []
    for family, templates in TEMPLATES.items():
        for n in range(each):
            words = words_of(templates[n % len(templates)])
            if n >= len(templates):
                lost = rng.random(len(words)) < 0.08
                words = [w for w, gone in zip(words, lost) if not gone] or words
                if filler and n % 3 == 0:
                    extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(1, 9))]
                    words = extra + words if n % 2 else words + extra
            found.append((family, words))
    return found


def fit(rows: pd.DataFrame, epochs: int = 150) -> bytes:
    rng = np.random.default_rng(8)
    ordinary = []
    for text in rows["text"]:
        parts = [words_of(m[0]) for m in _PARAGRAPH.finditer(text)]
        spans = [w[i : i + SPAN_WORDS] for w in parts for i in range(0, len(w), SPAN_WORDS)]
        picked = rng.permutation(len(spans))[:SAMPLE_PARAGRAPHS]
        ordinary += [spans[i] for i in picked]
    # Notices are part of documents too; those that a template explains do not train unknown.
    ordinary = [
        w for w in ordinary if w and not any(agreement(w, f) >= LEAST_AGREEMENT for f in TEMPLATES)
    ]
    background = {w for words in ordinary for w in words}
    filler = sorted(background)[:2000]
    # Scrambled notices teach that the words alone do not make a notice.
    made = notices(rng, filler)
    scrambled = [list(rng.permutation(w)[: max(1, len(w) // 3)]) for _, w in made[::3]]
    examples = made + [(UNKNOWN, w) for w in ordinary + scrambled]
    families = [UNKNOWN, *TEMPLATES]
    seen = Counter(f for _, w in made for f in features(w))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 2))}
    label = np.array([families.index(f) for f, _ in examples])
    bags = [[index[f] for f in features(w) if f in index] for _, w in examples]
    unseen = np.arange(len(examples)) % 5 == 0
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    column = np.array([i for b in bags for i in b], np.int64)
    scale = np.array([1 / np.sqrt(max(1, len(b))) for b in bags])
    weights = np.zeros((len(index) + 1, len(families)))
    target = np.eye(len(families))[label]
    learns = ~unseen[row]
    second = np.zeros_like(weights)

    def margins() -> np.ndarray:
        z = np.zeros(target.shape)
        np.add.at(z, row, weights[column])
        return z * scale[:, None] + weights[-1]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(epochs):
        error = (softmax(margins()) - target) / len(target)
        error[unseen] = 0
        slope = np.zeros_like(weights)
        np.add.at(slope, column[learns], (error * scale[:, None])[row[learns]])
        slope[-1] = error.sum(axis=0)
        slope += 1e-6 * weights
        second += slope**2
        weights -= 0.5 * slope / (np.sqrt(second) + 1e-9)
    z = margins()[unseen]
    loss = {
        t: -np.log(softmax(z / t)[np.arange(len(z)), label[unseen]] + 1e-12).mean()
        for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
    }
    temperature = min(loss, key=loss.get)
    return pickle.dumps((families, index, weights / temperature))


class Classifier:
    def __init__(self, model: bytes):
        self.families, self.index, self.weights = pickle.loads(model)

    def notices(self, text: str) -> tuple[int, list[tuple[str, int, int, float]]]:
        """How many lines are not blank, and the confirmed notices."""
        found = [(f, a, b, 1.0) for f, a, b in short_forms(text)]
        for m in _PARAGRAPH.finditer(text):
            words = words_of(m[0])
            spans = spans_of(words)
            if spans:
                places = [w.span() for w in _WORD.finditer(m[0])]
                taken = bytearray(len(words))
                for a, b in spans:
                    family, p = ("", 0.0) if any(taken[a:b]) else self.predict(words[a:b])
                    if (
                        p >= LEAST_PROBABILITY
                        and family != UNKNOWN
                        and agreement(words[a:b], family) >= LEAST_AGREEMENT
                    ):
                        taken[a:b] = b"\x01" * (b - a)
                        end = _MARKS.match(m[0], places[b - 1][1]).end()
                        found.append((family, m.start() + places[a][0], m.start() + end, p))
        return sum(1 for _ in _LINE.finditer(text)), _merged(found)

    def predict(self, words: list[str]) -> tuple[str, float]:
        ids = [self.index[f] for f in features(words) if f in self.index]
        z = self.weights[ids].sum(axis=0) / np.sqrt(max(1, len(ids))) + self.weights[-1]
        e = np.exp(z - z.max())
        best = int(e.argmax())
        return self.families[best], min(float(e[best] / e.sum()), _SUREST)


def _merged(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Notices by place; overlapping ones of a family as one, and none that overlaps
    an exact form (score 1) of another family."""
    one: list[tuple[str, int, int, float]] = []
    ends: dict[str, int] = {}
    for family, a, b, p in sorted(found, key=lambda x: (x[1], x[2])):
        at = ends.get(family)
        if at is not None and a < one[at][2]:
            one[at] = (family, one[at][1], max(b, one[at][2]), max(p, one[at][3]))
        else:
            ends[family] = len(one)
            one.append((family, a, b, p))
    exact = [x for x in found if x[3] == 1.0]
    return [
        x
        for x in one
        if x[3] == 1.0 or not any(e[1] < x[2] and x[1] < e[2] for e in exact)
    ]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> bytes:
    """A model from the templates and up to ``rows`` documents."""
    model = fitted(plain_sample(docs, rows).select("doc_id", "text"), fit)
    return model or fit(pd.DataFrame({"text": []}))


def scan(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, n_paragraphs, n_notices, license, score, notices`` of every row.

    ``license`` is the surest confirmed notice's family; ``notices`` lists all as
    family:start:end, in code points.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(sent.value)
        for batch in batches:
            judged = [classifier.notices(t) for t in batch["text"]]
            best = [max(f, key=lambda x: x[3], default=("none", 0, 0, 0.0)) for _, f in judged]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_paragraphs": pd.Series([n for n, _ in judged], dtype="int64"),
                    "n_notices": pd.Series([len(f) for _, f in judged], dtype="int64"),
                    "license": [b[0] for b in best],
                    "score": pd.Series([round(b[3], 6) for b in best], dtype="float64"),
                    "notices": [",".join(f"{n}:{a}:{b}" for n, a, b, _ in f) for _, f in judged],
                }
            )

    return texts_of(docs).mapInPandas(
        run,
        "doc_id long, n_paragraphs long, n_notices long, license string, score double, notices string",
    )
