"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a chain of leaf blocks, each of which belongs to the article or does not. The
field weighs features of a block (the elements around it, the words of their classes,
ids and roles, the length and punctuation of its text, the share of it that is linked,
its place) and of neighbours (whether both belong). It is trained by maximum likelihood
on labelled pages and decoded by Viterbi's algorithm.

Labelled pages are of two kinds. Some pages mark their article themselves, by their only
``article`` or ``main`` element. The others are layouts as the web has them, with the
words of the pages (:mod:`tradespec.llm.labelled_pages`), so that menus, comments,
notices and forms are learned also where the pages given have none. At most
:data:`TRAINING_PAGES` pages, chosen by a hash of their id, take part in the training;
every page is extracted whole.

Defined results: a null or empty page, and one without article blocks, gives an empty
text. Repeated rows and rows without an id are rows of their own. Pages of any length
are read whole; broken markup as :func:`tradespec.llm.dom_blocks.blocks` says. Other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.llm.dom_blocks import Block, blocks
from tradespec.llm.labelled_pages import layouts

#: Pages whose words and labels are learned from, layouts made of each page's words, and
#: blocks of the longest page that is learned from.
TRAINING_PAGES, LAYOUTS, TRAINING_BLOCKS = 300, 3, 64
#: Features that fewer training blocks have are left out; steps and pull of the training.
LEAST_BLOCKS, STEPS, PULL = 3, 250, 0.0001
_FEW_WORDS = 30
_SPARE = [f"{a}{b}" for a in "ba ke lo mi nu ra se to".split() for b in "n r st l m ".split(" ")]


def features(page: list[Block]) -> list[list[str]]:
    """The features of every block of a page."""
    total = len(page)
    out = []
    for i, block in enumerate(page):
        text, size = block.text, len(block.text)
        linked = block.linked / size
        own = block.tags[-1] if block.tags else ""
        stops = sum(map(text.count, ".!?;:,"))
        found = {f"in:{t}" for t in block.tags}
        found.update([f"name:{w}" for w in block.words])
        found.update([f"near:{w}" for w in block.near])
        found.update(
            (
                f"own:{own}",
                f"own:{own}:of:{block.tags[-2] if len(block.tags) > 1 else ''}",
                f"size:{min(size, 4096).bit_length()}",
                f"linked:{int(linked * 4)}",
                f"stops:{min(stops, 8).bit_length()}",
                f"ends:{text[-1] in '.!?'}",
                f"place:{i * 5 // total}",
            )
        )
        if "©" in text:
            found.add("copyright")
        if i == 0:
            found.add("first")
        if i == total - 1:
            found.add("last")
        if not block.words:
            found.add("nameless")
        out.append(list(found))
    return out


def labelled(page: str) -> tuple[list[list[str]], list[bool]] | None:
    """Features and labels of a page that marks its own article, else nothing."""
    found = list(blocks(page))
    for tag in ("article", "main"):
        if page.lower().count(f"<{tag}") == 1:
            gold = [tag in b.tags and not _APART.intersection(b.tags) for b in found]
            if any(gold) and len(found) <= TRAINING_BLOCKS:
                return features(found), gold
    return None


_APART = frozenset("nav aside footer form dialog".split())


def laid_out(page: str) -> tuple[list[list[str]], list[bool]]:
    """Features and labels of a layout of :mod:`tradespec.llm.labelled_pages`."""
    found = list(blocks(page))
    return features(found), [b.gold for b in found]


def training_set(pages: DataFrame, rows: int = TRAINING_PAGES) -> DataFrame:
    """``known, label``: features of the blocks of each labelled page, as numbers of a table."""
    chosen = (
        pages.filter(F.length("html") > 0)
        .select("page_id", F.col("html").cast("string").alias("html"))
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("html").to_pylist():
                own = labelled(page)
                found = [own] if own else []
                words = " ".join(b.text for b in blocks(page)).split()
                if len(words) >= _FEW_WORDS:
                    made = [laid_out(p) for p in layouts(words, len(page), LAYOUTS)]
                    found += [m for m in made if len(m[0]) <= TRAINING_BLOCKS]
                yield pa.record_batch(
                    [
                        pa.array([json.dumps(f) for f, _ in found], pa.string()),
                        pa.array([[int(x) for x in g] for _, g in found], pa.list_(pa.int32())),
                    ],
                    names=["known", "label"],
                )

    return chosen.mapInArrow(run, "known string, label array<int>")


class Field:
    """Weights of the features, of two neighbours that differ, and of the first block."""

    def __init__(self, weights: dict[str, float], follow: list[list[float]], base: float):
        self.weights, self.follow, self.base = weights, follow, base

    def dumps(self) -> str:
        return json.dumps([self.weights, self.follow, self.base])

    @classmethod
    def loads(cls, text: str) -> Field:
        return cls(*json.loads(text))

    def decode(self, known: list[list[str]]) -> list[bool]:
        """The likeliest labels of a chain of blocks."""
        get, (stay_out, enter), (leave, stay_in) = self.weights.get, *self.follow
        out, inside, back = 0.0, None, []
        for block in known:
            score = self.base + sum([get(f, 0.0) for f in block])
            if inside is None:
                out, inside = 0.0, score
                back.append((False, False))
                continue
            from_out, from_in = out + stay_out >= inside + leave, out + enter >= inside + stay_in
            back.append((not from_out, not from_in))
            out, inside = (
                max(out + stay_out, inside + leave),
                max(out + enter, inside + stay_in) + score,
            )
        labels, at = [], inside is not None and inside > out
        for came in reversed(back):
            labels.append(at)
            at = came[at]
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Maximum likelihood with a quadratic pull to zero, by steps scaled per weight."""
    pages = [p for p in pages if p[0]]
    counts: dict[str, int] = {}
    for known, _ in pages:
        for block in known:
            for f in block:
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= LEAST_BLOCKS)
    if not pages or not names:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]], 0.0)
    number = {f: i for i, f in enumerate(names)}
    longest = max(len(known) for known, _ in pages)
    label = np.zeros((len(pages), longest), np.int64)
    real = np.zeros((len(pages), longest), bool)
    feature, place = [], []
    for p, (known, gold) in enumerate(pages):
        label[p, : len(gold)], real[p, : len(gold)] = gold, True
        for t, block in enumerate(known):
            held = [number[f] for f in block if f in number]
            feature += held
            place += [p * longest + t] * len(held)
    feature, place = np.array(feature), np.array(place)
    pairs = real[:, 1:]
    theta = np.zeros(len(names) + 5)
    seen = np.zeros_like(theta)
    for step in range(STEPS):
        weights, follow, base = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        score = np.bincount(place, weights[feature], minlength=label.size).reshape(label.shape) + base
        inside, both = _expected(score, follow, real)
        miss = np.where(real, label - inside, 0.0)
        slope = np.empty_like(theta)
        slope[:-5] = np.bincount(feature, miss.ravel()[place], minlength=len(names))
        for a in (0, 1):
            for b in (0, 1):
                is_so = (label[:, :-1] == a) & (label[:, 1:] == b)
                slope[-5 + 2 * a + b] = ((is_so - both[:, :, a, b]) * pairs).sum()
        slope[-1] = miss.sum()
        slope = slope / real.sum() - PULL * theta / len(names) ** 0.5
        seen = 0.95 * seen + 0.05 * slope**2 if step else slope**2
        theta = theta + 0.1 * slope / (np.sqrt(seen) + 1e-6) * (1 - step / STEPS)
    return Field(
        {f: float(w) for f, w in zip(names, theta[:-5])},
        theta[-5:-1].reshape(2, 2).tolist(),
        float(theta[-1]),
    )


def _expected(
    score: np.ndarray, follow: np.ndarray, real: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Chances that a block is inside, and of each pair of labels of neighbours."""
    pages, length = score.shape
    local = np.stack([-np.maximum(score, 0), score - np.maximum(score, 0)], axis=2)
    local, turn = np.exp(local), np.exp(follow)
    ahead, behind = np.ones((2, pages, length, 2))
    ahead[:, 0] = local[:, 0]
    for t in range(1, length):
        step = ahead[:, t - 1] @ turn * local[:, t]
        ahead[:, t] = step / step.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        step = (local[:, t + 1] * behind[:, t + 1]) @ turn.T
        step /= step.sum(axis=1, keepdims=True)
        behind[:, t] = np.where(real[:, t + 1, None], step, 1.0)
    inside = ahead * behind
    joint = ahead[:, :-1, :, None] * turn * (local[:, 1:] * behind[:, 1:])[:, :, None, :]
    return (
        inside[:, :, 1] / inside.sum(axis=2),
        joint / joint.sum(axis=(2, 3), keepdims=True),
    )


def train(pages: DataFrame, rows: int = TRAINING_PAGES) -> Field:
    """The field learned from a table of pages (``page_id, html``), in one task of the cluster."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["known"].to_pylist(), table["label"].to_pylist()))
        return pa.table({"field": [fit([(json.loads(k), g) for k, g in rows]).dumps()]})

    learned = training_set(pages, rows).groupBy(F.lit(0).alias("all"))
    found = learned.applyInArrow(run, "field string").first()
    if found:
        return Field.loads(found[0])
    return fit([laid_out(p) for p in layouts(_SPARE, 0, LAYOUTS)])


def main_text(page: str, field: Field) -> str:
    """The article of one page, its blocks two line ends apart."""
    found = list(blocks(page))
    inside = field.decode(features(found))
    return "\n\n".join(b.text for b, is_in in zip(found, inside) if is_in)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    model = field.dumps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Field.loads(model)
        for batch in batches:
            texts = [main_text(p, learned) for p in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    named = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    kinds = dict(named.dtypes)
    return named.mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
