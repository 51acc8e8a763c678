"""Quality by a generalised additive model with pairwise interactions.

Texts become ``FEATURES`` plain figures (lengths, shares of kinds of characters, repetition).  Boosting goes round
the features in a cycle; each turn fits one shallow tree (two cuts at the most) to the current residual on that
feature's bins alone and adds a small step of it to the feature's table.  Then the pairs of features that explain
most of what is left get tables of their own, boosted in the same cycle by two-cut trees (one cut on each axis).
A score is the sum of one table entry per feature and pair, through a logistic curve: vectorised bin additions.

Null and empty texts have the figures of an empty text and get a score like any other.  Repeated rows get equal
scores.  The training rows are about ``MOST`` at the most, chosen by hash; whole texts are measured and scored.
Without documents the result is empty; without labels every text gets the score of an empty model.  Columns of the
result's names are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_labels, fold_of, training_labels, unused

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "stop", "exclaim", "bar", "line_length", "repeated_words",
    "repeated_lines", "echo", "long_words", "symbol_words", "upper_words", "comma", "top_word", "non_ascii", "short_lines",
)
BINS = 32
PAIRS = 8
PAIR_BINS = 8
CYCLES = 150
RATE = 0.1
#: Bound on the labelled rows that the model is fitted on.
MOST = 20_000
_MARKS = re.compile(rb"[#$%&*+<=>@^_~|{}\\/\[\]]")


def figures(text: str | None) -> tuple[float, ...]:
    """The features of one whole text."""
    t = text or ""
    words, lines, raw = t.split(), t.split("\n"), t.encode("utf-8", "replace")
    chars, n, k = max(1, len(t)), max(1, len(words)), max(1, len(lines))
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts = Counter(words)
    marks = int(b[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 123, 124, 125, 126]].sum())
    return (
        np.log1p(len(t)), np.log1p(len(words)), sum(map(len, words)) / n, int(b[65:91].sum()) / chars, int(b[48:58].sum()) / chars, marks / chars,
        (t.count(".") + t.count("?")) / n, t.count("!") / n, t.count("|") / n, np.log1p(len(t) / k), 1 - len(counts) / n,
        1 - len(set(lines)) / k, sum(map(str.__eq__, words, words[1:])) / n, sum([len(w) > 20 for w in words]) / n,
        len(_MARKS.findall(raw)) / n, sum(map(str.isupper, words)) / n, t.count(",") / n,
        max(counts.values(), default=0) / n, int(b[128:].sum()) / chars, sum([len(x) < 40 for x in lines]) / k,
    )


@dataclass
class Additive:
    """Cut points per feature, a table per feature and a table per pair."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        at = self.bins(x)
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[at[:, j]]
        for i, j, table in self.pairs:
            z += table[coarse(at[:, i], self.cuts[i]), coarse(at[:, j], self.cuts[j])]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def coarse(at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Fine bins gathered into ``PAIR_BINS``."""
    return at * PAIR_BINS // (len(cuts) + 1)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def stump(g: np.ndarray, h: np.ndarray, cuts: int = 2) -> np.ndarray:
    """Leaf values per bin of the tree with up to ``cuts`` cuts along one axis that gains most, cut by cut."""
    edges = [0, len(g)]
    for _ in range(cuts):
        best = (1e-9, -1)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            won = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
            i = int(won.argmax())
            best = max(best, (float(won[i]), a + i + 1))
        if best[1] < 0:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut on each of two axes."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n = len(g)
    won = 0
    for part in ("ll", "lr", "rl", "rr"):
        a, b = cg[:-1, :-1], ch[:-1, :-1]
        rows = (cg[:-1, -1:], ch[:-1, -1:]) if part[0] == "l" else (cg[-1:, -1:] - cg[:-1, -1:], ch[-1:, -1:] - ch[:-1, -1:])
        left = (a, b) if part[0] == "l" else (cg[-1:, :-1] - a, ch[-1:, :-1] - b)
        won = won + (gain(*left) if part[1] == "l" else gain(rows[0] - left[0], rows[1] - left[1]))
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    out = np.zeros((n, n))
    for a in (slice(0, i + 1), slice(i + 1, n)):
        for b in (slice(0, j + 1), slice(j + 1, n)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + 1.0)
    return float(won[i, j]), out


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of the feature tables, then of the tables of the most telling pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    model = Additive(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    if len(np.unique(y)) < 2:
        return model
    at, z = model.bins(x), np.full(len(y), model.base)
    for _ in range(CYCLES):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            step = RATE * stump(np.bincount(at[:, j], y - p, len(table)), np.bincount(at[:, j], p * (1 - p), len(table)))
            table += step
            z += step[at[:, j]]
    rough = [coarse(at[:, j], cuts[j]) for j in range(x.shape[1])]
    cells = {(i, j): rough[i] * PAIR_BINS + rough[j] for i in range(x.shape[1]) for j in range(i)}

    def sums(cell: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = PAIR_BINS * PAIR_BINS
        return np.bincount(cell, y - p, size).reshape(PAIR_BINS, -1), np.bincount(cell, p * (1 - p), size).reshape(PAIR_BINS, -1)

    p = 1 / (1 + np.exp(-z))
    best = sorted(cells, key=lambda c: (-cross(*sums(cells[c], p))[0], c))[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in best]
    for _ in range(CYCLES // 3):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-z))
            step = RATE * cross(*sums(cells[i, j], p))[1]
            table += step
            z += step.ravel()[cells[i, j]]
    return model


def measured(texts: pd.Series) -> np.ndarray:
    return np.array([figures(t) for t in texts], float).reshape(-1, len(FEATURES))


def fit(documents: DataFrame, labels: DataFrame, training: Column, most: int = MOST) -> Additive:
    """Measure the bounded training rows on the executors and boost on the driver, where they are a small table."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(measured(batch["text"]), columns=list(FEATURES)).assign(doc_id=batch["doc_id"].to_numpy(), label=batch["label"].to_numpy())

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", doc_id long, label int"
    rows = bounded_labels(documents, training_labels(labels, "quality", training), most).mapInPandas(measure, schema).toPandas()
    rows = rows.sort_values(["doc_id", "label", *FEATURES], ignore_index=True)
    return boost(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float))


def scored(documents: DataFrame, model: Additive, modulus: int = 3, held_remainder: int = 1) -> DataFrame:
    """Every row of ``documents`` with held_out, score and predicted; clashing columns are replaced."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(measured(text)))

    return documents.withColumn("score", judge(F.coalesce("text", F.lit("")))).withColumns(
        {"held_out": F.coalesce(fold_of("doc_id", modulus) == held_remainder, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")}
    )


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 3, held_remainder: int = 1, most: int = MOST) -> DataFrame:
    """Fit on the labelled rows of the other folds and score every document."""
    return scored(documents, fit(documents, labels, fold_of("doc_id", modulus) != held_remainder, most), modulus, held_remainder)
