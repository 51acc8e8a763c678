"""Substring dedup of words by prefix-partitioned suffix trees, over sampled suffixes.

Sampled suffixes (of the grams of a window the one of the smallest name begins the one that stands for it) are
partitioned by a prefix of ``GRAM`` words; a suffix that is alone with its prefix repeats nowhere and goes.  The windows around those that are left are the suffixes of
subtrees: a task takes whole prefixes as long as they fit into ``TREE_LEAVES``, and splits a larger group again by
longer prefixes.  A subtree is built as its sorted suffixes with the lengths of their common prefixes, whose
intervals are its internal nodes; suffixes end after ``WINDOW`` words, which is as deep as matters.  The nodes at that
depth hold the repeats (a maximal repeat is the run of their neighbours, which are marked one by one): a leaf below one
whose document isn't the node's smallest is a word sequence to remove, once its words are found equal.

``repeats`` has the rounds, and what is defined for nulls, repeated rows, ties, empty tables and long texts.  Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.repeats import Repeats, Words, consecutive
from lattica.llm.symbols import windows, word_codes

WINDOW = 50
GRAM = 20
#: Suffixes of one tree; larger groups are split by a prefix that is longer by ``STEP`` words.
TREE_LEAVES = 1 << 15
STEP = 10


class Prefixes:
    """Names of the first STEP words from each position on, by which prefixes are compared and trees walked."""

    def __init__(self, codes: np.ndarray, window: int):
        self.step = min(STEP, window)
        self.names = windows(codes, self.step)
        # Offsets at which a name is read; the last overlaps if the window is no multiple of the step.
        self.offsets = [*range(0, window - self.step + 1, self.step)]
        if self.offsets[-1] != window - self.step:
            self.offsets.append(window - self.step)

    def edge(self, position: np.ndarray, level: int) -> np.ndarray:
        return self.names[position + self.offsets[level]]


def groups(prefixes: Prefixes, position: np.ndarray, leaves: np.ndarray, level: int = 0):
    """Split suffixes by variable-length prefixes until a group has at most TREE_LEAVES, or has no longer prefix."""
    if len(leaves) <= TREE_LEAVES or level == len(prefixes.offsets):
        yield level, leaves
        return
    name = prefixes.edge(position[leaves], level)
    order = np.argsort(name, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0, [True]]))
    small: list[np.ndarray] = []
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        if b - a > TREE_LEAVES:
            yield from groups(prefixes, position, leaves[order[a:b]], level + 1)
        elif b - a > 1:  # a suffix that is alone with its prefix repeats nowhere
            small.append(leaves[order[a:b]])
    held, n = [], 0
    for part in small:
        held.append(part)
        n += len(part)
        if n >= TREE_LEAVES:
            yield level, np.concatenate(held)
            held, n = [], 0
    if held:
        yield level, np.concatenate(held)


def deep_nodes(prefixes: Prefixes, position: np.ndarray, leaves: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of one suffix tree in order, and for each how many edges it shares with the leaf before it (its LCP)."""
    keys = [prefixes.edge(position[leaves], k) for k in range(len(prefixes.offsets))]
    order = np.lexsort((doc[leaves], *keys[::-1]))
    common = np.zeros(len(order), np.int64)
    alive = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        alive &= np.diff(key[order]) == 0
        common[1:] += alive
    return leaves[order], common


def rank_trees(window: int):
    def rank(contents: list[bytes], count: np.ndarray, doc: np.ndarray) -> np.ndarray:
        data = b"\n".join(contents)
        codes, starts, ends = word_codes(data)
        sizes = np.array([len(c) + 1 for c in contents])
        base = np.searchsorted(starts, np.cumsum(sizes) - sizes)  # the first word of each content
        position = consecutive(base, count)
        owner, hit = np.repeat(doc, count), np.zeros(int(count.sum()), bool)
        prefixes = Prefixes(codes, window)
        depth = len(prefixes.offsets)
        for level, leaves in groups(prefixes, position, np.arange(len(position))):
            leaf, common = deep_nodes(prefixes, position, leaves, owner, level)
            # An interval of leaves with full common prefixes is a deepest internal node.
            deep = common == depth
            begin, end = starts[position[leaf]].tolist(), ends[position[leaf] + window - 1].tolist()
            if all(data[begin[i] : end[i]] == data[begin[i - 1] : end[i - 1]] for i in np.flatnonzero(deep).tolist()):
                node = np.flatnonzero(~deep)
                size = np.diff(np.append(node, len(leaf)))
                hit[leaf] = owner[leaf] > np.repeat(owner[leaf[node]], size)
                continue
            least: dict[bytes, int] = {}  # edges of one name differ: go by the words themselves
            said = [data[a:b] for a, b in zip(begin, end, strict=True)]
            for words, d in zip(said, owner[leaf].tolist(), strict=True):
                least[words] = min(d, least.get(words, d))
            hit[leaf] = owner[leaf] > np.array([least[words] for words in said])
        return hit

    return rank


def repeats_of(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> Repeats:
    return Repeats(documents.sparkSession, Words, window, gram, rank_trees(window))


def digest(text: Words, covered: np.ndarray) -> tuple[int, int, str]:
    stay = np.flatnonzero(~covered)
    kept = b" ".join([text.data[a:b] for a, b in zip(text.starts[stay].tolist(), text.ends[stay].tolist(), strict=True)])
    return text.n, int(np.count_nonzero(covered)), hashlib.sha256(kept).hexdigest()


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    columns = {"n_words": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "kept_sha256": ("string", pa.string())}
    return repeats_of(documents, window).applied(documents, digest, columns).drop("rest")
