"""Substring dedup of bytes by distributed prefix doubling, over sampled positions.

Positions are ranked by the h bytes that follow, in rounds of growing h; the rank of a longer string is the pair of
the ranks of shorter ones at two offsets, a unique rank ends its position's ranking, and only what is left goes into
the next round: 8, 16 and 20 bytes inside each task; then 20 bytes across the
cluster, and 50 bytes (25 and 25) of what is left, where Spark brings equal ranks together and they are sorted.
Not every position takes part: of the grams of a window the one of the smallest rank stands for it, and a position's
windows are ranked one by one only in the last round, by the sort of rank pairs there; equal pairs have passed the
threshold, and are compared byte by byte before they count.  Ranks are hash names rather than places in the order, so
that no round has to send ranks back to their texts.

``repeats`` has the rounds, and what is defined for nulls, repeated rows, ties, empty tables and long texts.  Columns
other than doc_id and text are not read by ``digests``; ``removed`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import quoted
from lattica.llm.repeats import Bytes, Repeats, consecutive, smaller_holder
from lattica.llm.symbols import BYTE_CODES, eights, paired, windows

WINDOW = 50
GRAM = 20


def rank_pairs(window: int):
    half = (window + 1) // 2

    def rank(contents: list[bytes], count: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Sort the suffixes by rank pair; those of an equal pair in a smaller document are hits."""
        sizes = np.array([len(c) for c in contents])
        data = b"".join(contents)
        ranks = windows(BYTE_CODES[np.frombuffer(data, np.uint8)], half)
        position, owner = consecutive(np.cumsum(sizes) - sizes, count), np.repeat(doc, count)
        pair = paired(ranks[position], ranks[position + window - half])
        order = np.argsort(pair)
        new = np.concatenate([[True], np.diff(pair[order]) != 0])
        # Ranks and pairs are names; a mark is made of equal bytes only.
        at, offsets = eights(data), sorted({*range(0, window - 7, 8), max(0, window - 8)})
        equal = np.flatnonzero(~new)
        one, other = position[order[equal]], position[order[equal - 1]]
        if any((at[one + k] != at[other + k]).any() for k in offsets):  # two windows of one name differ: sort by the bytes
            columns = [at[position + k] for k in offsets]
            order = np.lexsort(columns)
            new = np.concatenate([[True], np.any([np.diff(c[order]) != 0 for c in columns], axis=0)])
        return smaller_holder(order, new, owner)

    return rank


def repeats_of(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> Repeats:
    return Repeats(documents.sparkSession, Bytes, window, gram, rank_pairs(window))


def digest(text: Bytes, covered: np.ndarray) -> tuple[int, int, int, str]:
    if not covered.any():
        return text.n, 0, 0, hashlib.sha256(text.data).hexdigest()
    kept = np.frombuffer(text.data, np.uint8)[~covered].tobytes()
    spans = int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(covered[:1].any())
    return text.n, int(np.count_nonzero(covered)), spans, hashlib.sha256(kept).hexdigest()


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    columns = {"n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "kept_sha256": ("string", pa.string())}
    return repeats_of(documents, window).applied(documents, digest, columns).drop("rest")


def kept_text(text: Bytes, covered: np.ndarray) -> tuple[str, int]:
    """What is left of a text; a character of which some bytes are to go but not all stays, so it is still UTF-8."""
    data = np.frombuffer(text.data, np.uint8)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    gone = np.minimum.reduceat(covered, head) if len(head) else covered[:0]
    whole = np.repeat(gone, np.diff(np.append(head, len(data))))
    return data[~whole].tobytes().decode("utf-8"), int(np.count_nonzero(whole))


def removed(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``documents`` with its repeated passages taken out of ``text``, and ``n_chars``, if there, counted anew.

    Null texts become empty.  The other columns are kept as they are.
    """
    carried = tuple(c for c in documents.columns if c not in ("doc_id", "text"))
    found = repeats_of(documents, window).applied(documents, kept_text, {"text": ("string", pa.string()), "n_removed": ("long", pa.int64())}, carried)
    counted = {"n_chars": F.length("text").cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {}
    found = found.select("doc_id", "text", *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carried)]).withColumns(counted)
    return found.select(*[quoted(c) for c in documents.columns])
