"""Packing tokenized documents into sequences of a fixed length: best fit, then swap-based local search.

Tokens are the ids of a byte-level BPE and one end id per document; a null text is an empty one, which is the
end id alone.  Only documents longer than a sequence are cut, into pieces of exactly one sequence, of which the
first may be shorter.  Pieces are dealt into groups by the hash of their document, a group of about
``GROUP_ROWS`` documents whatever the input's size, and each group is packed by itself: at most one sequence per
group is left badly filled, and no task holds more than a group of small integers.

Ties are broken by doc_id, piece and ids, so a repeated run gives the same result.  Repeated rows are packed as the
rows they are; they, and rows without a doc_id, are dealt over groups by more of the row than the doc_id.  Columns
other than doc_id and text are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import Remembering, byte_alphabet

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 40_000
#: Runs of fragments remembered by a worker.
REMEMBERED = 150_000
#: White space other than a lone space or line feed; texts that hold it are encoded without the table of fragments.
ODD_SPACES = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")


class ByteBpe:
    """Ids of a byte-level BPE file as little-endian unsigned 32-bit integers.

    A space or a line feed between two other characters always starts a new match of the tokenizer's pattern, so
    the fragments between are encoded by themselves and their ids remembered.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        # The pattern of the byte-level pre-tokenizer, a fixed value of the format.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.bpe = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.first = Remembering(self._packed, REMEMBERED // 10)
        self.later = Remembering(lambda fragment: self._packed(" " + fragment), REMEMBERED)
        self.line = self._packed("\n")

    def _packed(self, text: str) -> bytes:
        ids = self.bpe.encode(text, allowed_special="all") if "<|" in text else self.bpe._core_bpe.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any([s in text for s in ODD_SPACES]):
            return self._packed(text)
        found: list[bytes] = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            found.append(b"".join([self.first[head], *map(self.later.__getitem__, rest)]))
        return self.line.join(found)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32 of the ids) of each piece."""
    n = len(ids) // 4
    start, end = 0, n if n <= capacity else n % capacity or capacity
    while start < n:
        yield start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        start, end = end, end + capacity


def tokenized(documents: DataFrame, path: str, groups: int, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and the group that packs it."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        again: Counter = Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                ids = bpe.encode(text) + end
                row = f"{doc} {zlib.crc32(ids)}"
                again[row] += 1  # equal rows go to different groups, so none of them grows with their number
                group = xxhash.xxh64_intdigest(f"{row} {again[row]}") % groups
                rows += [(doc, group, i, *piece) for i, piece in enumerate(pieces_of(ids, capacity))]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "pack_group", "piece", "start", "length", "ids_crc32"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, pack_group int, piece int, start long, length long, ids_crc32 long")


Item = tuple[int, int]  # length, number


class Bins:
    """Sequences by the room they have left; of those with room, their items and pairs of items by length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[Item]] = []
        self.room: list[int] = []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set where a sequence has the room r
        #: by room and length: the sequences, each with one or two items of that length together; and those lengths as bits
        self.outs: list[dict[int, dict[int, tuple[Item, ...]]]] | None = None
        self.lengths: list[int] = []

    def _outs_of(self, b: int) -> dict[int, tuple[Item, ...]]:
        found: dict[int, tuple[Item, ...]] = {}
        once: dict[int, Item] = {}
        for x in self.items[b]:
            if x[0] in once:
                found.setdefault(2 * x[0], (once[x[0]], x))
            else:
                once[x[0]] = x
        single = list(once.values())
        for i, x in enumerate(single):
            for y in single[i + 1 :]:
                found.setdefault(x[0] + y[0], (x, y))
        return found | {x[0]: (x,) for x in single}

    def _enter(self, b: int) -> None:
        room = self.room[b]
        self.by_room[room].add(b)
        self.rooms |= 1 << room
        if self.outs is not None and room:
            here = self.outs[room]
            for n, out in self._outs_of(b).items():
                here.setdefault(n, {})[b] = out
                self.lengths[room] |= 1 << n

    def _leave(self, b: int) -> None:
        room = self.room[b]
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        if self.outs is not None and room:
            here = self.outs[room]
            for n in self._outs_of(b):
                del here[n][b]
                if not here[n]:
                    del here[n]
                    self.lengths[room] &= ~(1 << n)

    def index_outs(self) -> None:
        self.outs, self.lengths = [{} for _ in range(self.capacity + 1)], [0] * (self.capacity + 1)
        for b in range(len(self.items)):
            if self.items[b]:
                self._enter(b)

    def change(self, b: int, out: tuple[Item, ...] | list[Item], into: tuple[Item, ...] | list[Item]) -> None:
        self._leave(b)
        for x in out:
            self.items[b].remove(x)
        self.items[b] += into
        self.room[b] += sum(x[0] for x in out) - sum(x[0] for x in into)
        if self.items[b]:
            self._enter(b)

    def tightest(self, size: int, but: int = -1) -> int:
        """The bin with the least room of at least ``size``, or -1."""
        rest = self.rooms >> size
        while rest:
            room = size + (rest & -rest).bit_length() - 1
            for b in self.by_room[room]:
                if b != but:
                    return b
            rest = self.rooms >> (size := room + 1)
        return -1

    def partner(self, source: int, item: Item) -> tuple[int, tuple[Item, ...]] | None:
        """The bin, and its one or two smaller items to take for ``item``, that is filled best by the exchange.

        For each room in use the shortest length that makes place is looked up, so the cost grows with the number of
        different rooms and not of bins.
        """
        size, own = item[0], self.room[source]
        best: tuple[int, int, tuple[Item, ...]] | None = None
        rooms = self.rooms & ~1
        while rooms:
            room = (rooms & -rooms).bit_length() - 1
            rooms &= rooms - 1
            low = max(1, size - room)
            width = size - max(0, room - own) - low  # shorter than the item, and the fuller bin gets fuller
            if width <= 0:
                continue
            there = (self.lengths[room] >> low) & ((1 << width) - 1)
            while there:
                n = low + (there & -there).bit_length() - 1
                there &= there - 1
                left = room + n - size
                if best is not None and left >= best[0]:
                    break
                found = next(((b, out) for b, out in self.outs[room][n].items() if b != source), None)
                if found:
                    best = left, *found
                    break
            if best is not None and best[0] == 0:
                break
        return best[1:] if best else None

    def used(self) -> int:
        return sum(1 for x in self.items if x)

    def place(self, item: Item) -> None:
        b = self.tightest(item[0])
        if b < 0:
            self.items.append([])
            self.room.append(self.capacity)
            b = len(self.items) - 1
            self._enter(b)
        self.change(b, [], [item])


def local_search(bins: Bins) -> int:
    """Empty the least filled bins by moves and exchanges that increase the sum of squared fills; how many got empty.

    The emptiest bin is the source.  Each of its items is moved to the bin that it fills best, or exchanged for one or
    two smaller items of the bin that is filled best by that; what came in exchange is tried again.  Partners are
    found among all open bins by the room that they would have without those items.  Every step makes a fuller bin
    fuller, so the search ends: when a sweep over all open bins empties none, or when the room of all of them together
    is less than one bin.
    """
    bins.index_outs()
    emptied = 0
    whole = False
    while True:
        before = emptied
        sources = sorted((b for b in range(len(bins.items)) if bins.items[b] and bins.room[b]), key=lambda b: (-bins.room[b], b))
        free = sum(bins.room[b] for b in sources)
        if not whole:  # about as many as can get empty; the rest have their turn when these don't
            sources = sources[: 2 * (free // bins.capacity) + 8]
        for source in sources:
            if free < bins.capacity:
                return emptied
            todo = sorted(bins.items[source])
            while todo:
                item = todo.pop()
                to = bins.tightest(item[0], source)
                if to >= 0 and bins.room[source] - bins.room[to] + item[0] > 0:
                    bins.change(source, [item], [])
                    bins.change(to, [], [item])
                elif found := bins.partner(source, item):
                    partner, out = found
                    bins.change(source, [item], out)
                    bins.change(partner, out, [item])
                    todo = sorted([*todo, *out])
            if not bins.items[source]:
                emptied += 1
                free -= bins.capacity
        if emptied == before and whole:
            return emptied
        whole = emptied == before


def searched(lengths: np.ndarray, capacity: int = CAPACITY) -> Bins:
    """Best fit in the order of arrival, then the local search; from the longest on as well where that leaves more than the least."""
    best: Bins | None = None
    for order in (np.arange(len(lengths)), np.argsort(-lengths, kind="stable")):
        bins = Bins(capacity)
        for i in order.tolist():
            bins.place((int(lengths[i]), i))
        local_search(bins)
        if best is None or bins.used() < best.used():
            best = bins
        if best.used() * capacity < int(lengths.sum()) + capacity:
            break  # no packing has fewer
    return best


def packed_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, for lengths from 1 to ``capacity``."""
    bins = searched(lengths, capacity)
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(x for x in bins.items if x):
        at = 0
        for size, i in sorted(items, reverse=True):
            which[i], offset[i] = number, at
            at += size
    return which, offset


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    groups = max(1, -(-documents.count() // group_rows))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "length", "ids_crc32"], ignore_index=True)
        which, offset = packed_lengths(group["length"].to_numpy(), capacity)
        return group.drop(columns="pack_group").assign(sequence_id=which + (group["pack_group"].to_numpy(np.int64) << 32), offset=offset)

    return tokenized(documents, path, groups, capacity, end_id).groupBy("pack_group").applyInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
