"""Finding the windows of W units (bytes or words) that also start in a document with a smaller doc_id.

The parts that both substring operators share.  Their own modules say how repeated windows are ranked.

Ranks are names that depend on content alone, so every task ranks its own text, and Spark brings equal ranks together.

1. Candidates, by the rank of ``gram`` units.  Every window is given to one of its grams of ``gram`` units: the one of the smallest name, which
   depends on the window's content alone, so equal windows choose equal grams.  The windows given to one occurrence
   of a gram are a *cell*, a run of neighbours.  Spark brings equal gram names together; a gram that occurs once
   proves its cell's windows unique, and those go.  No other window does.
2. Ranking, by ``window`` units.  The cells that are left travel with their content to the bucket of their gram's name, where the
   operator ranks their windows and finds, for each, whether a smaller document has it.
3. Marks go back to their documents.

A map task sends packed arrays, one row per flush and bucket, and settles what repeats within the flush itself:
of a gram it sends one occurrence, of equal cells those of the smallest document.  A passage that a third of all
documents share thus reaches its bucket once per flush, not once per document.

A document is known by its doc_id and the CRC of its text; ties between documents go to the smaller doc_id.  Rows with a null doc_id take no part and are kept whole;
rows of one doc_id don't remove from one another; null texts count as empty; an empty table gives an empty result.
Texts of any length are handled whole, in overlapping stretches of ``STRETCH`` units.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.common import configured, light, partitions, quoted, settled
from lattica.llm.symbols import U, byte_windows, mix, windows, word_codes

#: Windows of a text whose cells are sought at a time; the arrays for it fit into a core's cache.
STRETCH = 1 << 15
#: Cells in one flush of a map task, and bytes of their contents.
FLUSH_CELLS, FLUSH_BYTES = 200_000, 16 << 20
#: Windows ranked at a time, and rows of whole texts in one batch for a worker.
RANKED, BATCH_ROWS = 300_000, 2_000
#: Bytes of texts in one blob; a longer text has one of its own.
BLOB_BYTES = 1 << 20
_POSITION = U((1 << 24) - 1)


class Bytes:
    """A text as bytes."""

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)

    def names(self, start: int, end: int, size: int) -> np.ndarray:
        """A name for the ``size`` units from each position on, of those from ``start`` to ``end``."""
        return byte_windows(self.data[start:end], size)

    def contents(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Words:
    """A text as words, which are runs of bytes other than space and 0x09 to 0x0D.

    They are kept with one space between, so that equal runs of words are equal bytes.
    """

    def __init__(self, data: bytes):
        self.data = b" ".join(data.split())
        self.code, self.starts, self.ends = word_codes(self.data)
        self.n = len(self.code)

    def names(self, start: int, end: int, size: int) -> np.ndarray:
        return windows(self.code[start:end], size)

    def contents(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[start].tolist(), self.ends[end - 1].tolist(), strict=True)]


def cells(text: Bytes | Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram name of 48 bits, first window, number of windows) of each cell, in order.

    Grams of one name by chance only make candidates of windows that repeat nowhere.
    """
    parts = []
    for base in range(0, text.n - window + 1, STRETCH):
        names = text.names(base, min(text.n, base + STRETCH + window - 1), gram)
        key = names & ~_POSITION
        key |= np.arange(len(names), dtype=U)
        have, width = 1, window - gram + 1
        while have < width:
            step = min(have, width - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        first = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)  # where another gram is the smallest
        parts.append((names[(key[first] & _POSITION).astype(np.int64)] >> U(16), first + base, np.diff(np.append(first, len(key)))))
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed blob, each stored together."""
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + b"".join([np.ascontiguousarray(a).tobytes() for a in arrays]))


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences, which compress well where values climb; ``np.cumsum`` undoes them."""
    return np.diff(x, prepend=x.dtype.type(0))


def halves(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name's 48 bits as the 32 upper and the 16 lower ones."""
    return (name >> U(16)).astype(np.uint32), (name & U(0xFFFF)).astype(np.uint16)


def whole(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return (upper.astype(U) << U(16)) | lower.astype(U)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the indices of its entries."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # is sorted by its digits
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(bucket) else np.zeros(1, int)
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(bucket[order[a]]), order[a:b]


def by_name(name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices in order of their names, where a name begins in them, number of each name)."""
    order = np.argsort(name)
    ordered = name[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(name) else np.zeros(0, np.int64)
    return order, begin, np.diff(np.append(begin, len(order)))


def smallest(contents: list[bytes], doc: np.ndarray) -> np.ndarray:
    """The smallest document that has an entry's content, by the bytes themselves."""
    least: dict[bytes, int] = {}
    for c, d in zip(contents, doc.tolist(), strict=True):
        if least.setdefault(c, d) > d:
            least[c] = d
    return np.fromiter((least[c] for c in contents), np.int64, len(contents))


def grouped(doc: np.ndarray, spread: int) -> np.ndarray:
    """The group of each document, by a hash: ids may come in steps."""
    return (mix(doc.astype(np.int64).view(U)) % U(spread)).astype(np.int64)


ROW = "bucket int, kind int, blob binary"
#: What a row's blob holds: occurrences of grams, grams known to repeat, marks, cells with their contents, texts.
GRAMS, REPEATED, MARKS, CELLS, TEXTS = 0, 1, 2, 3, 9
MARK = (np.int64, np.uint32, np.int32, np.int32)  # doc_id, crc, first cell or window, number of windows


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, memoryview | bytes, dict]]]]:
    """Rows sorted by bucket, as one list per bucket."""
    at, held = None, []
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i in range(batch.num_rows):
            row = {c: v[i] for c, v in columns.items()}
            if row["bucket"] != at:
                if held:
                    yield at, held
                at, held = row["bucket"], []
            held.append(row)
    if held:
        yield at, held


def gathered(df: DataFrame, *order: str) -> DataFrame:
    """Each bucket as the partition of its number; a map task then writes one row per partition and not per key."""
    return df.repartitionById(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket", *order)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Repeats:
    """The steps for one unit, window and gram length, and one way of ranking."""

    def __init__(self, spark: SparkSession, unit: type, window: int, gram: int, rank: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]):
        self.spark, self.unit, self.window, self.gram, self.rank = spark, unit, window, gram, rank
        self.spread = partitions(spark)

    @staticmethod
    def rest(carried: tuple[str, ...]) -> Column:
        """The carried columns as a struct of numbered fields, since their own names may be anything."""
        return F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carried)]) if carried else F.lit(None).cast("int")

    def grams(self, documents: DataFrame) -> DataFrame:
        """Step 1, at the documents: grams to their buckets."""
        unit, window, gram, spread = self.unit, self.window, self.gram, self.spread

        def flush(found: list[tuple]) -> pa.RecordBatch:
            name = np.concatenate([f[2] for f in found])
            doc = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[2]) for f in found])
            crc = np.repeat(np.array([f[1] for f in found], np.uint32), [len(f[2]) for f in found])
            cell = np.concatenate([np.arange(len(f[2]), dtype=np.int32) for f in found])
            order, begin, size = by_name(name)
            again = np.empty(len(name), bool)
            again[order] = np.repeat(size > 1, size)
            rows = [(b, GRAMS, packed(*halves(name[once]), doc[once], crc[once], steps(cell[once]))) for b, i in by_bucket((name % U(spread)).astype(np.int64)) if len(once := i[~again[i]])]
            known = name[order[begin[size > 1]]]
            rows += [(b, REPEATED, packed(*halves(known[i]))) for b, i in by_bucket((known % U(spread)).astype(np.int64))]
            here = np.flatnonzero(again)
            rows += [(b, MARKS, packed(doc[here[i]], crc[here[i]], cell[here[i]], np.ones(len(i), np.int32))) for b, i in by_bucket(grouped(doc[here], spread))]
            return rows_of(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n = [], 0
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    data = (text.as_py() or "").encode("utf-8", "replace")
                    name = cells(unit(data), window, gram)[0]
                    if len(name):
                        found.append((doc, zlib.crc32(data), name))
                        n += len(name)
                    if n >= FLUSH_CELLS:
                        yield flush(found)
                        found, n = [], 0
            if found:
                yield flush(found)

        return documents.select("doc_id", "text").mapInArrow(light(run), ROW)

    def candidates(self, documents: DataFrame) -> DataFrame:
        """Step 1, in the buckets: cells whose gram occurs again, sent to their document's group."""
        spread = self.spread

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in buckets_of(batches):
                ready = [(bucket, MARKS, r["blob"]) for r in rows if r["kind"] == MARKS]
                if ready:
                    yield rows_of(ready)
                grams = [unpacked(r["blob"], np.uint32, np.uint16, np.int64, np.uint32, np.int32) for r in rows if r["kind"] == GRAMS]
                if not grams:
                    continue
                name, doc, crc, cell = (np.concatenate(x) for x in zip(*((whole(g[0], g[1]), g[2], g[3], np.cumsum(g[4], dtype=np.int32)) for g in grams), strict=True))
                known = np.unique(np.concatenate([np.zeros(0, U), *(whole(*unpacked(r["blob"], np.uint32, np.uint16)) for r in rows if r["kind"] == REPEATED)]))
                order, begin, size = by_name(name)
                again = np.empty(len(name), bool)
                again[order] = np.repeat((size > 1) | np.isin(name[order[begin]], known, assume_unique=True), size)
                keep = np.flatnonzero(again)
                yield rows_of([(b, MARKS, packed(doc[keep[i]], crc[keep[i]], cell[keep[i]], np.ones(len(i), np.int32))) for b, i in by_bucket(grouped(doc[keep], spread))])

        return gathered(self.grams(documents)).mapInArrow(light(run), ROW)

    def with_texts(self, marks: DataFrame, documents: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """Marks and texts of each group of documents together, marks first; texts travel compressed, beside ``carried``."""
        rest, spread = self.rest(carried), self.spread

        def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Texts of one group in a batch as one blob, which compresses better than each by itself."""
            press = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
                buckets = grouped(ids, spread)
                rows = []
                for bucket, entries in by_bucket(buckets):
                    size, begin = 0, 0
                    data = [(texts[int(i)].as_py() or "").encode("utf-8", "replace") for i in entries]
                    for k, d in enumerate(data):
                        size += len(d)
                        if size >= BLOB_BYTES or k == len(data) - 1:
                            part = slice(begin, k + 1)
                            rows.append((bucket, press.compress(b"".join(data[part])), ids[entries[part]].tolist(), [len(x) for x in data[part]], entries[part]))
                            size, begin = 0, k + 1
                if not rows:
                    continue
                rest = batch.column("rest").take(pa.array(np.concatenate([r[4] for r in rows])))
                rest = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]), pa.int32()), rest)
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = ([r[0] for r in rows], [TEXTS] * len(rows), *([r[k] for r in rows] for k in (1, 2, 3)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), rest], ["bucket", "kind", "blob", "doc_ids", "sizes", "rest"])

        chosen = documents.select("doc_id", "text", rest.alias("rest"))
        kind = chosen.schema["rest"].dataType
        texts = chosen.mapInArrow(squeeze, f"{ROW}, doc_ids array<long>, sizes array<long>, rest array<{kind.simpleString()}>")
        empty = {"doc_ids": F.lit(None).cast("array<long>"), "sizes": F.lit(None).cast("array<long>"), "rest": F.lit(None).cast(texts.schema["rest"].dataType)}
        return gathered(marks.withColumns(empty).unionByName(texts), "kind")

    @staticmethod
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc_id, data, crc, first, number, carried) of each text; first and number are its marks."""
        press = zstandard.ZstdDecompressor()
        at, held, marks = None, [], None
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "kind", "blob", "doc_ids", "sizes", "rest")]
            for i in range(batch.num_rows):
                bucket, kind = columns[0][i].as_py(), columns[1][i].as_py()
                if bucket != at:
                    at, held, marks = bucket, [], None
                if kind == MARKS:
                    held.append(unpacked(columns[2][i].as_py(), *MARK))
                    continue
                if marks is None:
                    doc, crc, first, number = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, k) for k in MARK]
                    order = np.lexsort((first, crc, doc))
                    marks, held = (doc[order], crc[order], first[order], number[order]), []
                block, at_byte = press.decompress(columns[2][i].as_py()), 0
                ids = columns[3][i].as_py()
                begin, end = (np.searchsorted(marks[0], np.array(ids, np.int64), side).tolist() for side in ("left", "right"))
                for doc_id, a, b, size, rest in zip(ids, begin, end, columns[4][i].as_py(), columns[5][i].as_py(), strict=True):
                    data = block[at_byte : at_byte + size]
                    at_byte += size
                    crc = zlib.crc32(data)
                    own = slice(a, b)
                    if a < b and not marks[1][a] == marks[1][b - 1] == crc:  # the id has other texts too
                        own = slice(a + np.searchsorted(marks[1][a:b], crc, "left"), a + np.searchsorted(marks[1][a:b], crc, "right"))
                    yield doc_id, data, crc, marks[2][own], marks[3][own], rest

    def contents(self, marks: DataFrame, documents: DataFrame) -> DataFrame:
        """Step 2, at the documents: candidate cells with their contents to the bucket of their gram."""
        unit, window, gram, spread, joined = self.unit, self.window, self.gram, self.spread, self.joined

        def flush(found: list[tuple]) -> pa.RecordBatch:
            press = zstandard.ZstdCompressor(level=3)
            sizes = [len(f[2]) for f in found]
            doc, crc = np.repeat(np.array([f[0] for f in found], np.int64), sizes), np.repeat(np.array([f[1] for f in found], np.uint32), sizes)
            name, first, count = (np.concatenate([f[2 + k] for f in found]) for k in range(3))
            content = [c for f in found for c in f[5]]
            least = smallest(content, doc)
            later = np.flatnonzero(doc > least)  # the same cell stands in a smaller document of this flush
            rows = [(b, MARKS, packed(doc[later[i]], crc[later[i]], first[later[i]].astype(np.int32), count[later[i]].astype(np.int32))) for b, i in by_bucket(grouped(doc[later], spread))]
            own = np.flatnonzero(doc == least)
            for b, i in by_bucket((name[own] % U(spread)).astype(np.int64)):
                i = own[i]
                texts = [content[k] for k in i]
                head = packed(*halves(name[i]), doc[i], crc[i], steps(first[i].astype(np.int32)), count[i].astype(np.int32), np.array([len(t) for t in texts], np.int32))
                rows.append((b, CELLS, len(head).to_bytes(8, "little") + head + press.compress(b"".join(texts))))
            return rows_of(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n, size = [], 0, 0
            for doc, data, crc, marked, *_ in joined(batches):
                if not len(marked):
                    continue
                text = unit(data)
                name, first, count = (x[marked] for x in cells(text, window, gram))
                content = text.contents(first, first + count + window - 1)
                found.append((doc, crc, name, first, count, content))
                n += len(name)
                size += sum(map(len, content))
                if n >= FLUSH_CELLS or size >= FLUSH_BYTES:
                    yield flush(found)
                    found, n, size = [], 0, 0
            if found:
                yield flush(found)

        return self.with_texts(marks, documents).mapInArrow(light(run), ROW)

    def repeated(self, marks: DataFrame, documents: DataFrame) -> DataFrame:
        """Step 2, in the buckets: the windows that a smaller document has, as runs, sent to their document's group."""
        spread, rank = self.spread, self.rank

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdDecompressor()
            for bucket, rows in buckets_of(batches):
                ready = [(bucket, MARKS, r["blob"]) for r in rows if r["kind"] == MARKS]
                if ready:
                    yield rows_of(ready)
                heads, contents = [], []
                for r in rows:
                    if r["kind"] == CELLS:
                        size = 8 + int.from_bytes(r["blob"][:8], "little")
                        upper, lower, doc, crc, first, count, sizes = unpacked(r["blob"][8:size], np.uint32, np.uint16, np.int64, np.uint32, np.int32, np.int32, np.int32)
                        heads.append((whole(upper, lower), doc, crc, np.cumsum(first, dtype=np.int32), count))
                        texts, at = press.decompress(r["blob"][size:]), 0
                        for n in sizes.tolist():
                            contents.append(texts[at : at + n])
                            at += n
                if not heads:
                    continue
                name, doc, crc, first, count = (np.concatenate(x) for x in zip(*heads, strict=True))
                # Of equal cells those of the smallest document are ranked; in the others every window is a repeat.
                later = doc > smallest(contents, doc)
                k = np.flatnonzero(later)
                yield rows_of([(g, MARKS, packed(doc[k[j]], crc[k[j]], first[k[j]], count[k[j]])) for g, j in by_bucket(grouped(doc[k], spread))])
                # Names that one content alone has need no ranking; the others are ranked some names at a time.
                left = np.flatnonzero(~later)
                order, begin, size = by_name(name[left])
                order, size = left[order[np.repeat(size > 1, size)]], size[size > 1]
                if not len(order):
                    continue
                begin = np.cumsum(size) - size
                before = np.append(0, np.cumsum(np.add.reduceat(count[order], begin, dtype=np.int64))[:-1])  # windows of the names before
                edges = [*begin[np.flatnonzero(np.diff(before // RANKED, prepend=-1))].tolist(), len(order)]
                for a, b in zip(edges, edges[1:], strict=False):
                    i = order[a:b]
                    hit = rank([contents[k] for k in i.tolist()], count[i], doc[i])
                    of = np.repeat(i, count[i])
                    place = consecutive(np.zeros(len(i), np.int64), count[i])
                    step = np.concatenate([[True], (of[1:] != of[:-1]) | (hit[1:] != hit[:-1])])
                    start = np.flatnonzero(step)
                    length = np.diff(np.append(start, len(hit)))
                    start, length = start[hit[start]], length[hit[start]]
                    k = of[start]
                    yield rows_of([(g, MARKS, packed(doc[k[j]], crc[k[j]], (first[k[j]] + place[start[j]]).astype(np.int32), length[j].astype(np.int32))) for g, j in by_bucket(grouped(doc[k], spread))])

        return gathered(self.contents(marks, documents)).mapInArrow(light(run), ROW)

    def applied(self, documents: DataFrame, digest: Callable, names: dict[str, tuple[str, pa.DataType]], carried: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, what ``digest(text, covered)`` makes of every document, and the ``carried`` columns as fields c0, c1, ... of ``rest``.

        ``covered`` marks the document's repeated units.
        """
        unit, window, joined = self.unit, self.window, self.joined
        columns = {"doc_id": ("long", pa.int64())} | names
        documents = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
        there = documents.where("doc_id is not null")
        with configured(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
            candidates = settled(self.candidates(there), "candidates")
        released(self.spark)
        marks = settled(self.repeated(candidates, there), "marks")
        released(self.spark)
        both = self.with_texts(marks, there, carried)
        rest_type = both.schema["rest"].dataType.elementType
        schema = ", ".join([*(f"{c} {k[0]}" for c, k in columns.items()), f"rest {rest_type.simpleString()}"])

        def batch_of(rows: list[tuple], rest: pa.Array) -> pa.RecordBatch:
            arrays = [pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True) if rows else [()] * len(columns), columns.values(), strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, rest], [*columns, "rest"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, rest, size, kind = [], [], 0, to_arrow_type(rest_type)
            for doc, data, _, first, number, own in joined(batches):
                text = unit(data)
                covered = np.zeros(text.n, bool)
                if len(first):
                    change = np.bincount(first, minlength=text.n + 1) - np.bincount(first + number + window - 1, minlength=text.n + 1)
                    covered = np.cumsum(change[:-1]) > 0
                found.append((doc, *digest(text, covered)))
                rest.append(own)
                size += len(data)
                if size > 8 << 20:
                    yield batch_of(found, pa.array(rest, kind))
                    found, rest, size = [], [], 0
            if found:
                yield batch_of(found, pa.array(rest, kind))

        def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [unit((t.as_py() or "").encode("utf-8", "replace")) for t in b.column("text")]
                yield batch_of([(None, *digest(t, np.zeros(t.n, bool))) for t in texts], b.column("rest"))

        rest = self.rest(carried)
        return both.mapInArrow(light(run), schema).union(documents.where("doc_id is null").select("text", rest.alias("rest")).mapInArrow(untouched, schema))


def consecutive(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """From each ``start``, ``count`` numbers that follow each other."""
    end = np.cumsum(count)
    return np.arange(int(count.sum())) + np.repeat(start - (end - count), count)


def smaller_holder(order: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For entries in ``order`` with groups that begin at ``new``: is an entry's doc not its group's smallest?"""
    begin = np.flatnonzero(new)
    hit = np.empty(len(order), bool)
    hit[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(order))))
    return hit
