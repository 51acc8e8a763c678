"""Near-duplicates by DartMinHash: weighted signatures, a banded join, and an exact check of what it proposes.

A document is the multiset of its five-word shingles (of fewer words, one shingle of them all); similarity is the
weighted Jaccard index of the multisets, and documents of at least 0.8 are linked.  Each shingle owns the region
[0, weight) x time.  Darts fall into it as a Poisson process that a hash of the shingle alone decides, each marked
with one of ``K`` coordinates; a document's signature is, per coordinate, the time of its earliest dart.  Two
documents agree in a coordinate with the probability of their similarity.  Throwing stops when every coordinate has
a dart, after about K ln K darts however many words there are.

The join never forms all pairs of a bucket.  First each document is compared with the smallest document of the
bucket it shares most often, which joins most copies of a group at once.  Then, in buckets that still hold several
components, the documents outside of the largest one (the minority) ask all others: blocks of both meet, and in each
pair of blocks an inverted index over the shingles' hashes finds for every asking document those that reach the
threshold.  Of these links a block keeps as many as join what all of them would join.  Buckets of the same documents
are looked at once.  Every link of either step is computed again from the words themselves before it counts.
So no bucket is capped, and no link between components that the bands propose is lost.

Equal multisets are collapsed first, each to its smallest doc_id.  Documents without words (null texts too) are alike
to nothing: each is its own class.  Of rows of one doc_id the smallest text is the document's; rows with a null doc_id
get a null class.  Ties go to the smaller doc_id.  An empty table gives an empty result.  Other columns are not read;
``representatives`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import configured, light, quoted, settled
from lattica.llm.components import components
from lattica.llm.symbols import U, mix, windows, word_codes

SHINGLE = 5
THRESHOLD = 0.8
#: 42 bands of 6 miss a pair of similarity 0.8 with a probability of 3e-6.
BANDS, ROWS = 42, 6
K = BANDS * ROWS
#: Words sketched at a time.
CHUNK_WORDS = 300_000
#: Documents of a bucket in one block of the second comparison; documents for each salt of the first join, and least salts.
BLOCK = 2048
SALT_ROWS, SALTS = 1 << 20, 16


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Names of the distinct shingles, ascending, and their counts."""
    codes = word_codes((text or "").encode("utf-8", "replace"))[0]
    if 0 < len(codes) < size:
        return windows(codes, len(codes))[:1], np.ones(1, np.int64)
    return np.unique(windows(codes, size), return_counts=True)


def counted(text: str | None, size: int = SHINGLE) -> Counter:
    """The shingles themselves, as tuples of words, with their counts."""
    words = (text or "").encode("utf-8", "replace").split()
    return Counter([tuple(words)] if 0 < len(words) < size else zip(*(words[k:] for k in range(size)), strict=False))


def alike(a: Counter, b: Counter) -> float:
    """Weighted Jaccard index of two multisets."""
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / max(1, a.total() + b.total() - both)


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """The earliest dart's time in each coordinate, for each non-empty multiset."""
    out = np.full((len(sets), k), np.inf)
    weight = np.array([int(s[1].sum()) for s in sets], float)
    horizon = (np.log(k) + 3) / weight
    # A shingle of weight w is w regions of unit height, each with darts of its own.
    slab = [mix(np.repeat(s[0], s[1]) + (np.arange(s[1].sum()) - np.repeat(np.cumsum(s[1]) - s[1], s[1])).astype(U) * U(0xD1342543DE82EF95)) for s in sets]
    owner = np.repeat(np.arange(len(sets)), weight.astype(int))
    todo = np.arange(len(sets))
    while len(todo):
        chosen = np.isin(owner, todo) if len(todo) < len(sets) else slice(None)
        seed, doc = np.concatenate(slab)[chosen] if len(slab) else np.zeros(0, U), owner[chosen]
        time, until = np.zeros(len(seed)), horizon[doc]
        step = 0
        while len(seed):
            step += 1
            dart = mix(seed + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log1p(-(dart >> U(11)).astype(float) * 2.0**-53) / k
            alive = time < until
            if not alive.all():
                seed, doc, time, until, dart = seed[alive], doc[alive], time[alive], until[alive], dart[alive]
            coordinate = ((mix(dart) >> U(32)) * U(k) >> U(32)).astype(np.int64)
            np.minimum.at(out.reshape(-1), doc * k + coordinate, time)
        todo = np.flatnonzero(np.isinf(out).any(axis=1))
        horizon[todo] *= 2
    return out


def band_names(times: np.ndarray) -> np.ndarray:
    """A name per document and band, as signed integers."""
    bits = times.view(U)
    names = np.empty((len(times), BANDS), U)
    for band in range(BANDS):
        name = np.full(len(times), band + 1, U)
        for row in range(ROWS):
            name = mix(name * U(0x9E3779B97F4A7C15) + bits[:, band * ROWS + row])
        names[:, band] = name
    return names.view(np.int64)


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, a key of the multiset and band names; documents without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows: list[tuple] = []
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            words = 0
            for i, doc in enumerate(ids):
                found = shingles(texts[i].as_py())
                if len(found[0]):
                    rows.append((doc, found))
                    words += int(found[1].sum())
                if words >= CHUNK_WORDS or (i == len(ids) - 1 and rows):
                    sets = [r[1] for r in rows]
                    times = sketch(sets)
                    keys = np.array([[int(mix(s[0] * U(3) + s[1].astype(U)).sum(dtype=U)), int(mix(mix(s[0]) + s[1].astype(U)).sum(dtype=U))] for s in sets], U).view(np.int64)
                    names = band_names(times)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array(keys[:, 0]),
                            pa.array(keys[:, 1]),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(names.reshape(-1))),
                        ],
                        ["doc_id", "k1", "k2", "bands"],
                    )
                    rows, words = [], 0

    return documents.mapInArrow(light(run), "doc_id long, k1 long, k2 long, bands array<long>")


def checked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold, computed from their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, Counter] = (None, Counter())
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if last[0] != b:
                    last = b, counted(batch.column("text_b")[i].as_py())
                if alike(counted(batch.column("text_a")[i].as_py()), last[1]) >= threshold:
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in kept], pa.int64()) for n in (0, 1)], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").mapInArrow(light(run), "a long, b long")


def occurrences(texts: DataFrame) -> DataFrame:
    """(id, hashes): a document's shingles as 64-bit names, each occurrence by its own, so that a multiset is a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for text in batch.column("text"):
                names, n = shingles(text.as_py())
                again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                blobs.append(mix(np.repeat(names, n) + again.astype(U) * U(0x9E3779B97F4A7C15)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["id", "hashes"])

    return texts.select("doc_id", "text").mapInArrow(light(run), "id long, hashes binary")


def joining_links(rows: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links (a, b) between a block's asking and asked documents that connect the labels which all its links connect.

    ``rows``: id, label, hashes, asks.
    """
    ids, labels, asks = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
    sets = [np.frombuffer(r[2], U) for r in rows]
    sizes = np.array([len(x) for x in sets])
    asked = np.flatnonzero(~asks)
    values, owner = np.concatenate([sets[i] for i in asked]), np.repeat(np.arange(len(asked)), sizes[asked])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    found = []
    for x in np.flatnonzero(asks):
        begin, end = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        n = end - begin
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(asked))
        # The same quotient that ``alike`` computes.
        near = asked[(both / np.maximum(1, sizes[x] + sizes[asked] - both) >= threshold) & (labels[asked] != labels[x])]
        for label, k in zip(*np.unique(labels[near], return_index=True), strict=True):
            a, b = find(int(labels[x])), find(int(label))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(ids[near[k]]), int(ids[x])))
    return found


def remaining(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between different components within buckets, as many as join what all such links would.

    ``members``: band, id and label.  A bucket's minority (all but its largest component) is cut into blocks of
    ``BLOCK``, and so are all its members; each pair of blocks is one group.
    """
    # Buckets of different bands that hold the same documents ask the same; the last of them is enough.
    same = members.groupBy("band").agg(F.count("*").alias("all"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("xor"))
    once = same.groupBy("all", "sum", "xor").agg(F.max("band").alias("band")).select("band")
    members = members.join(once, "band", "left_semi")
    sizes = members.groupBy("band", "label").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("most"), F.sum("n").alias("total"), F.max("n").alias("largest")).where("total > largest")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    within = settled(members.join(open_, "band"), "open")
    hashes = occurrences(texts.join(within.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    within = within.join(hashes, "id").withColumns({"mine": F.pmod(F.xxhash64("id"), blocks(F.col("total"))).cast("int"), "minor": F.pmod(F.xxhash64("id"), blocks(F.col("total") - F.col("largest"))).cast("int")})
    columns = ("id", "label", "hashes")
    asking = within.where("label <> most").select("band", F.col("minor").alias("row"), F.explode(F.sequence(F.lit(0), blocks(F.col("total")) - 1)).alias("col"), *columns, F.lit(True).alias("asks"))
    asked = within.select("band", F.explode(F.sequence(F.lit(0), blocks(F.col("total") - F.col("largest")) - 1)).alias("row"), F.col("mine").alias("col"), *columns, F.lit(False).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by block pair; only the rows of one are held at a time."""
        at, held = None, []

        def emit() -> pa.RecordBatch:
            asks = [r[3] for r in held]
            pairs = joining_links(held, threshold) if any(asks) and not all(asks) else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("name", "number", "row", "col", *columns, "asks")], strict=True):
                if row[:4] != at:
                    if held:
                        yield emit()
                    at, held = row[:4], []
                held.append(row[4:])
        if held:
            yield emit()

    key = ("name", "number", "row", "col")
    both = asking.union(asked).select("band.name", "band.number", "row", "col", *columns, "asks")
    return both.repartition(*key).sortWithinPartitions(*key).mapInArrow(light(run), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the smallest doc_id of its class of linked documents.

    Of rows that share a doc_id the smallest text is the document's.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = settled(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")), "documents")
    total = docs.count()
    with configured(documents.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):  # whole texts in a worker's memory
        sketches = settled(sketched(docs), "sketches")
    contents = settled(sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "contents", total)
    firsts = sketches.select("doc_id", "bands").join(contents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    salts = SALTS + total // SALT_ROWS
    bands = firsts.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("number", "name"))
    shared = settled(bands.groupBy("name", "number").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    salted = shared.select("name", "number", "pivot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    members = settled(
        bands.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["name", "number", "salt"]).select(F.struct("name", "number").alias("band"), "id", "pivot"), "members"
    )
    texts = settled(docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    proposals = members.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("n"))
    best = proposals.groupBy("id").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b")).select(F.col("id").alias("a"), "b")
    with configured(documents.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        links = settled(checked(best, texts, threshold), "links")

    labels = components(links)
    labelled = members.select("band", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = checked(settled(remaining(labelled, texts, threshold), "proposed"), texts, threshold)
    labels = components(settled(links.union(more), "links", 2 * total))

    named = settled(contents.join(labels, "id", "left").select("k1", "k2", "n", F.coalesce("label", "id").alias("class_id")), "contents", total)
    keys = sketches.select("doc_id", "k1", "k2")
    # Multisets of more than a thousandth of the documents: fewer than a thousand rows, so their copies need no shuffle.
    common = F.broadcast(named.where(F.col("n") * 1000 > total).select("k1", "k2", F.col("class_id").alias("common")))
    marked = keys.join(common, ["k1", "k2"], "left")
    rest = marked.where("common is null").drop("common").join(named.where(F.col("n") * 1000 <= total).drop("n"), ["k1", "k2"])
    classes = marked.where("common is not null").select("doc_id", F.col("common").alias("class_id")).union(rest.select("doc_id", "class_id"))
    return rows.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def representatives(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The smallest document of each class, as one row with the document's text; rows with a null doc_id stay."""
    classes = near_duplicates(documents, threshold).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    row = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(documents.columns)])
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text", row.alias("row"))
    kept = rows.join(classes, rows.id == classes.kept_id, "left_semi")
    first = kept.groupBy("id").agg(F.min_by("row", F.struct(F.col("text").isNull().alias("none"), "text", F.to_json("row").alias("json"))).alias("row")).select("row")
    both = first.union(rows.where("id is null").select("row"))
    return both.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(documents.columns)])
