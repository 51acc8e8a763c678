"""Toxicity by class-conditional Kneser-Ney models over the bytes of lower-cased words.

Two models, one of toxic and one of ordinary training texts, give every byte of a word its probability after the
word's bytes so far (the last ``DEPTH`` of them), or, where the model holds no such context, after fewer bytes, down
the ``ORDERS`` to a context that it holds.  At each order they discount their own counts and give what is left to one
shared lower order, the continuation counts of both classes together after the last byte:

    P_c(x | h) = max(n_c(hx) - D, 0) / n_c(h)  +  D * types_c(h) / n_c(h) * P_shared(x | last byte of h)

n_c is the number of times that a training text of the class has a word with the n-gram (a text that repeats a word
counts it once) where the context is the whole word so far or ``DEPTH`` bytes, and else, as Kneser and Ney have it,
the number of different longer n-grams of the class that end so.  What stands behind a quote, in a compound or late
in a long run is thus judged by the bytes just before it.

Counting is Spark's, over all training rows: words by class, then n-grams of each order with the totals and types of
their contexts.  No n-gram is left out of them, however rare, and every one counts in a score.  A model of ``MOST_CONTEXTS``
contexts and ``MOST_GRAMS`` n-grams at the most is broadcast.  A larger one stays in Spark, where each distinct word of all
documents, in chunks of words that ask for the contexts they need, gets the ratios of its bytes; documents, in groups, then
ask for their words'.  The ``MOST_WORDS`` most frequent words' are broadcast, which saves asking and changes no score.

A rare expression is judged by the backoff that both classes share, where the classes hardly differ.  What is
compared are log-likelihoods per byte: over the whole text, and over its most toxic passage of ``PASSAGE`` bytes,
since a long text with one abusive passage is toxic too.  A logistic curve turns the two into a score from 0 to 1;
it is fitted on about ``MOST_CURVE`` training rows at the most, chosen by hash, that are left out of the counts.

Null and empty texts hold no evidence: they get the score of two zero ratios.  Repeated rows get equal scores, and
rows of one doc_id count each.  Rows without a doc_id are scored and never trained on.  Without documents the result
is empty; without labels every text gets a score of the bare curve.  Columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.llm.common import bounded_labels, configured, fold_of, light, quoted, remove_path, settled, settled_at, training_labels, unused
from lattica.llm.symbols import U, mix, paired, word_codes

#: Bytes of context, longest first.
ORDERS = (12, 6, 4, 3, 2, 1)
DEPTH = ORDERS[0]
DISCOUNT = 0.75
PASSAGE = 8
#: A larger model isn't broadcast, but joined.
MOST_CONTEXTS, MOST_GRAMS = 1 << 16, 1 << 18
#: Words whose ratios are broadcast where the model isn't, words that ask together for contexts, documents for words.
MOST_WORDS, CHUNK, GROUP = 1 << 18, 1 << 17, 64
#: Parts of the documents that are joined one after another with their words, and of the words' chunks with their contexts,
#: so that one part's shuffle is on disk at a time; fewer words are joined in one.
SLICES, CHUNK_SLICES, FEW_WORDS = 3, 2, 1 << 18
#: Bound on the training rows that the curve is fitted on, which are a share of them at the most.
MOST_CURVE, CURVE_SHARE = 6_000, 4
#: Words that a task holds before it sums them and hands on their counts, bytes of texts that are counted together, and bytes
#: of a word in one unit of counting.
FLUSH_WORDS, COUNTED, UNIT = 800_000, 1 << 22, 96
#: Where every partition of one side of a join has fewer bytes, it is hashed and neither side sorted.
HASHED = "64m"
#: Bytes scored at a time; longer texts are scored in stretches that end between words.
STRETCH = 1 << 19
#: Bytes of words whose ratios a worker remembers.
REMEMBERED = 1 << 20


#: Bytes that begin all white space beyond ASCII (other characters too), and the white space of ASCII as spaces.
WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_NARROW = bytes(32 if chr(i).isspace() and i < 128 else i for i in range(256))


def clean(text: str | None) -> bytes:
    """Lower-cased text between single spaces, as UTF-8; white space is what ``str.split`` takes for it."""
    lower = (text or "").lower()
    b = lower.encode("utf-8", "replace")
    if not lower.isascii() and any(w in b for w in WIDE):
        b = " ".join(lower.split()).encode("utf-8", "replace")
    else:
        b = b.translate(_NARROW)
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        b = b.strip(b" ")
    return b" %b " % b if b else b""


#: The bits of the low and of the high word that a gram of so many bytes fills.
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(DEPTH + 2)], U)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(DEPTH + 2)], U)
_SIZE = U(48)


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of every byte but the first: the byte with its longest context, and how many bytes they are.

    A word's context begins with the space before it, and the space after a word is a byte of it.  The last eight bytes
    are the low word; those before them and the size are the high one.
    """
    b = np.frombuffer(text, np.uint8)
    if len(b) < 3:
        return (np.zeros(0, U),) * 2
    at = np.arange(len(b))
    start = np.maximum.accumulate(np.where(b == 32, at, 0))  # the space before a word, or a space itself
    begin = np.concatenate([[0], start[:-1]])  # a word's last byte is the space that ends it
    size = np.minimum(at - begin, DEPTH) + 1
    low = b.astype(U)
    for step in (1, 2, 4):
        low[step:] |= low[:-step] << U(8 * step)
    high = np.concatenate([np.zeros(8, U), low])[: len(b)]
    return ((high & _HIGH[size]) | (size.astype(U) << _SIZE))[1:], (low & _LOW[size])[1:]


def sizes(high: np.ndarray) -> np.ndarray:
    return (high >> _SIZE).astype(np.int64)


def shortened(high: np.ndarray, low: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of more than ``order`` bytes of context, with the last ``order`` of them."""
    return (high & _HIGH[order + 1]) | (U(order + 1) << _SIZE), low & _LOW[order + 1]


def named(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(high) + low) | U(1)


def named_context(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The names of grams' contexts."""
    size = sizes(high) - 1
    return named(((high >> U(8)) & _HIGH[size]) | (size.astype(U) << _SIZE), ((low >> U(8)) | (high << U(56))) & _LOW[size])


class Table:
    """Open addressing from n-gram codes to floats, probed for whole arrays at once."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.held, self.keys = (codes, values), None

    def __reduce__(self) -> tuple:
        """Sent without slots; who asks first builds them."""
        return Table, self.held

    def _build(self) -> None:
        codes, values = self.held
        self.bits = max(8, int(2 * len(codes)).bit_length())
        self.keys = np.zeros(1 << self.bits, U)
        self.values = np.zeros(1 << self.bits, np.float32)
        self.probes = 0
        at, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            self.probes += 1
            free = self.keys[at] == 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            won = free & first
            self.keys[at[won]], self.values[at[won]] = codes[left[won]], values[left[won]]
            at, left = (at[~won] + 1) & ((1 << self.bits) - 1), left[~won]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); 0 where a code isn't held."""
        if self.keys is None:
            self._build()
        slot = self._slot(codes)
        keys = self.keys[slot]
        found = keys == codes
        out = np.where(found, self.values[slot], np.float32(0))
        left = np.nonzero(~found & (keys != 0))[0]
        at = slot[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            keys = self.keys[at]
            hit = keys == codes[left]
            out[left[hit]], found[left[hit]] = self.values[at[hit]], True
            more = ~hit & (keys != 0)
            left, at = left[more], at[more]
        return out, found


@dataclass
class Model:
    """log(P_toxic / P_ordinary) of seen n-grams; of seen contexts the ratio of backoff weights; the curve."""

    seen: Table
    contexts: Table
    curve: np.ndarray

    def ratios(self, text: bytes) -> np.ndarray:
        """log(P_toxic / P_ordinary) of each byte but the first, after its longest seen context."""
        high, low = grams(text)
        ratio, unseen = np.zeros(len(low), np.float32), np.ones(len(low), bool)
        for order in ORDERS:
            if order == DEPTH:
                at, h, w = np.arange(len(low)), high, low
            else:
                at = np.flatnonzero(unseen & (sizes(high) > order + 1))
                h, w = shortened(high[at], low[at], order)
            value, found = self.seen.get(named(h, w))
            lost = np.flatnonzero(~found)
            value[lost], found[lost] = self.contexts.get(named_context(h[lost], w[lost]))
            ratio[at] = value
            unseen[at[found]] = False
        return ratio



class Scorer:
    """Scores texts with a model; the ratios of a word's bytes depend on the word alone and are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.store, self.used = np.zeros(REMEMBERED + STRETCH, np.float32), 0

    def ratios(self, text: bytes) -> np.ndarray:
        """As ``Model.ratios``, for words between single spaces, with one before and after."""
        codes, start, end = word_codes(text)
        distinct, first, of = np.unique(codes, return_index=True, return_inverse=True)
        if self.used > REMEMBERED:
            self.forget()
        place = [self.place.get(c, -1) for c in distinct.tolist()]
        new = first[[i for i, p in enumerate(place) if p < 0]]
        if len(new):
            said = b" ".join([text[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            found = self.model.ratios(b" %b " % said)
            if self.used + len(found) > len(self.store):
                self.store = np.concatenate([self.store[: self.used], found])
            else:
                self.store[self.used : self.used + len(found)] = found
            begin = self.used + np.cumsum(end[new] - start[new] + 1) - (end[new] - start[new] + 1)
            self.place.update(zip(codes[new].tolist(), begin.tolist(), strict=True))
            self.used += len(found)
            place = [self.place[c] for c in distinct.tolist()]
        size = end - start + 1
        return self.store[np.repeat(np.array(place)[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For each text the log-likelihood ratio per byte of the whole and of its most toxic passage."""
        out = np.zeros((len(texts), 2))
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            b = clean(text.as_py())
            if len(b) > STRETCH:
                out[i] = self.stretched(b)
            elif b:
                held.append((i, b[:-1]))  # the next text's first space ends its last word
                size += len(b)
            if held and (size > STRETCH or i == len(texts) - 1):
                ratio = self.ratios(b"".join([x for _, x in held]) + b" ").astype(np.float64)
                at = 0
                for k, x in held:
                    out[k] = figures(ratio[at : at + len(x)])
                    at += len(x)
                held, size = [], 0
        return out

    def stretched(self, b: bytes) -> tuple[float, float]:
        """The same for one text that is too long to be held with its ratios, in stretches that end between words."""
        total, count, worst, carried, start = 0.0, 0, -np.inf, np.zeros(0), 0
        while start < len(b) - 1:
            end = b.rfind(b" ", start + 1, start + STRETCH) + 1
            end = end or b.find(b" ", start + 1) + 1 or len(b)
            ratio = self.ratios(b[start:end]).astype(np.float64)
            start = end - 1
            total, count = total + float(ratio.sum()), count + len(ratio)
            carried = np.concatenate([carried, ratio])
            worst = max(worst, figures(carried)[1])
            carried = carried[-(PASSAGE - 1) :]
        return total / count, worst


def figures(ratio: np.ndarray) -> tuple[float, float]:
    """The mean, and the largest mean of ``PASSAGE`` neighbours (a shorter text counts as filled up with zeros)."""
    if len(ratio) <= PASSAGE:
        return float(ratio.mean()), float(ratio.sum()) / PASSAGE
    sums = np.cumsum(ratio)
    return float(sums[-1]) / len(ratio), max(float(sums[PASSAGE - 1]), float((sums[PASSAGE:] - sums[:-PASSAGE]).max())) / PASSAGE


def _design(evidence: np.ndarray) -> np.ndarray:
    e = evidence.reshape(-1, 2)
    return np.column_stack([np.ones(len(e)), 10 * e[:, 0], 4 * e[:, 1]])


def curved(evidence: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(evidence) @ curve, -30, 30)))


def fit_curve(evidence: np.ndarray, label: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the ridge bounds the slope where classes are separable."""
    x, w, penalty = _design(evidence), np.zeros(3), ridge * np.array([0.01, 1.0, 1.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - label @ z + penalty @ (w * w) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (label - p) - penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def units(word: bytes) -> list[bytes]:
    """A word as it is counted: with the space on either side, and in overlapping units if it is long.

    A unit after the first begins with the ``DEPTH`` bytes before its own.
    """
    whole = b" %b " % word
    if len(whole) <= UNIT:
        return [whole]
    return [whole[:UNIT], *(whole[i - DEPTH : i + UNIT] for i in range(UNIT, len(whole), UNIT))]


def unit_grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, unit) of every n-gram that the units have of their own."""
    size = np.array([len(u) for u in found], np.int64)
    b = np.frombuffer(b"".join(found), np.uint8)
    unit = np.repeat(np.arange(len(found)), size)
    offset = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size)
    first = b[np.cumsum(size) - size] == 32
    own = offset >= np.where(first, 1, DEPTH)[unit]
    n = np.minimum(offset, DEPTH) + 1
    low = b.astype(U)
    for step in (1, 2, 4):
        low[step:] |= low[:-step] << U(8 * step)
    high = np.concatenate([np.zeros(8, U), low])[: len(b)]
    return ((high & _HIGH[n]) | (n.astype(U) << _SIZE))[own], (low & _LOW[n])[own], unit[own]


class Tally:
    """In how many texts of each class, and of no class, words are."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.held: list[tuple[pa.Array, np.ndarray]] = []
        self.texts: list[bytes] = []
        self.classes: list[int] = []
        self.size = self.most = 0  # of the texts, and how many words are held at the most

    def add(self, text: bytes, label: int) -> None:
        """A cleaned text, of class 2 if it isn't trained on."""
        if text:
            self.texts.append(text[:-1])  # the next text's first space ends its last word
            self.classes.append(label)
            self.size += len(text)

    def settle(self) -> None:
        """Count the texts that are held, by arrays: each word of a text once."""
        if not self.texts:
            return
        data = b"".join(self.texts) + b" "
        space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        text_of = np.searchsorted(np.cumsum([len(t) for t in self.texts]), space[:-1], "right")
        offsets = (space + 1).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(space) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        k = len(found.dictionary)
        pairs = np.sort(text_of * k + np.asarray(found.indices))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        n = np.bincount(np.array(self.classes)[pairs // k] * k + pairs % k, minlength=3 * k).reshape(3, k)
        self.held.append((found.dictionary.cast(pa.binary()), n))
        self.most += k
        self.texts, self.classes, self.size = [], [], 0

    def summed(self) -> tuple[pa.Array, np.ndarray]:
        """The words that are held, each with the space after it, and their counts."""
        if len(self.held) > 1:
            words = pa.concat_arrays([w for w, _ in self.held]).dictionary_encode()
            of, n = np.asarray(words.indices), np.concatenate([n for _, n in self.held], axis=1)
            self.held = [(words.dictionary, np.stack([np.bincount(of, x, len(words.dictionary)).astype(np.int64) for x in n]))]
            self.most = len(words.dictionary)
        return self.held[0]


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, ordinary, toxic, texts): in how many texts of each class, and of all, a word is, summed over many texts."""
    press = zstandard.ZstdDecompressor()
    tally = Tally()

    def flush() -> Iterator[pa.RecordBatch]:
        words, n = tally.summed()
        unit = pc.binary_join_element_wise(b" ", words, b"")
        size = np.asarray(pc.binary_length(unit))
        if (long := np.flatnonzero(size > UNIT)).size:
            own = [units(unit[i].as_py()[1:-1]) for i in long.tolist()]
            short = np.flatnonzero(size <= UNIT)
            unit = pa.concat_arrays([unit.take(pa.array(short)), pa.array([u for x in own for u in x], pa.binary())])
            n = n[:, np.concatenate([short, np.repeat(long, [len(x) for x in own])])]
        out = pa.RecordBatch.from_arrays([unit, *(pa.array(x) for x in (n[0], n[1], n.sum(0)))], ["unit", "ordinary", "toxic", "texts"])
        tally.forget()
        for k in range(0, out.num_rows, 1 << 16):
            yield out.slice(k, 1 << 16)

    for batch in batches:
        for label, blob in zip(batch.column("label").to_pylist(), batch.column("blob"), strict=True):
            tally.add(clean(press.decompress(blob.as_py()).decode("utf-8", "replace")), 2 if label is None else label)
            if tally.size > COUNTED:
                tally.settle()
                if tally.most > FLUSH_WORDS and len(tally.summed()[0]) > FLUSH_WORDS // 2:
                    yield from flush()
    tally.settle()
    if tally.held:
        yield from flush()


GRAM = "context long, high long, low long, ordinary long, toxic long"


def gram_rows(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counts summed by n-gram, as rows."""
    _, first, of = np.unique(named(high, low), return_index=True, return_inverse=True)
    arrays = [x[first].view(np.int64) for x in (named_context(high, low), high, low)] + [np.bincount(of, n, len(first)).astype(np.int64) for n in counts]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["context", "high", "low", "ordinary", "toxic"])


def longest_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            high, low, unit = unit_grams(batch.column("unit").to_pylist())
            yield gram_rows(high, low, np.stack([batch.column(c).to_numpy()[unit] for c in ("ordinary", "toxic")]))


def cut_to(order: int):
    """Each n-gram with the last ``order`` bytes of its context; it counts once for each class that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                high, low = (batch.column(c).to_numpy().view(U) for c in ("high", "low"))
                yield gram_rows(*shortened(high, low, order), np.stack([batch.column(c).to_numpy() > 0 for c in ("ordinary", "toxic")]))

    return run


def by_context(grams: DataFrame) -> DataFrame:
    """N-grams summed, with the totals and types of their contexts; one shuffle, by context, serves both."""
    all_of = Window.partitionBy("context")
    summed = grams.repartition("context").groupBy("context", "high", "low").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    return summed.withColumns(
        {f"total_{c}": F.sum(c).over(all_of) for c in ("ordinary", "toxic")} | {f"types_{c}": F.sum((F.col(c) > 0).cast("long")).over(all_of) for c in ("ordinary", "toxic")}
    )


def size_of() -> Column:
    return F.shiftrightunsigned("high", int(_SIZE))


def all_orders(longest: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The n-grams of every order, with their counts and their contexts' figures; and the longest ones alone.

    ``paths`` gets where they are.
    """

    def kept(grams: DataFrame, rows: int | None = None) -> DataFrame:
        grams, path = settled_at(by_context(grams), "grams", rows)
        paths.append(path)
        return grams

    out = cut = whole = kept(longest)
    above, most = DEPTH, whole.count()
    for order in ORDERS[1:]:
        source = whole.where((size_of() > order + 1) & (size_of() <= above + 1))
        source = source if above == DEPTH else source.union(cut)
        cut = kept(source.mapInArrow(light(cut_to(order)), GRAM), most)
        out, above = out.union(cut), order
    return out, whole


def kneser_ney(longest: DataFrame, paths: list[str]) -> DataFrame:
    """(context, high, low, ratio, backoff): the log ratio of every n-gram, and its context's for n-grams that it was not seen with."""
    grams, whole = all_orders(longest, paths)
    tail = F.col("low").bitwiseAND(0xFFFF)
    # Two bytes: 65,536 rows at the most.
    pairs = whole.groupBy(tail.alias("tail")).agg(F.count("*").alias("n"))
    shared, path = settled_at(pairs.withColumn("below", F.col("n") / F.sum("n").over(Window.partitionBy(F.shiftright("tail", 8)))).select("tail", "below"), "shared", 1 << 16)
    paths.append(path)

    def weight(c: str) -> Column:
        return F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.col(f"total_{c}")).otherwise(F.lit(1.0))

    def probability(c: str) -> Column:
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total_{c}"), F.lit(1)) + weight(c) * F.col("below")

    ratio, backoff = F.log(probability("toxic") / probability("ordinary")), F.log(weight("toxic") / weight("ordinary"))
    return grams.withColumn("tail", tail).join(F.broadcast(shared), "tail").select("context", "high", "low", ratio.cast("float").alias("ratio"), backoff.cast("float").alias("backoff"))


def tables(judged: DataFrame) -> tuple[Table, Table]:
    """A model that is small enough, for broadcasting."""
    held = judged.toPandas()
    names = named(*(held[c].to_numpy(np.int64).view(U) for c in ("high", "low")))
    order, contexts = np.argsort(names), held.drop_duplicates("context").sort_values("context")
    return (
        Table(names[order], held["ratio"].to_numpy(np.float32)[order]),
        Table(contexts["context"].to_numpy(np.int64).view(U), contexts["backoff"].to_numpy(np.float32)),
    )


#: Words from which on a lexicon is probed and not searched.
LARGE = 1 << 14


class Lexicon:
    """The ratios of words' bytes by the words' codes."""

    def __init__(self, codes: np.ndarray, ratios: pa.Array | pa.ChunkedArray):
        size = np.asarray(pc.binary_length(ratios)).astype(np.int64) // 4
        self.codes, first = np.unique(codes, return_index=True)
        self.size, self.begin = size[first], (np.cumsum(size) - size)[first]
        self.store = np.frombuffer(b"".join(ratios.to_pylist()), np.float32)
        self.places: Table | None = None

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The words' places, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        if LARGE < len(self.codes) < 1 << 24:  # a float32 holds every place
            self.places = self.places or Table(self.codes, np.arange(len(self.codes), dtype=np.float32))
            place, found = self.places.get(codes)
            return np.where(found, place, -1).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)


def unit_codes(found: list[bytes]) -> np.ndarray:
    """Codes of units: a whole word's is its ``word_codes``, another one's a hash of the unit."""
    whole = np.array([u[0] == 32 and u[-1] == 32 for u in found], bool)
    out = np.zeros(len(found), U)
    out[whole] = word_codes(b"".join([u for u, w in zip(found, whole.tolist(), strict=True) if w]))[0]
    for i in np.flatnonzero(~whole).tolist():
        out[i] = xxhash.xxh64_intdigest(found[i], 1)
    return out


class Reader(Scorer):
    """Scores texts by the ratios of their words, of which it has all."""

    def __init__(self, hot: Lexicon, cold: Lexicon):
        self.hot, self.cold = hot, cold

    def piece(self, code: np.ndarray) -> np.ndarray:
        for words in (self.hot, self.cold):
            if (at := int(words.find(code)[0])) >= 0:
                return words.store[words.begin[at] : words.begin[at] + words.size[at]]
        raise KeyError("a word without ratios")

    def ratios(self, text: bytes) -> np.ndarray:
        codes, start, end = word_codes(text)
        size = end - start + 1
        shift = np.cumsum(size) - size
        hot, short = self.hot.find(codes), size + 1 <= UNIT
        if len(self.hot.store):  # what isn't hot reads from any place and is replaced
            place = np.repeat(np.where(hot >= 0, self.hot.begin[hot], 0) - shift, size)
            place += np.arange(len(place))
            out = self.hot.store.take(place, mode="clip")
        else:
            out = np.zeros(int(size.sum()), np.float32)
        rest = np.flatnonzero(short & (hot < 0))
        if rest.size:
            cold, n = self.cold.find(codes[rest]), size[rest]
            if (cold < 0).any():
                raise KeyError("a word without ratios")
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(shift[rest], n) + step] = self.cold.store[np.repeat(self.cold.begin[cold], n) + step]
        for i in np.flatnonzero(~short).tolist():
            own = unit_codes(units(text[start[i] : end[i]]))
            out[shift[i] : shift[i] + size[i]] = np.concatenate([self.piece(own[k : k + 1]) for k in range(len(own))])
        return out


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, blob): units with whether they are trained on and whether their ratios are broadcast, many to a row."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for batch in held:
                out.write_batch(batch)
        blob = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(blob) >> 1], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    found = pa.ipc.open_stream(blob).read_all()
    return found["unit"].to_pylist(), np.asarray(found["trained"]), np.asarray(found["hot"])


def contexts_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, context): all longest contexts, and the shorter ones of those that no trained word of the chunk has."""
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
            found, trained, _ = unpacked(blob.as_py())
            high, low, unit = unit_grams(found)
            longest, first, of = np.unique(named_context(high, low), return_index=True, return_inverse=True)
            seen = np.bincount(of, trained[unit], len(longest)) > 0
            high, low, asked = high[first[~seen]], low[first[~seen]], [longest]
            for order in ORDERS[1:]:
                more = sizes(high) > order + 1
                asked.append(np.unique(named_context(*shortened(high[more], low[more], order))))
            contexts = np.unique(np.concatenate(asked)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(contexts), chunk)), pa.array(contexts)], ["chunk", "context"])


#: How an n-gram's last byte and its ratio stand in its context's row.
_GRAM = np.dtype([("byte", "u1"), ("ratio", "<f4")])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, backoff, grams): the n-grams of a context that lie together, in one row.

    The n-grams were written in the order of their contexts, so most contexts get one row; who gets several adds them.
    """
    for batch in batches:
        if batch.num_rows:
            context = batch.column("context").to_numpy()
            order = np.argsort(context, kind="stable")
            context, grams = context[order], np.empty(len(order), _GRAM)
            grams["byte"], grams["ratio"] = batch.column("byte").to_numpy()[order], batch.column("ratio").to_numpy()[order]
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            offsets = pa.py_buffer((np.append(first, len(order)) * _GRAM.itemsize).astype(np.int32))
            rows = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(grams.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(context[first]), pa.array(batch.column("backoff").to_numpy()[order][first]), rows], ["context", "backoff", "grams"])


def ungathered(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many n-grams each row has, and the bytes and ratios of all."""
    grams = np.frombuffer(b"".join(rows.to_pylist()), _GRAM)
    return np.asarray(pc.binary_length(rows)) // _GRAM.itemsize, grams["byte"], grams["ratio"]


def chunk_ratios(found: list[bytes], contexts: np.ndarray, backoff: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ratios, unit) of the units' own bytes, each after its longest context of ``contexts``; keys are contexts paired with bytes."""
    high, low, unit = unit_grams(found)
    ratio, unseen = np.zeros(len(low), np.float32), np.ones(len(low), bool)
    order_of, rank = np.argsort(contexts), np.argsort(keys)
    contexts, backoff, keys, values = contexts[order_of], backoff[order_of], keys[rank], values[rank]
    for order in ORDERS if len(contexts) else ():
        at = np.flatnonzero(unseen & ((order == DEPTH) | (sizes(high) > order + 1)))
        h, w = (high[at], low[at]) if order == DEPTH else shortened(high[at], low[at], order)
        name = named_context(h, w)
        i = np.minimum(np.searchsorted(contexts, name), len(contexts) - 1)
        there = contexts[i] == name
        at, i, key = at[there], i[there], paired(name[there], w[there] & U(255))
        j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ratio[at] = np.where(keys[j] == key, values[j], backoff[i])
        unseen[at] = False
    return ratio, unit


def runs(batch: pa.RecordBatch, *names: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of equal values."""
    if batch.num_rows:
        change = np.any([np.diff(np.asarray(batch.column(c))) != 0 for c in names], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def chunks_answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, ratios, hot) of a chunk's units; the contexts that it asked for come before it."""
    here, parts = None, []
    for batch in batches:
        for part in runs(batch, "chunk", "kind"):
            if (chunk := part.column("chunk")[0].as_py()) != here:
                here, parts = chunk, []
            if part.column("kind")[0].as_py() == 0:
                context = part.column("context").to_numpy().view(U)
                n, byte, value = ungathered(part.column("grams"))
                parts.append((context, part.column("backoff").to_numpy(), paired(np.repeat(context, n), byte.astype(U)), value))
                continue
            known = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (U, np.float32, U, np.float32)]
            parts = []
            for blob in part.column("blob"):
                found, _, hot = unpacked(blob.as_py())
                ratio, unit = chunk_ratios(found, *known)
                ends = np.cumsum(np.bincount(unit, minlength=len(found))) * 4
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
                ratios = pa.Array.from_buffers(pa.binary(), len(found), [None, offsets, pa.py_buffer(ratio)])
                out = pa.RecordBatch.from_arrays([pa.array(unit_codes(found).view(np.int64)), ratios, pa.array(hot)], ["code", "ratios", "hot"])
                for k in range(0, out.num_rows, 1 << 14):
                    yield out.slice(k, 1 << 14)


def lexicon_of(words: DataFrame, judged: DataFrame, path: str) -> DataFrame:
    """(code, ratios, hot) of every word.  ``path`` is where the words are, which are removed as soon as they are read."""
    step = F.floor(F.log2(F.col("texts")) * 16).cast("int")
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).toPandas().sort_values("step", ascending=False)
    fits = steps["n"].cumsum() <= MOST_WORDS
    least = int(steps["step"][fits].min()) if fits.any() else 1 << 30
    known = words.select("unit", (F.col("ordinary") + F.col("toxic") > 0).alias("trained"), (step >= least).alias("hot"))
    # Sorted, so that the words of a chunk share their contexts.
    n = int(steps["n"].sum())
    ordered = known.repartitionByRange(max(1, -(-n // CHUNK)), "unit").sortWithinPartitions("unit")
    # Partitions are of about equal size, so slices by their numbers are too.
    packed = ordered.mapInArrow(light(chunked), "chunk long, blob binary").withColumn("part", F.spark_partition_id())
    chunks, chunks_path = settled_at(packed, "chunks")
    remove_path(words.sparkSession, path)
    contexts = judged.select("context", F.col("low").bitwiseAND(255).cast("short").alias("byte"), "ratio", "backoff").mapInArrow(light(gathered), "context long, backoff float, grams binary")
    out, slices = None, CHUNK_SLICES if n > FEW_WORDS else 1
    for k in range(slices):
        mine = chunks.where(F.pmod("part", F.lit(slices)) == k).drop("part")
        told = mine.mapInArrow(light(contexts_asked), "chunk long, context long").join(contexts, "context")
        both = told.withColumn("kind", F.lit(0)).unionByName(mine.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        ordered = both.repartition("chunk").sortWithinPartitions("chunk", "kind")
        with configured(words.sparkSession, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED):
            part = settled(ordered.mapInArrow(light(chunks_answered), "code long, ratios binary, hot boolean"), "lexicon")
        out = part if out is None else out.union(part)
    remove_path(words.sparkSession, chunks_path)
    return out


@dataclass
class Joined:
    """A model that stays in Spark: the ratios of all words but those that are broadcast."""

    cold: DataFrame
    slices: int
    curve: np.ndarray

    def weighed(self, documents: DataFrame, held: object, columns: list[str], slices: int | None = None) -> DataFrame:
        """``columns`` of the documents as ``row``, and the two ratios of ``text``."""
        spark, slices = documents.sparkSession, slices or self.slices
        groups = max(1, documents.count() // GROUP)
        row = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")
        group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("group")
        rows = documents.select(group, F.lit(1).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), row)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot = held.value
            for batch in batches:
                texts: list[bytes] = []
                of: list[int] = []
                size = 0
                for i, (g, text) in enumerate(zip(batch.column("group").to_pylist(), batch.column("text"), strict=True)):
                    if b := clean(text.as_py()):
                        texts.append(b[:-1])
                        of.append(g)
                        size += len(b)
                    if texts and (size > STRETCH or i == batch.num_rows - 1):
                        yield words_asked(texts, np.array(of, np.int64), hot)
                        texts, of, size = [], [], 0

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, parts, reader = None, [], None
            for batch in batches:
                for part in runs(batch, "group", "kind"):
                    if (g := part.column("group")[0].as_py()) != here:
                        here, parts, reader = g, [], None
                    if part.column("kind")[0].as_py() == 0:
                        parts.append((part.column("code").to_numpy().view(U), part.column("ratios")))
                        continue
                    if reader is None:
                        codes = np.concatenate([np.zeros(0, U), *(c for c, _ in parts)])
                        reader, parts = Reader(held.value, Lexicon(codes, pa.chunked_array([r for _, r in parts], pa.binary()))), []
                    found = reader.evidence(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["row", "whole", "passage"])

        schema = StructType(documents.select(row).schema.fields).add("whole", "double").add("passage", "double")
        out = None
        with configured(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500", spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED):
            for k in range(slices):
                mine = rows.where(F.pmod("group", F.lit(slices)) == k)
                told = mine.select("group", "text").mapInArrow(light(ask), "group long, code long").join(self.cold, "code")
                both = told.withColumn("kind", F.lit(0)).unionByName(mine, allowMissingColumns=True)
                ordered = both.repartition("group").sortWithinPartitions("group", "kind")
                part = settled(ordered.mapInArrow(light(answer), schema), "weighed")
                out = part if out is None else out.union(part)
        return out


def words_asked(texts: list[bytes], group: np.ndarray, hot: Lexicon) -> pa.RecordBatch:
    """(group, code) of the words that aren't broadcast; each text begins with a space and lacks its last one."""
    text = b"".join(texts) + b" "
    codes, start, end = word_codes(text)
    of = group[np.searchsorted(np.cumsum([len(x) for x in texts]), start, "right")]
    short = end - start + 2 <= UNIT
    for i in np.flatnonzero(~short).tolist():
        own = unit_codes(units(text[start[i] : end[i]]))
        codes, of, short = np.concatenate([codes, own]), np.concatenate([of, np.full(len(own), of[i])]), np.concatenate([short, np.ones(len(own), bool)])
    ask = short & (hot.find(codes) < 0)
    codes, of = codes[ask], of[ask]
    first = np.unique(paired(of.view(U), codes), return_index=True)[1]
    return pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array(codes[first].view(np.int64))], ["group", "code"])


def texts_of(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(label, blob) of all rows; texts travel compressed to their labels, which may be any number.

    Rows without a label have null.  Those without a doc_id are dealt by their text.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [press.compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("salt"), pa.array(blobs, pa.binary())], ["doc_id", "salt", "blob"])

    key = F.col("doc_id").cast("long")
    salt = F.when(key.isNull(), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long")
    there = documents.select(F.coalesce(key, F.lit(0)).alias("doc_id"), salt.alias("salt"), "text")
    labels = chosen.withColumn("salt", F.lit(0).cast("long"))
    return there.mapInArrow(light(squeeze), "doc_id long, salt long, blob binary").join(labels, ["doc_id", "salt"], "left").select("label", "blob")


def fit(documents: DataFrame, labels: DataFrame, training: Column) -> tuple[Model | Joined, object]:
    """The model, and what of it is broadcast (without the curve)."""
    spark = documents.sparkSession
    chosen = training_labels(labels, "toxic", training)
    n = max(1, chosen.count())
    for_curve = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(1 << 40)) < int(min(1 / CURVE_SHARE, MOST_CURVE / n) * (1 << 40))
    counted = texts_of(documents, chosen.where(~for_curve)).mapInArrow(light(word_counts), "unit binary, ordinary long, toxic long, texts long")
    # Whole texts are in a worker's memory.
    with configured(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000", spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED):
        # A task hands a word on once, so nothing is summed before the shuffle.
        words, words_path = settled_at(counted.repartition("unit").groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic", "texts")]), "words")
    trained = words.where("ordinary + toxic > 0").select("unit", "ordinary", "toxic")
    paths = [words_path]
    judged = kneser_ney(trained.mapInArrow(light(longest_grams), GRAM), paths)
    small = judged.count() <= MOST_GRAMS and judged.select("context").distinct().count() <= MOST_CONTEXTS
    bare = np.array([-2.0, 1.0, 1.0])
    rows = bounded_labels(documents, chosen.where(for_curve))
    if small:
        model = Model(*tables(judged), bare)
        for path in paths:
            remove_path(spark, path)
        held = spark.sparkContext.broadcast(model)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(held.value)
            for batch in batches:
                found = scorer.evidence(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "label", "whole", "passage"])

        seen = rows.select("doc_id", "label", "text").mapInArrow(light(weigh), "doc_id long, label int, whole double, passage double")
    else:
        lexicon = lexicon_of(words, judged, words_path)
        hot = lexicon.where("hot").select("code", "ratios").toArrow()
        held = spark.sparkContext.broadcast(Lexicon(hot["code"].to_numpy().view(U), hot["ratios"]))
        model = Joined(lexicon.where("not hot").select("code", "ratios"), SLICES if lexicon.count() > FEW_WORDS else 1, bare)
        for path in paths:
            remove_path(spark, path)
        rows = settled(rows, "curve")
        seen = model.weighed(rows, held, ["doc_id", "label"], 1).select(F.col("row.c0").alias("doc_id"), F.col("row.c1").alias("label"), "whole", "passage")
    seen = seen.orderBy("doc_id", "label", "whole", "passage").toPandas()
    if seen["label"].nunique() == 2:
        model.curve = fit_curve(seen[["whole", "passage"]].to_numpy(float), seen["label"].to_numpy(float))
    return model, held


def judged_rows(documents: DataFrame, model: Model | Joined, held: object, columns: list[str], judged: str) -> DataFrame:
    """``columns``, and ``judged`` with score, whole and passage."""
    curve = model.curve
    if isinstance(model, Joined):

        @F.arrow_udf("double")
        def curved_score(whole: pa.Array, passage: pa.Array) -> pa.Array:
            return pa.array(curved(np.column_stack([np.asarray(whole), np.asarray(passage)]), curve))

        found = model.weighed(documents, held, columns)
        result = F.struct(curved_score("whole", "passage").alias("score"), "whole", "passage")
        return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)], result.alias(judged))

    @F.arrow_udf("struct<score: double, whole: double, passage: double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        for text in batches:
            found = scorer.evidence(text)
            yield pa.StructArray.from_arrays([pa.array(curved(found, curve)), pa.array(found[:, 0]), pa.array(found[:, 1])], ["score", "whole", "passage"])

    return documents.select(*[F.col(quoted(c)) for c in columns], judge(F.coalesce("text", F.lit(""))).alias(judged))


def scored(documents: DataFrame, model: Model | Joined, held: object, modulus: int = 5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``documents`` (of ``keep`` and the doc_id, where named) with held_out, score and predicted, and the two log-likelihood ratios."""
    judged = unused(documents, "judged")
    columns = documents.columns if keep is None else ["doc_id", *(c for c in keep if c != "doc_id")]
    return (
        judged_rows(documents, model, held, columns, judged)
        .withColumns(
            {
                "held_out": F.coalesce(fold_of("doc_id", modulus) == 0, F.lit(False)),
                "score": F.col(f"{judged}.score"),
                "predicted": (F.col(f"{judged}.score") >= 0.5).cast("int"),
                "whole_llr": F.col(f"{judged}.whole"),
                "passage_llr": F.col(f"{judged}.passage"),
            }
        )
        .drop(judged)
    )


def detect(documents: DataFrame, labels: DataFrame, modulus: int = 5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Fit on the labelled rows of the other folds and score every document."""
    return scored(documents, *fit(documents, labels, fold_of("doc_id", modulus) != 0), modulus, keep)
