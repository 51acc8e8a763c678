"""Byte-pair encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so the text may be cut between
the two bytes and the fragments encoded on their own; the concatenation of their ids is the encoding of the
whole.  No token holds a space, so every space is such a cut: texts are first split there, and the fragments'
encodings are remembered in a bounded table.  A fragment that isn't remembered is split by the tokenizer's
own pattern and then at every forced byte pair; each remaining piece is encoded by itself.

Nulls count as empty texts; empty texts give no ids.  Texts of any length are handled whole.  Repeated rows give
repeated rows, an empty table an empty result.  Columns other than doc_id and text are not read by ``digest_documents``;
``encode_column`` keeps them and replaces those of its own names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import models

#: Fragments and pieces remembered by a worker; others are encoded again each time.
REMEMBERED = 250_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for span in ((33, 126), (161, 172), (174, 255)) for b in range(span[0], span[1] + 1)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class Remembering(dict):
    """A dict that computes what it lacks and keeps it while there is room."""

    def __init__(self, compute, room: int = REMEMBERED):
        super().__init__()
        self.compute, self.room = compute, room

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.room:
            self[key] = value
        return value


class WordBpe:
    """A BPE with word ends, read from a tokenizers file: lower-cased NFC text, words by the file's pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.final = models.BPE(self.vocab, merges, end_of_word_suffix=self.suffix or None)
        self.inner = models.BPE(self.vocab, merges)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.alphabet = {chr(b): c for b, c in byte_alphabet().items()}
        self.letters = str.maketrans(self.alphabet)
        self.pairs = self._pairs_inside_tokens()
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.free = self._free_letters()
        self.word = Remembering(self._encode_word)
        self.fragments = Remembering(self._encode_fragment)

    def _pairs_inside_tokens(self) -> set[str]:
        inside: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            inside.update(map(str.__add__, body, body[1:]))
        return inside

    def _free_letters(self) -> frozenset[str]:
        """ASCII letters of which every pair is inside some token: a word of these alone has no forced cut."""
        ascii_letters = [chr(c) for c in range(97, 123)]
        return frozenset(a for a in ascii_letters if all(a + b in self.pairs and b + a in self.pairs for b in ascii_letters))

    def cuts(self, word: str) -> list[str]:
        """A word in the byte alphabet, split at every pair that is inside no token."""
        if self.free.issuperset(word):
            return [word]
        start, found = 0, []
        for i, pair in enumerate(map(str.__add__, word, word[1:]), 1):
            if pair not in self.pairs:
                found.append(word[start:i])
                start = i
        found.append(word[start:])
        return found

    def _encode_word(self, word: str) -> tuple[bytes, int, bytes]:
        """A match of the tokenizer's pattern, lower-cased already: ids as text, their number, the decoded text."""
        *inner, last = self.cuts(word if word.isascii() and word.isalpha() else word.encode("utf-8").decode("latin-1").translate(self.letters))
        tokens = [t for piece in inner for t in self.inner.tokenize(piece)] + self.final.tokenize(last)
        return " ".join([str(t.id) for t in tokens]).encode(), len(tokens), " ".join([t.value for t in tokens]).encode("utf-8")

    def _encode_fragment(self, fragment: str) -> tuple[bytes, int, bytes]:
        """A run without spaces.  The plain case is a word and then stops; the pattern splits any other."""
        core = fragment.rstrip(".,;:!?")
        lower = (core if core.isascii() else unicodedata.normalize("NFC", core).replace("Σ", "σ")).lower()
        if lower.isalpha():
            found = [self.word[lower], self.word[fragment[len(core) :]]] if len(core) < len(fragment) else [self.word[lower]]
        else:
            found = []
            for part in self.specials.split(fragment) if self.specials else (fragment,):
                if part in self.special:
                    found.append((str(self.special[part]).encode(), 1, part.encode()))
                    continue
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                found += [self.word[w] for w in self.words.findall(part.lower())]
        return b" ".join([f[0] for f in found]), sum([f[1] for f in found]), b" ".join([f[2] for f in found])

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, b" ".join([self.fragments[f][0] for f in (text or "").split(" ")]).split()))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does."""
        return " ".join([self.names[i] for i in ids])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids as decimal text, sha256 of the decoded text."""
        ids, n, decoded = zip(*map(self.fragments.__getitem__, (text or "").split(" ")))
        return sum(n), hashlib.sha256(b" ".join(filter(None, ids))).hexdigest(), hashlib.sha256(b" ".join(filter(None, decoded))).hexdigest()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_column(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row of ``documents`` with ``ids`` (array of int) and ``decoded`` (string) added; clashing columns are replaced."""
    kept = documents.drop("ids", "decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(text).to_pylist()]
            columns = [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "ids", "decoded"])

    return kept.mapInArrow(run, schema)


def digest_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, without shipping the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            found = [bpe.digests(t) for t in batch.column("text").to_pylist()]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
