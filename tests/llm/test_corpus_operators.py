"""Each corpus operator against brute force or an exact round trip, with nulls, empty and repeated rows, and clashing columns."""

import base64
import collections
import hashlib
import pickle
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import ball_tree, bpe, minhash, multi_index, packing, quality, repeats, suffix_array, suffix_tree, symbols, toxicity, warc
from lattica.llm import components as components_module
from lattica.llm.common import shared_dir
from lattica.llm.components import components
from lattica.llm.symbols import word_codes

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, score string, predicted string, held_out string, word string, bucket int, rest string"
ODD = [None, "", " ", "\n\n", "a", "  a  b\t\nc ", "é ü ñ 你好 😀", "<|endoftext|>x <|startoftext|>", "it's THEY'LL 2024 ½ Σας İ ﬁ", "x" * 300, "\x1c\x85  ", "a\n b \n", "don't!!! ..", "word " * 400]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "s", "p", "h", "w", 7, "r") for i, t in enumerate(texts)], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "alpha", "beta", "gamma", "delta", "und", "été"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(3, 260)) for _ in range(40)]
    shared = sentence(rng, 70)
    out = list(ODD) + base
    for i in range(12):  # passages, copies and near copies
        words = base[i].split()
        out.append(" ".join(words[: len(words) // 2]) + "\n" + shared + " " + sentence(rng, 20))
        out.append(base[i])
        edited = base[20 + i].split()
        edited[len(edited) // 3] = "edited"
        out.append(" ".join(edited))
    out += [shared + "\t" + shared, base[0] * 3, "copied text of words " * 30, "copied text of words " * 30]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    return frame(spark, texts).repartition(3)


# BPE


def test_bpe_is_the_librarys(spark, documents, texts):
    library = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in bpe.digest_documents(documents, WORD_BPE).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe.encode_column(documents.withColumn("ids", F.lit("clash")), WORD_BPE).where("doc_id = 8").first()
    assert whole.ids == library.encode(texts[8], add_special_tokens=False).ids and whole.decoded == library.decode(whole.ids, skip_special_tokens=False)
    assert bpe.digest_documents(documents.limit(0), WORD_BPE).count() == 0


def test_forced_cuts_are_in_no_token():
    b = bpe.word_bpe(WORD_BPE)
    pieces = b.cuts("thexqzjkwvthe")
    assert "".join(pieces) == "thexqzjkwvthe"
    assert all(left[-1] + right[0] not in b.pairs for left, right in zip(pieces, pieces[1:], strict=False))


# Packing


def test_packing(spark, documents, texts):
    library = Tokenizer.from_file(BYTE_BPE)
    long = "long words of a very long text " * 900
    docs = documents.union(frame(spark, [long], 1000)).union(frame(spark, ["a b"], 4))  # a repeated doc_id
    got = packing.pack(docs, BYTE_BPE, group_rows=30).toPandas()
    want = []
    for i, t in [*enumerate(texts), (1000, long), (4, "a b")]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        starts = [0, *range(cut, len(ids), 2048)] if cut else list(range(0, len(ids), 2048))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.append((i, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert group.length.sum() <= 2048
        assert list(group.offset) == [0, *np.cumsum(group.length)[:-1]]
    assert packing.pack(documents.limit(0), BYTE_BPE).count() == 0


def longest_first(sizes, capacity):
    """Bins of a plain best fit, from the longest on."""
    rooms = []
    for x in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit, key=rooms.__getitem__)] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def least_bins(sizes, capacity):
    """The least number of bins, by dynamic programming over all subsets."""
    best = {0: (1, capacity)}
    for have in range(1 << len(sizes)):
        bins, room = best[have]
        for i, x in enumerate(sizes):
            if not have >> i & 1:
                found = (bins, room - x) if x <= room else (bins + 1, capacity - x)
                now = best.get(have | 1 << i, (len(sizes) + 1, 0))
                if (found[0], -found[1]) < (now[0], -now[1]):
                    best[have | 1 << i] = found
    return best[(1 << len(sizes)) - 1][0]


def check_bins(bins, sizes):
    assert sorted(x for b in bins.items for x in b) == sorted((x, i) for i, x in enumerate(sizes))
    assert all(sum(x for x, _ in b) + r == bins.capacity and r >= 0 for b, r in zip(bins.items, bins.room, strict=True))


def test_local_search_empties_bins():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(400, 900, 900), rng.choice([1045, 553, 532, 471], 900), np.minimum(2048, 1 + rng.lognormal(5.5, 1, 900).astype(int)), np.full(300, 700)):
        bins = packing.Bins(2048)
        for i, x in enumerate(sizes.tolist()):
            bins.place((x, i))
        before, squares = bins.used(), sum((2048 - r) ** 2 for r in bins.room)
        emptied = packing.local_search(bins)
        check_bins(bins, sizes.tolist())
        assert bins.used() == before - emptied and sum((2048 - r) ** 2 for r in bins.room) >= squares
        assert emptied > 0 or sizes.min() == sizes.max()
        assert packing.searched(sizes).used() <= min(bins.used(), longest_first(sizes.tolist(), 2048))
        which, offset = packing.packed_lengths(sizes)
        assert np.bincount(which, weights=sizes).max() <= 2048 and (offset + sizes <= 2048).all()


def test_small_packings_are_near_the_least():
    rng = np.random.default_rng(3)
    extra = 0
    for _ in range(60):
        sizes = rng.integers(1, 31, rng.integers(1, 11))
        bins = packing.searched(sizes, 30)
        check_bins(bins, sizes.tolist())
        extra += bins.used() - least_bins(sizes.tolist(), 30)
    assert extra == 0


def test_equal_rows_are_dealt_over_groups(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, "same words") for i in range(400)], "doc_id long, text string")
    rows = packing.tokenized(docs, BYTE_BPE, 8).groupBy("pack_group").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 120
    got = packing.pack(docs, BYTE_BPE, group_rows=100).toPandas()
    assert len(got) == 400 and (got.groupby("sequence_id").length.sum() <= 2048).all() and got.doc_id.isna().sum() == 200


# Classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = sentence(rng, rng.randrange(20, 120)).split()
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "vilest", "rotten"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[: len(words) // 2])
        rows.append(text)
        labels.append((i, int(good), int(toxic)))
    rows += [None, "", rows[1]]
    labels += [(5, 1, 1), (None, 1, 1), (9999, 0, 0), (401, None, None)]
    return frame(spark, rows).repartition(2), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "label", "modulus", "remainder"), [(toxicity.detect, "toxic", 5, 0), (quality.classify, "quality", 3, 1)])
def test_classifiers(spark, labelled, run, label, modulus, remainder):
    docs, labels = labelled
    got = run(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == 403 and got.score.between(0, 1).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert [zlib.crc32(str(i).encode()) % modulus == remainder for i in got.index] == got.held_out.tolist()
    assert got.score[1] == got.score[402] and got.score[400] == got.score[401]
    truth = labels.dropna().dropDuplicates(["doc_id"]).where("doc_id < 400 and doc_id <> 5").toPandas().set_index("doc_id")[label]
    held = got[got.held_out & got.index.isin(truth.index)]
    assert (held.predicted == truth[held.index]).mean() > 0.9
    again = run(docs.repartition(5), labels).toPandas().set_index("doc_id")
    assert np.allclose(got.score, again.score[got.index])


@pytest.mark.parametrize("run", [toxicity.detect, quality.classify])
def test_classifiers_without_rows(spark, labelled, run):
    docs, labels = labelled
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.limit(0)).count() == 403  # nothing to learn from: a score all the same


def test_every_byte_is_scored():
    for text in ("x" * 300, "你好" * 1000, "a bc", "https://a.b/" + "c_" * 40):
        clean = toxicity.clean(text)
        high, low = toxicity.grams(clean)
        begin = [max(clean.rfind(b" ", 0, i), i - toxicity.DEPTH) for i in range(1, len(clean))]
        want = [clean[a : i + 1] for i, a in enumerate(begin, 1)]
        assert [((int(h) & (1 << 48) - 1) << 64 | int(w)).to_bytes(14, "big")[14 - n :] for h, w, n in zip(high, low, toxicity.sizes(high), strict=True)] == want


def plain_kneser_ney(rows):
    """The model by dictionaries: log ratio of a byte string's last byte after the bytes before it, and None for an unseen context."""
    longest = collections.Counter()
    for text, toxic in rows:
        for word in set(text.lower().split()):
            w = b" %b " % word.encode()
            for i in range(1, len(w)):
                longest[w[max(0, i - 12) : i + 1], toxic] += 1
    counts, done = dict(longest), dict(longest)
    for order in (6, 4, 3, 2, 1):
        longer = {g for g, _ in counts if len(g) > order + 1}
        shorter = {(g[-order - 1 :], c): set() for g, c in counts if g in longer}
        for g, c in counts:
            if g in longer:
                shorter[g[-order - 1 :], c].add(g)
        counts = {k: n for k, n in counts.items() if k[0] not in longer} | {k: len(v) for k, v in shorter.items()}
        done |= counts
    ends = collections.Counter(g[-2:] for g in {g for g, _ in longest})
    after = collections.Counter()
    for tail, n in ends.items():
        after[tail[:1]] += n
    total, types = collections.Counter(), collections.Counter()
    for (g, c), n in done.items():
        total[g[:-1], c] += n
        types[g[:-1], c] += 1

    def ratio(context, byte):
        if not total[context, 0] + total[context, 1]:
            return None
        back = [0.75 * types[context, c] / total[context, c] if total[context, c] else 1.0 for c in (0, 1)]
        if not any((context + byte, c) in done for c in (0, 1)):
            return np.log(back[1] / back[0])
        below = ends[context[-1:] + byte] / after[context[-1:]]
        p = [max(done.get((context + byte, c), 0) - 0.75, 0) / max(1, total[context, c]) + back[c] * below for c in (0, 1)]
        return np.log(p[1] / p[0])

    def ratios(text):
        out = []
        for i in range(1, len(text)):
            begin = max(text.rfind(b" ", 0, i), i - 12)
            for order in (12, 6, 4, 3, 2, 1):
                if order == 12 or i - begin > order:
                    found = ratio(text[max(begin, i - order) : i], text[i : i + 1])
                    if found is not None:
                        break
            out.append(0.0 if found is None else found)
        return np.array(out)

    return ratios


def test_toxicity_is_plain_kneser_ney(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(3, 9))) for _ in range(1500)] + ["gamma"] * 100 + ["é" * 90, "x" * 400]
    texts = [" ".join(rng.sample(words, 60) + ["rotten", "Rotten"] * (i % 4 == 0)) for i in range(400)] + [None, ""]
    docs = frame(spark, texts).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(402)], "doc_id long, toxic int")
    share = (F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(1 << 40)) < (1 << 38)).alias("curve")
    left_out = {r.doc_id for r in docs.select("doc_id", share).where("curve").collect()}
    model, _ = toxicity.fit(docs, labels, F.lit(True))
    want = plain_kneser_ney([(t or "", int(i % 4 == 0)) for i, t in enumerate(texts) if i not in left_out])
    scorer = toxicity.Scorer(pickle.loads(pickle.dumps(model)))
    for text in [texts[1], '"rotten (rotten) **rotten** alpha_beta_rotten_delta', "x" * 300 + " unseenword é", "éééé" * 60]:
        clean = toxicity.clean(text)
        assert np.allclose(model.ratios(clean), want(clean), atol=1e-5)
        assert np.array_equal(scorer.ratios(clean), model.ratios(clean))
        ratio = want(clean)
        sums = [ratio[k : k + 8].sum() for k in range(len(ratio) - 7)]
        assert np.allclose(scorer.evidence(pa.array([None, text, "", text]))[[1, 3]], [ratio.mean(), max(sums) / 8], atol=1e-5)
    for around in ('"{}', "({})", "**{}**", "ordinary_alpha_beta_gamma_{}_delta", "https://delta.und/alpha-beta-{}"):
        found = scorer.evidence(pa.array([around.format("rotten"), around.format("gamma")]))
        assert found[0, 1] > found[1, 1] + 0.1


def test_a_model_beyond_the_bounds_counts_every_ngram(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 15))) for _ in range(1200)] + ["é" * 90, "x" * 400, "你好" * 60]
    texts = [" ".join(rng.sample(words, 40) + [f"only{i}"] + ["rotten"] * (i % 4 == 0)) for i in range(300)] + [None, "", " \n", "x" * 300 + " unseen é", "é" * 400]
    docs = frame(spark, [*texts, texts[3]]).union(spark.createDataFrame([(None, texts[5] + " nobody", *"spxw", 7, "r")] * 2, SCHEMA)).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(250)], "doc_id long, toxic int")
    columns = ["doc_id", "held_out", "score", "predicted", "whole_llr", "passage_llr", "rest", "bucket"]

    def run():
        return sorted(toxicity.detect(docs, labels).select(columns).collect(), key=lambda r: (r.doc_id is None, r.doc_id))

    want = run()
    for bounds in ({"MOST_WORDS": 100, "CHUNK": 64, "GROUP": 16, "FEW_WORDS": 9, "MOST_GRAMS": 50}, {"MOST_WORDS": 0, "MOST_CONTEXTS": 50, "STRETCH": 64, "GROUP": 1000}):
        for name, value in bounds.items():
            monkeypatch.setattr(toxicity, name, value)
        got = run()
        assert len(got) == len(want) == 308
        for a, b in zip(got, want, strict=True):
            assert (a.doc_id, a.held_out, a.predicted, a.rest, a.bucket) == (b.doc_id, b.held_out, b.predicted, b.rest, b.bucket)
            assert np.allclose([a.score, a.whole_llr, a.passage_llr], [b.score, b.whole_llr, b.passage_llr], atol=1e-5)


def test_a_large_model_leaves_only_its_words_on_disk(spark, monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 15))) for _ in range(900)]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(200)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    for name, value in {"MOST_WORDS": 100, "CHUNK": 64, "FEW_WORDS": 9, "MOST_GRAMS": 50}.items():
        monkeypatch.setattr(toxicity, name, value)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    model, held = toxicity.fit(docs, labels, F.lit(True))
    left = sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before)
    assert [x for x in left if x != "weighed"] == ["curve", "lexicon", "lexicon"]  # the chunks were joined one part after another
    cold = [r.code for r in model.cold.collect()]
    assert len(cold) == len(set(cold)) == len({w for t in texts for w in t.split()}) - len(held.value.codes)


def test_a_task_hands_a_word_on_once():
    text = " ".join(f"w{i}" for i in range(95_000)) + " " + "é" * 100
    blob = zstandard.ZstdCompressor().compress(text.encode())
    batches = [pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([blob], pa.binary())], ["label", "blob"]) for label in (0, 1, None, 1)]
    got = pa.Table.from_batches(toxicity.word_counts(iter(batches)))
    assert got["unit"].to_pylist() == list(dict.fromkeys(got["unit"].to_pylist()))
    assert set(got["unit"].to_pylist()) == {b" w%d " % i for i in range(95_000)} | set(toxicity.units(("é" * 100).encode()))
    assert [got[c].unique().to_pylist() for c in ("ordinary", "toxic", "texts")] == [[1], [2], [4]]


def test_a_task_of_many_words_hands_each_on_once():
    parts = [range(160_000), range(100_000, 320_000), range(160_000), range(0)]
    blobs = [zstandard.ZstdCompressor().compress(" ".join(f"W{i}" for i in [*part, *part[:9]]).encode()) for part in parts]
    batches = [pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([blob], pa.binary())], ["label", "blob"]) for label, blob in zip((0, 1, None, 0), blobs, strict=True)]
    got = pa.Table.from_batches(toxicity.word_counts(iter(batches))).to_pylist()
    assert len(got) == 320_000
    for row in got:
        i = int(row["unit"][2:])
        assert row["unit"] == b" w%d " % i
        assert (row["ordinary"], row["toxic"], row["texts"]) == (i < 160_000, i >= 100_000, 2 * (i < 160_000) + (i >= 100_000))


def test_counts_are_right_however_often_a_task_hands_them_on(monkeypatch):
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["é", "b", "你好", "x" * 200, "C\x1fd", "e\u2003f"]) + str(rng.randrange(30)) for _ in range(rng.randrange(40))) for _ in range(90)]
    press = zstandard.ZstdCompressor()
    batch = pa.RecordBatch.from_arrays([pa.array([[0, 1, None][i % 3] for i in range(90)], pa.int32()), pa.array([press.compress(t.encode()) for t in texts], pa.binary())], ["label", "blob"])
    want: dict = {}
    for i, t in enumerate(texts):
        for unit in (u for w in set(t.lower().split()) for u in toxicity.units(w.encode())):
            n = want.setdefault(unit, [0, 0, 0])
            n[2] += 1
            if i % 3 < 2:
                n[i % 3] += 1
    for counted, most in ((1 << 22, 800_000), (300, 40), (0, 0)):
        monkeypatch.setattr(toxicity, "COUNTED", counted)
        monkeypatch.setattr(toxicity, "FLUSH_WORDS", most)
        got: dict = {}
        for row in pa.Table.from_batches(toxicity.word_counts(iter([batch]))).to_pylist():
            n = got.setdefault(row["unit"], [0, 0, 0])
            for k, c in enumerate(("ordinary", "toxic", "texts")):
                n[k] += row[c]
        assert got == want


def test_clean_takes_for_white_space_what_split_does():
    spaces = [chr(i) for i in range(0x11000) if chr(i).isspace()]
    for text in [None, "", *spaces, *(f"{a}A{w}{w}{b}{w}" for w in spaces for a in ("", "\u201c", "É ") for b in ("B", "\u00ad", "\ud800"))]:
        words = (text or "").lower().split()
        assert toxicity.clean(text) == (b" %b " % " ".join(words).encode("utf-8", "replace") if words else b"")


def test_a_context_may_come_in_several_rows():
    found = toxicity.units(b"abc") + toxicity.units(b"abd")
    high, low, _ = toxicity.unit_grams(found)
    context, byte = toxicity.named_context(high, low).view(np.int64), (low & np.uint64(255)).astype(np.int16)
    names = ["context", "byte", "ratio", "backoff"]
    rows = pa.RecordBatch.from_arrays([pa.array(context), pa.array(byte), pa.array(byte / 128, pa.float32()), pa.array(context % 7, pa.float32())], names)

    def ratios(size):
        parts = list(toxicity.gathered(rows.slice(k, size) for k in range(0, rows.num_rows, size)))
        told = pa.Table.from_batches(parts).combine_chunks()
        n, last, value = toxicity.ungathered(told["grams"].chunk(0))
        contexts = told["context"].to_numpy().view(np.uint64)
        keys = toxicity.paired(np.repeat(contexts, n), last.astype(np.uint64))
        return told.num_rows, toxicity.chunk_ratios(found, contexts, told["backoff"].to_numpy(), keys, value)[0]

    one, apart = ratios(rows.num_rows), ratios(1)
    assert one[0] == len(set(context.tolist())) < apart[0] == rows.num_rows
    assert np.array_equal(one[1], apart[1]) and np.array_equal(one[1], (byte / 128).astype(np.float32))


def test_words_are_found_in_lexicons_of_any_size():
    rng = np.random.default_rng(6)
    for n in (1, 100, toxicity.LARGE + 50):
        codes = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        words = toxicity.Lexicon(rng.permutation(codes), pa.array([b"1234"] * len(codes), pa.binary()))
        asked = np.concatenate([codes[::3], codes[::3] + np.uint64(1 << 63)])
        at = pickle.loads(pickle.dumps(words)).find(asked)
        assert (words.codes[at[: len(codes[::3])]] == codes[::3]).all() and (at[len(codes[::3]) :] == -1).all()


def test_a_text_beyond_a_stretch_is_scored_whole(monkeypatch):
    model = toxicity.Model(toxicity.Table(np.zeros(0, np.uint64), np.zeros(0, np.float32)), toxicity.Table(np.zeros(0, np.uint64), np.zeros(0, np.float32)), np.zeros(3))
    monkeypatch.setattr(toxicity.Model, "ratios", lambda self, text: np.array([b / 100 for b in text[1:]], np.float32))
    texts = pa.array(["word " * 30 + "zzzz" * 9 + " end", "one", "y" * 400, " a b"])
    want = toxicity.Scorer(model).evidence(texts)
    monkeypatch.setattr(toxicity, "STRETCH", 64)
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    assert np.allclose(toxicity.Scorer(model).evidence(texts), want)


def test_units_have_every_gram_once():
    words = [b"a", "é".encode() * 200, b"x" * 500, b"abc" * 40]
    for w in words:
        high, low, _ = toxicity.unit_grams(toxicity.units(w))
        want_high, want_low = toxicity.grams(b" %b " % w)
        assert sorted(zip(high.tolist(), low.tolist(), strict=True)) == sorted(zip(want_high.tolist(), want_low.tolist(), strict=True))


@pytest.mark.parametrize(("run", "names"), [(toxicity.detect, ("judged", "tail", "label")), (quality.classify, ("a.b", "label"))])
def test_classifiers_replace_only_their_own_columns(spark, labelled, run, names):
    docs, labels = labelled
    for name in names:
        docs = docs.withColumn(name, F.lit("mine"))
    got = run(docs, labels)
    assert all(got.select(f"`{name}`").distinct().first()[0] == "mine" for name in names)
    assert got.schema["score"].dataType.typeName() == "double" and got.schema["predicted"].dataType.typeName() == "integer"


def test_very_long_texts(spark):
    rng = random.Random(2)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200_000))  # 1.4 MB
    edited = base[:700_000] + " edited here " + base[700_000:]
    docs = spark.createDataFrame([(1, base, 0), (2, edited, 0), (3, "short text", 1), (4, "other short text", 0)], "doc_id long, text string, toxic int")
    tree = {r.doc_id: r for r in suffix_tree.digests(docs).collect()}
    array = {r.doc_id: r for r in suffix_array.digests(docs).collect()}
    assert tree[1].n_removed == 0 and 200_000 <= tree[2].n_removed <= tree[2].n_words - 2
    assert array[1].n_removed == 0 and len(base) - 10 <= array[2].n_removed <= len(base) + 4 and array[2].n_spans == 2
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    for run, label in ((toxicity.detect, "toxic"), (quality.classify, "quality")):
        got = run(docs, docs.select("doc_id", F.col("toxic").alias(label))).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    library = Tokenizer.from_file(WORD_BPE)
    assert {r.doc_id: r.n_tokens for r in bpe.digest_documents(docs, WORD_BPE).collect()}[2] == len(library.encode(edited, add_special_tokens=False).ids)


def test_ngram_table():
    codes = np.unique(np.random.default_rng(2).integers(1, 2**40, 5000).astype(np.uint64))
    table = toxicity.Table(codes, np.arange(len(codes), dtype=np.float32))
    values, found = table.get(np.concatenate([codes, codes + np.uint64(1 << 50)]))
    assert found[: len(codes)].all() and not found[len(codes) :].any() and (values[: len(codes)] == np.arange(len(codes))).all()


def test_boosted_pairs_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, :2] = rng.random((2000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert (1, 0) in [p[:2] for p in model.pairs]


def plain_step(bins, residual, weight, n, leaves):
    """One boosting step along an axis by trying every cut: the value of each bin."""

    def worth(a, b):
        g, h = sum(r for k, r in zip(bins, residual, strict=True) if a <= k < b), sum(w for k, w in zip(bins, weight, strict=True) if a <= k < b)
        return g * g / (h + 1), g / (h + 1)

    edges = [0, n]
    while len(edges) < leaves + 1:
        won, cut = max((worth(a, c)[0] + worth(c, b)[0] - worth(a, b)[0], c) for a, b in zip(edges, edges[1:], strict=False) for c in range(a + 1, b))
        if won <= 1e-9:
            break
        edges = sorted([*edges, cut])
    return [next(worth(a, b)[1] for a, b in zip(edges, edges[1:], strict=False) if a <= k < b) for k in range(n)]


def test_quality_is_a_plain_additive_model(monkeypatch):
    """Cyclic boosting and scoring against loops over rows."""
    rng = np.random.default_rng(5)
    x = np.zeros((90, len(quality.FEATURES)))
    x[:, :3] = rng.integers(0, 6, (90, 3))
    y = (x[:, 0] + (x[:, 1] > 2) * 2 + rng.normal(size=90) > 4).astype(float)
    monkeypatch.setattr(quality, "CYCLES", 2)
    monkeypatch.setattr(quality, "PAIRS", 0)
    model = quality.boost(x, y)
    share = (y.sum() + 1) / 92
    bins = [[sum(v >= c for c in model.cuts[j]) for v in x[:, j]] for j in range(x.shape[1])]
    tables = [[0.0] * (len(c) + 1) for c in model.cuts]
    z = [np.log(share / (1 - share))] * 90
    for _ in range(2):
        for j, table in enumerate(tables):
            p = [1 / (1 + np.exp(-v)) for v in z]
            step = plain_step(bins[j], [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p], len(table), 3) if len(table) > 1 else [sum(y - p) / (sum(b * (1 - b) for b in p) + 1)]
            for k, v in enumerate(step):
                table[k] += quality.RATE * v
            z = [v + quality.RATE * step[bins[j][i]] for i, v in enumerate(z)]
    for j, table in enumerate(tables):  # a bin without rows may go with either neighbour
        assert np.allclose(model.tables[j][bins[j]], np.array(table)[bins[j]])
    assert np.allclose(model.score(x), [1 / (1 + np.exp(-v)) for v in z])
    pair = np.arange(64.0).reshape(8, 8) / 100
    model.pairs = [(1, 0, pair)]
    coarse = lambda i, j: bins[j][i] * 8 // len(tables[j])
    assert np.allclose(model.score(x), [1 / (1 + np.exp(-(v + pair[coarse(i, 1), coarse(i, 0)]))) for i, v in enumerate(z)])


# Vectors


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=12) / 4], "x") for i in range(600)]
    same = rows[3][1]
    rows += [(600 + i, same, "x") for i in range(150)]  # many copies of one vector
    rows += [(800, None, "x"), (801, [], "x"), (802, [0.0] * 12, "x"), (803, [float("nan")] * 12, "x"), (804, [None] * 12, "x"), (805, [float("inf")] + [0.0] * 11, "x"), (None, same, "x"), (700, same, "x")]
    rows += [(900, same[:5], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), [r for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1])]


def brute(rows, every, k, change, zero):
    rows = [(i, np.pad(change(np.asarray(v, float)), (0, 12 - len(v)))) for i, v, _ in rows if zero or any(v)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        s = (x * x[list(ids).index(q)]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_ball_tree_is_exact(spark, embeddings, shard_rows):
    df, rows = embeddings
    got = collections.defaultdict(list)
    for r in ball_tree.exact_top_k(df, 50, 10, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == brute(rows, 50, 10, lambda v: np.floor(1024 * v), True)
    assert ball_tree.exact_top_k(df.limit(0)).count() == 0
    few = ball_tree.exact_top_k(df.where("vec_id < 3"), 1, 10).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {2}


def test_ball_bounds_spare_shards(spark):
    """Clustered vectors: after the first ball most others cannot hold one of a query's best, and copies are dealt over shards."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 8))
    rows = [(i, [float(v) for v in centres[i % 20] + rng.normal(size=8) / 50]) for i in range(2000)] + [(5000 + i, [0.5] * 8) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = ball_tree.valid(df).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * 1024).cast("double")))
    balls = ball_tree.upper_levels(ball_tree.sampled(vectors, len(rows), 8, ball_tree.SAMPLE), 26)
    shards = ball_tree.dealt(vectors, balls, 8, 100).groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) < 200 and len(shards) >= 20
    x = np.floor(1024 * np.array([r[1] for r in rows]))
    ball = balls.of(x)
    for b in range(len(balls.centre)):  # every row is within its ball
        assert (np.sqrt(((x[ball == b] - balls.centre[b]) ** 2).sum(axis=1)) <= balls.radius[b] + 1e-6).all()
    best = {int(q): int(sorted(x @ x[i])[-11]) for i, (q, _) in enumerate(rows) if q % 100 == 0}
    asking = vectors.where("vec_id % 100 = 0").withColumn("kth", F.element_at(F.create_map(*[F.lit(v) for kv in best.items() for v in kv]), F.col("vec_id")).cast("long"))
    seen = ball_tree.visits(asking, balls, 8, 1, 26).select(F.avg(F.size("shards"))).first()[0]
    assert seen < len(shards) / 2


def test_wide_scores_are_exact(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 1000003) * 1e9 for j in range(4)]) for i in range(60)]
    got = ball_tree.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5, scale=1).collect()
    whole = {i: [int(v) for v in e] for i, e in rows}
    for q in (0, 20, 40):
        want = sorted(((i, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)) % (1 << 64)) for i in whole if i != q), key=lambda x: x[0])
        assert {r.vec_id: r.score % (1 << 64) for r in got if r.query_id == q}.items() <= dict(want).items()


def test_ties_go_to_the_smaller_vec_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(120)] + [(500, [0.0, 1.0])], "vec_id long, embedding array<float>")
    for found in (ball_tree.exact_top_k(df, 100, 10, shard_rows=30), multi_index.approximate_top_k(df, 100, 10, shard_rows=30)):
        assert [r.vec_id for r in found.where("query_id = 100").orderBy("rank").collect()] == list(range(10))


@pytest.mark.parametrize("shard_rows", [200, 10_000])
def test_multi_index_recall(spark, embeddings, shard_rows):
    df, rows = embeddings
    got = collections.defaultdict(list)
    for r in multi_index.approximate_top_k(df, 20, 20, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, 20, 20, lambda v: v, False)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    for v in got.values():
        assert v == sorted(v, key=lambda x: (-x[1], x[0]))
    found = sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want)
    assert found / (20 * len(want)) >= 0.9
    assert multi_index.approximate_top_k(df.limit(0)).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 256, (500, multi_index.PARTS)).astype(np.uint8)
    codes[1:40] = codes[0]
    codes[1:40, :3] ^= rng.integers(0, 256, (39, 3)).astype(np.uint8)
    by = np.argsort(codes, axis=0, kind="stable").T
    starts = np.stack([np.searchsorted(codes[by[p], p], np.arange(257)) for p in range(multi_index.PARTS)])
    index = multi_index.Index(np.arange(500), np.zeros((500, 1)), codes, by, starts)
    for radius in (0, 5, 31, 32, 60, 110, 256):
        want = np.flatnonzero(multi_index.distances(codes, codes[0]) <= radius)
        assert (multi_index.probed(index, codes[0], radius) == want).all()


# Substring dedup


def removed_units(units, window=50):
    least = {}
    for d, u in units:
        for p in range(len(u) - window + 1):
            w = tuple(u[p : p + window])
            least[w] = min(d, least.get(w, d))
    out = {}
    for d, u in units:
        covered = [False] * len(u)
        for p in range(len(u) - window + 1):
            if least[tuple(u[p : p + window])] < d:
                covered[p : p + window] = [True] * window
        out[d] = covered
    return out


def test_suffix_array(documents, texts):
    units = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    want = removed_units(units)
    got = {r.doc_id: r for r in suffix_array.digests(documents).collect()}
    assert len(got) == len(texts)
    for i, u in units:
        c = want[i]
        kept = bytes(x for x, gone in zip(u, c, strict=True) if not gone)
        spans = sum(1 for k, x in enumerate(c) if x and (k == 0 or not c[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(u), sum(c), spans, hashlib.sha256(kept).hexdigest())


def test_bytes_are_named_and_ranked_by_few_passes(monkeypatch):
    """Cells take no name of a whole window, grams of bytes are mixed eight at a time, and no cell is ranked by a call of its own."""
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(40_000))
    mixed, ranges = [], []
    with monkeypatch.context() as m:
        m.setattr(symbols, "mix", lambda x, real=symbols.mix: mixed.append(x.size) or real(x))
        found = repeats.cells(repeats.Bytes(data), 50, 20)
    assert sum(mixed) <= len(data)
    assert found[2].sum() == len(data) - 49 and (found[1] == np.append(0, np.cumsum(found[2])[:-1])).all()
    contents = [data[i : i + 60] for i in range(0, 30_000, 60)] * 2
    count, doc = np.full(1000, 11), np.arange(1000)
    with monkeypatch.context() as m:
        m.setattr(np, "arange", lambda *a, real=np.arange, **k: ranges.append(a) or real(*a, **k))
        hit = suffix_array.rank_pairs(50)(contents, count, doc)
    assert len(ranges) < 20 and hit.tolist() == [False] * 5500 + [True] * 5500


def test_names_hold_two_arrays_at_a_time():
    x = np.arange(1 << 18, dtype=np.uint64)
    for run in (lambda: symbols.mix(x), lambda: symbols.paired(x, x)):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < 2.1 * x.nbytes
        tracemalloc.stop()
    assert (x == np.arange(1 << 18)).all()


def test_equal_bytes_have_equal_names_in_blocks_too():
    rng = random.Random(6)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) * 12  # longer than a block of names and a stretch of cells
    for size in (1, 7, 8, 9, 16, 20, 25):
        names = symbols.byte_windows(data, size)
        assert len(names) == len(data) - size + 1
        assert len(set(names.tolist())) == len({data[i : i + size] for i in range(len(names))}) == len(set(zip(names.tolist(), (data[i : i + size] for i in range(len(names))), strict=True)))
        codes = symbols.BYTE_CODES[np.frombuffer(data, np.uint8)]
        assert (symbols.windows(codes, size) == symbols.extended(codes, 1, size)).all()
    assert [len(symbols.byte_windows(b"abc", size)) for size in (3, 4, 20)] == [1, 0, 0]


def test_rows_of_one_id_keep_their_own_marks(spark):
    rng = random.Random(8)
    one, other = (sentence(rng, 60) for _ in range(2))
    rows = [(2, one + " x"), (2, "y " + other), (2, "short"), (2, one + " x"), (1, "a " + one), (3, one + " " + other), (0, "z" * 120), (2, "z" * 49)]
    units = [t.encode() for _, t in rows]
    want = []
    for (doc, _), u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for p in range(len(u) - 49):
            if any(d < doc and u[p : p + 50] in v for (d, _), v in zip(rows, units, strict=True)):
                gone[p : p + 50] = [True] * 50
        want.append((doc, len(u), sum(gone)))
    got = suffix_array.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == sorted(want)


def test_suffix_tree(documents, texts, monkeypatch):
    units = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in enumerate(texts)]
    want = removed_units(units)
    got = {r.doc_id: r for r in suffix_tree.digests(documents).collect()}
    for i, u in units:
        kept = b" ".join(x for x, gone in zip(u, want[i], strict=True) if not gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(u), sum(want[i]), hashlib.sha256(kept).hexdigest())


def test_small_trees_split_by_longer_prefixes(monkeypatch):
    rng = random.Random(9)
    shared = [f"w{rng.randrange(9)}" for _ in range(60)]
    contents = [" ".join(shared[:52]).encode()] * 6 + [" ".join([*shared[:40], *[f"z{i}{j}" for j in range(12)]]).encode() for i in range(6)]
    count, doc = np.full(12, 3), np.arange(12)
    whole = suffix_tree.rank_trees(50)(contents, count, doc)
    monkeypatch.setattr(suffix_tree, "TREE_LEAVES", 4)
    assert (suffix_tree.rank_trees(50)(contents, count, doc) == whole).all()
    assert whole.reshape(12, 3).tolist() == [[False] * 3] + [[True] * 3] * 5 + [[False] * 3] * 6


def test_removed_keeps_columns_and_characters(spark):
    passage = "éàü" * 30
    rows = [(1, f"a{passage}b", "en", 92), (2, f"ß{passage}ö", "de", 92), (None, passage, "fr", 90), (3, None, "es", None), (4, "short", "en", 5), (4, "short", "en", 5)]
    got = suffix_array.removed(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"))
    assert got.columns == ["doc_id", "text", "lang", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, f"a{passage}b", "en", 92), (2, "ßö", "de", 2), (None, passage, "fr", 90), (3, "", "es", 0), (4, "short", "en", 5), (4, "short", "en", 5)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    assert suffix_array.removed(empty).count() == 0 and suffix_tree.digests(empty).count() == 0


# Near-duplicates


def shingled(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return collections.Counter([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(texts, threshold=0.8):
    sets = [shingled(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, texts):
    rng = random.Random(11)
    hot = sentence(rng, 120).split()
    group = []
    for _ in range(60):  # a group in which most pairs are near the threshold
        w = list(hot)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        group.append(" ".join(w))
    every = [*texts, *group]
    docs = frame(spark, every).repartition(3).union(frame(spark, ["null id", "null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = minhash.near_duplicates(docs).toPandas()
    assert got.doc_id.isna().sum() == 2 and got.class_id[got.doc_id.isna()].isna().all()
    got = got.dropna().astype(int).sort_values("doc_id")
    assert got.class_id.tolist() == classes(every)
    kept = minhash.representatives(docs).toPandas()
    assert sorted(kept.doc_id.dropna().astype(int)) == sorted(set(classes(every))) and len(kept.columns) == 8
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = random.Random(12)
    words = sentence(rng, 200).split()
    texts = [" ".join(words * a + words[:b]) for a, b in ((1, 0), (1, 60), (2, 0), (3, 100))]
    times = minhash.sketch([minhash.shingles(t) for t in texts], 2000)
    for i in range(4):
        for j in range(i):
            assert abs((times[i] == times[j]).mean() - jaccard(shingled(texts[i]), shingled(texts[j]))) < 0.05
    tiny = minhash.sketch([minhash.shingles("one")])
    assert np.isfinite(tiny).all()


def test_components_of_a_long_path(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components_module, "settled", lambda df, label, *n, real=components_module.settled: rounds.append(label) or real(df, label, *n))
    path = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    got = components(path, finish=0).agg(F.max("label"), F.count("*")).first()
    assert tuple(got) == (0, 1001) and rounds.count("steps") <= 20
    assert tuple(components(path, finish=100).agg(F.max("label"), F.count("*")).first()) == (0, 1001)
    assert components(spark.range(0).selectExpr("id AS a", "id AS b")).count() == 0


def thue_morse(flip):
    letters = "ab" if not flip else "ba"
    return "".join(letters[i.bit_count() & 1] for i in range(1024))


def test_words_that_cancel_out_in_polynomial_hashes(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**9)}" for _ in range(60)]
    texts = [" ".join([*words[:30], thue_morse(flip), *words[31:]]) for flip in (False, True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in suffix_tree.digests(docs).orderBy("doc_id").collect()] == [0, 0]
    assert len(set(word_codes(" ".join(thue_morse(f)[:n] for f in (0, 1) for n in (8, 16, 32, 64, 128, 1024)).encode())[0])) == 12
    units = [(i, t.encode()) for i, t in enumerate(texts)]
    got = [r.n_removed for r in suffix_array.digests(docs).orderBy("doc_id").collect()]
    assert got == [sum(removed_units(units)[i]) for i in (0, 1)]


def test_equal_names_are_no_proof(monkeypatch):
    """With names that say nothing, results come from the bytes."""
    rng = random.Random(4)
    contents = ["".join(rng.choice("ab ") for _ in range(60)).encode() for _ in range(30)] * 2
    count, doc = np.full(60, 11), np.arange(60)
    want = suffix_array.rank_pairs(50)(contents, count, doc)
    monkeypatch.setattr(suffix_array, "windows", lambda codes, size: np.zeros(len(codes) - size + 1, np.uint64))
    assert want.sum() >= 30 * 11 and (suffix_array.rank_pairs(50)(contents, count, doc) == want).all()
    contents = [" ".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(30)] * 2
    want = suffix_tree.rank_trees(50)(contents, count, doc)
    monkeypatch.setattr(suffix_tree, "windows", lambda codes, size: np.zeros(len(codes) - size + 1, np.uint64))
    assert want.sum() >= 30 * 11 and (suffix_tree.rank_trees(50)(contents, count, doc) == want).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (100, 102)] + [(500, i) for i in range(501, 540)]
    for finish in (0, 10, 1000):
        got = {r.id: r.label for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), finish).collect()}
        assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(500, 540)} == {500}
        assert got[7] == 0 and len(got) == 41 + 3 + 40


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}\r\nX", "<p>é</p>" * (i % 7) + ("same" if i % 3 == 0 else str(i)), "x") for i in range(60)]
    rows += [(100, None, None, "x"), (101, "u", "", "x"), (102, "u", "y" * 300_000, "x"), (103, "u", "y" * 300_000, "x"), (None, "u", "no id", "x"), (5, "again", "<p>é</p>" * 5 + "5", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string"), rows


def test_warc_round_trip(spark, pages, tmp_path):
    df, rows = pages
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        revisit = i is not None and first[h or ""] != i
        digest = __import__("base64").b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_payloads_filters_and_files(spark, pages, tmp_path):
    df, rows = pages
    path = f"file://{tmp_path}/archive"
    warc.register(spark)
    warc.as_records(df, min_bytes=10).coalesce(2).write.format("warc").option("roll_bytes", "2000").mode("append").save(path)
    assert len(list((tmp_path / "archive").glob("*.warc.gz"))) > 2 and not (tmp_path / "archive" / "_pending").exists()
    back = warc.read(spark, path, split_bytes="3000")
    assert back.count() == len(rows)
    chosen = back.where("record_type = 'response' and record_id = '<urn:page:102>'")
    assert "EqualTo" not in chosen._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[0]
    assert bytes(chosen.first().payload) == b"y" * 300_000
    assert back.where(F.col("record_type").isin("revisit")).count() == back.where("refers_to is not null").count() > 0
    small = {r.record_type for r in back.where("payload_length < 10").collect()}
    assert small == {"response"}


def test_warc_reads_members_without_skip_lengths(spark, tmp_path):
    import gzip

    records = [warc.record_bytes({"record_id": f"<r{i}>", "record_type": "response", "payload_length": n}, b"z" * n) for i, n in enumerate((0, 10, 9000))]
    (tmp_path / "plain.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.read(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [len(r.payload) for r in got] == [0, 10, 9000]
    assert warc.read(spark, str(tmp_path), "record_id string").count() == 3


def test_warc_reads_plain_files(spark, tmp_path):
    sizes = (0, 10, 9000, 5)
    records = [warc.record_bytes({"record_id": f"<r{i}>", "record_type": "response" if i % 2 else "request", "payload_length": n, "target_uri": "u" * 6000}, b"z" * n) for i, n in enumerate(sizes)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [len(r.payload) for r in got] == list(sizes) and {len(r.target_uri) for r in got} == {6000}
    assert [r.record_id for r in warc.read(spark, str(tmp_path), "record_id string, record_type string").where("record_type = 'response'").orderBy("record_id").collect()] == ["<r1>", "<r3>"]


def test_warc_splits_inside_files(spark, pages, tmp_path):
    df, rows = pages
    path = f"file://{tmp_path}/archive"
    warc.register(spark)
    warc.as_records(df).coalesce(1).write.format("warc").option("cut_bytes", "500").mode("append").save(path)
    assert len(list((tmp_path / "archive").glob("*.warc.gz"))) == 1
    whole, parts = warc.read(spark, path), warc.read(spark, path, split_bytes="1000")
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() > 4
    key = lambda r: str(tuple(r))
    assert sorted(map(key, parts.collect())) == sorted(map(key, whole.collect())) and parts.count() == len(rows)


def test_warc_round_trip_reads_payloads(spark, monkeypatch):
    made = warc.as_records
    wrong = {"payload_length": F.lit(7).cast("long"), "payload_digest": F.lit("sha1:WRONG")}
    monkeypatch.setattr(warc, "as_records", lambda *a: made(*a).withColumns(wrong))
    html = "<p>é</p>" * 900
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(1, "u", html), (2, "v", ""), (3, "w", html)], "page_id long, url string, html string")).collect()}
    for i, data in ((1, html.encode()), (2, b"")):
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert got[3].record_type == "revisit" and got[3].payload_digest == "WRONG"


def test_one_row_of_a_repeated_doc_id_stays(spark):
    rng = random.Random(8)
    a, b = sentence(rng, 80), sentence(rng, 80)
    a, b = min(a, b), max(a, b)
    rows = [(1, a, "s"), (1, a, "s"), (2, b, "s"), (2, a, "t"), (3, b, "s"), (4, None, "s"), (4, None, "s"), (5, None, "s"), (5, b, "s"), (None, a, "s"), (None, a, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    classes = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert classes == sorted([(1, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 3), (5, 3), (None, None), (None, None)], key=str)
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, a, "s"), (3, b, "s"), (4, None, "s"), (None, a, "s"), (None, a, "s")], key=str)
