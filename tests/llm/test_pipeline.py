import collections
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lattica.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def shingled(text):
    words = text.encode().split()
    return collections.Counter([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, stage):
    """Nulls in any column, empty texts, repeated rows, one doc_id with two texts, and columns of the operators' own names."""
    name, run = stage
    passage = " ".join(f"word{i}" for i in range(80))
    texts = [(1, passage), (1, passage), (2, passage + " more"), (2, "second text of two"), (3, None), (4, ""), (None, passage), (None, None), (5, " \n "), (6, passage)]
    extra = ("judged", "score", "predicted", "held_out", "a.b", "text_a", "class_id", "bucket", "rest", "row", "id")
    rows = [(i, t, *[None if k % 3 == 0 else f"{c} {k}" for c in extra]) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    got = run(spark, docs, str(DATA))
    assert run(spark, docs.limit(0), str(DATA)).count() == 0
    if name == "packing":
        assert sorted((r.doc_id or 0, r.piece) for r in got.collect()) == sorted((i or 0, 0) for i, _ in texts)
        return
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    mine = {r[2:] for r in rows}
    assert all(r[2:] in mine for r in out)
    ids = sorted(-1 if r[0] is None else r[0] for r in out)
    if name == "near_dedup":
        assert ids == [-1, -1, 1, 2, 3, 4, 5]
    elif name == "suffix_dedup":
        assert ids == [-1, -1, 1, 1, 2, 2, 3, 4, 5, 6]
        assert {r[0]: r[1] for r in out}[6] == "" and [r[1] for r in out if r[0] == 1] == [passage] * 2
    else:
        assert all(r in rows for r in out)


def test_stages_take_effect(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == columns
        seen[name] = docs.toPandas(), out.toPandas()
        docs = spark.createDataFrame(seen[name][1])
    before, after = seen["near_dedup"]
    sets = {r.doc_id: shingled(r.text) for r in before.itertuples()}
    kept = sorted(after.doc_id)
    for i in set(before.doc_id) - set(kept):  # whatever went has a link to a smaller one
        assert any(jaccard(sets[i], sets[j]) >= 0.8 for j in before.doc_id if j < i)
    for a in range(len(kept)):
        assert all(jaccard(sets[kept[a]], sets[kept[b]]) < 0.8 for b in range(a))
    before, after = seen["suffix_dedup"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    assert (after.text.str.len() == after.n_chars).all()
    shorter = before.set_index("doc_id").n_chars - after.set_index("doc_id").n_chars
    assert (shorter >= 0).all()


def test_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, str(DATA)).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert len(got) and got.doc_id.isin(pd.read_parquet(DATA / "documents.parquet").doc_id).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = c.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, str(DATA)).toPandas()
    clean = lambda df: sorted(tuple(str(None if pd.isna(v) else int(v) if isinstance(v, (int, float, np.integer)) else v) for v in r) for r in df[list(want.columns)].astype(object).itertuples(index=False))
    assert clean(got) == clean(want)
