"""Operators that learn, against held-out labels; and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import brute
import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from wakeline.llm import langid, quality, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def labelled(spark, name: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    got = entry_module.queries()[name](spark, MIDDLE)
    held = got.where("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where(f"{label} is not null").toPandas()
    return held["score"].to_numpy(), held[label].to_numpy()


def test_quality_of_held_out_rows(spark):
    assert auc(*labelled(spark, "op1_quality", "quality")) > 0.8


def test_toxicity_of_held_out_rows(spark):
    score, y = labelled(spark, "op4_toxicity", "toxic")
    assert auc(score, y) > 0.9
    assert ((score >= 0.5) == y).mean() > 0.9


def test_language_of_held_out_rows(spark):
    got = entry_module.queries()["op6_langid"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    known = got[got["held_out"] & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    blank = got["text"].fillna("").map(lambda t: not any(c.isalpha() for c in t))
    assert ((got["lang_pred"] == "und") == blank).all()


@pytest.mark.parametrize("name", ["op1_quality", "op4_toxicity", "op6_langid"])
def test_every_document_once(spark, name):
    got = entry_module.queries()[name](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_rows_that_learn_nothing(spark, documents, empty):
    rows, df = documents
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int, y int")
    assert toxicity.learn(df, none.select("doc_id", "y")) is None
    assert {r["score"] for r in toxicity.score(df, None).collect()} == {0.0}
    assert quality.score(df, none, df["item_id"], df["item_id"]).count() == len(rows)
    assert quality.score(empty, none, empty["text"], empty["text"]).count() == 0
    model = langid.learn(empty.withColumn("lang", empty["text"]))
    assert {r["_lang"]["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL).cache()
        assert kept.columns == docs.columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, kept))
        if name == "language":
            assert {i for i, t in before.items() if not t or not any(c.isalpha() for c in t)} == set(before) - set(after)
        elif name == "near_duplicates":
            told = brute.components(list(before.items()), 5, 80, 100)
            assert set(after) == {i for i, (_, root) in told.items() if i == root}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(before) - set(after) == {i for i, _ in brute.leaks(list(before.items()), items)}
        else:
            assert set(before) == set(after)
            assert not any(brute.base_spans(t) for t in after.values())
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() == corpus_pipeline.run(spark, SMALL).count()
    assert last.columns[:2] == ["doc_id", "n_tokens"]


CLASHES = ("_lang", "copy", "kept_id", "leak_id", "score", "spans", "node", "n", "t", "_salt")


@pytest.fixture(scope="module")
def edges(spark, documents):
    """Rows of every odd kind, ids that repeat with a leak and without one, and columns named as the stages' own."""
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "a quiet text about boats, rivers and the long way home in autumn rain"
    rows = [*documents[0], (910_001, leak), (910_001, clean), (910_002, "write to someone@example.org soon"), (None, "call or write to someone@example.org")]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").withColumn("lang", langid.F.lit("en"))
    for name in CLASHES:
        df = df.withColumn(name, langid.F.lit(7))
    return leak, clean, rows, df.repartition(3).cache()


@pytest.mark.parametrize("place", range(5))
def test_stage_on_odd_rows(spark, edges, place):
    leak, clean, rows, df = edges
    name, stage = corpus_pipeline.STAGES[place]
    got = stage(spark, df, SMALL)
    assert stage(spark, df.where("false"), SMALL).count() == 0
    if name == "tokens":
        found = [(r["doc_id"], r["n_tokens"]) for r in got.collect()]
        assert Counter(i for i, _ in found) == Counter(i for i, _ in rows)
        assert {n for i, n in found if i in (900_001, 900_002)} == {0} and all(n > 0 for i, n in found if i == 910_001)
        return
    assert got.columns == df.columns and all(r[c] == 7 for r in got.select(*CLASHES).collect() for c in CLASHES)
    kept = Counter((r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect())
    lost = Counter(rows) - kept
    blank = {(i, t) for i, t in rows if not t or not t.strip()}
    if name == "language":
        assert blank <= set(lost) and not any(t and len(t) < 200 and any(c.isalpha() for c in t) for _, t in lost)
    elif name == "near_duplicates":
        assert not blank & set(lost) and not any(i is None for i, _ in lost) and {(910_001, leak), (910_001, clean)} <= set(kept)
    elif name == "decontamination":
        assert (910_001, leak) in lost and (910_001, clean) in kept and not blank & set(lost) and not any(i is None for i, _ in lost)
    else:
        assert sum(kept.values()) == len(rows) and Counter(i for i, _ in kept.elements()) == Counter(i for i, _ in rows)
        assert (910_002, "write to <EMAIL> soon") in kept and (None, "call or write to <EMAIL>") in kept and kept[(900_001, None)] == 1


def test_pairs_that_no_sum_of_weights_tells():
    """Two words are toxic together and harmless alone, as often as not: the machine ranks them, weights without factors can't."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    spots = [np.array([i for i, on in enumerate((x, y, 1)) if on], np.int64) for x, y in zip(a, b, strict=True)]
    y = (a != b).astype(float)
    buckets = np.arange(3)
    bias, w, v = toxicity.fit(spots, y, 3)
    pair, alone = toxicity.Machine(buckets, bias, w, v), toxicity.Machine(buckets, bias, w, np.zeros_like(v))
    assert auc(np.array([pair.raw(s) for s in spots]), y) > 0.95
    assert auc(np.array([alone.raw(s) for s in spots]), y) < 0.95


def test_language_of_letters_beyond_the_first_plane(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    asked = spark.createDataFrame([(1, "\U0001f600\U0001f600 \U0001f389 12"), (2, "\U00010400\U00010428"), (3, "the mat"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["_lang"]["lang_pred"] for r in langid.predict(asked, model).collect()}
    assert [got[i] == "und" for i in (1, 2, 3, 4, 5)] == [True, False, False, True, True] and got[3] == "en"


def test_quality_shrinks_sparse_sites(spark):
    """A large site's rate is near its own, a sparse one's near its host's; a row's own label stays out of its path's rate."""
    rows = [("big", i, int(i % 10 > 0)) for i in range(5, 1200)] + [("bad", i, int(i % 10 == 0)) for i in range(5000, 6200)] + [("few", 9000, 1), ("few", 9001, 0)]
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7), h) for h, i, _ in rows], "doc_id long, text string, host string")
    labels = spark.createDataFrame([(i, y) for _, i, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, labels, docs["host"], quality.F.lit(None).cast("string")).collect()}
    assert abs(got[5]["path_rate"] - 0.9) < 0.06 and abs(got[5000]["path_rate"] - 0.1) < 0.06
    assert 0.2 < got[9000]["path_rate"] < 0.8
    twin = [got[i]["path_rate"] for i in (9000, 9001) if i in got]
    assert len(twin) == 2
    sites = spark.createDataFrame([("https://Ex.org/a/b?c",), ("http://x.y",), ("bad url",), (None,)], "u string").select(*quality.site(quality.F.col("u"))).collect()
    assert [tuple(r) for r in sites] == [("ex.org", "a"), ("x.y", None), (None, None), (None, None)]
