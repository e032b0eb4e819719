"""Centroid clustering, source divergence and language-model scoring against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import centroids, divergence, lm
from wakeline.llm.trie import CODES, Monotone, Trie, code

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lloyd(rows, k, rounds, scale, seed, width):
    """vec_id, cluster, distance by plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    z = [list(x) for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(z))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        for n, xs in own.items():
            z[n] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    return [(i, *near(x)[::-1]) for i, x in kept], z


VECTORS = "vec_id long, embedding array<double>, cluster int, x string"


@pytest.mark.parametrize("leaf", [1, 16])
def test_centroids(spark, monkeypatch, leaf):
    monkeypatch.setattr(centroids, "LEAF", leaf)
    monkeypatch.setattr(centroids, "BLOCK", 37)
    rng = np.random.default_rng(leaf)
    rows = [(i, rng.normal(rng.integers(0, 4) * 3 - 4, 1, 3).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 380)]  # a third of equal vectors
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, [0.5, -0.25, 1.0]), (900, None), (901, [1.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [1.0, float("inf"), 2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(3)
    got = centroids.cluster(df, k=5, rounds=6, width=3).collect()
    told, z = lloyd(rows, 5, 6, 1024, 3, 3)
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=repr) == sorted(told, key=repr)
    by = Counter()
    for _, c, d in told:
        by[c] += d
    for r in got:
        assert (r["cluster_inertia"], r["inertia"], r["centroid"]) == (by[r["cluster"]], sum(by.values()), z[r["cluster"]])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, z[r["cluster"]])).encode()).hexdigest()


def test_centroids_edges(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], VECTORS)
    assert [(r["cluster"], r["distance"]) for r in centroids.cluster(few, k=8, width=2).collect()] == [(0, 0), (0, 0)]
    assert centroids.cluster(few.limit(0), width=2).collect() == []
    large = [(i, [float((-1) ** i * 120_000 - i), float(i)]) for i in range(40)]  # beyond what doubles add up exactly
    got = centroids.cluster(spark.createDataFrame([(i, v, 1, "") for i, v in large], VECTORS), k=3, rounds=3, width=2).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(lloyd(large, 3, 3, 1024, 3, 2)[0])
    with pytest.raises(Exception, match="components must be under"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0], 1, "")], VECTORS), width=2).collect()


def test_balls_go_as_a_whole():
    x = np.concatenate([np.zeros((500, 4), np.int64), np.full((500, 4), 1000)])
    tree, _ = centroids.Tree.built(x)
    owner, _ = tree.owners(np.array([[0, 0, 0, 1], [1000, 1000, 1000, 999]]))
    assert sorted(owner[owner >= 0].tolist()) == [0, 1] and tree.count[owner >= 0].sum() == 1000


def audit(rows, least, ranks):
    """Every pair and term by the formula, without any grouping."""
    told, holds, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        told[lang, source].update(w)
        holds[lang].update(set(w))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in holds.items()}
    out = set()

    def shares(lang, counts):
        terms = kept.get(lang, [])
        whole = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 5) // (whole + 5 * len(terms)) for t in terms}

    for lang, source in groups:
        p, q = shares(lang, told[lang, source]), shares(lang, sum((told[g] for g in groups if g[0] == lang), Counter()))
        pairs = [(sum(abs(p[t] - o[t]) for t in p), b) for a, b in groups if a == lang and b != source for o in [shares(lang, told[a, b])]]
        terms = [(p[t] - q[t], t) for t in p if told[lang, source][t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, n + 1) for n, (value, item) in enumerate(found[:most])}
    return out


def test_divergence(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in ("Wort", "mot", "éa", "日本", "x") for b in "abcdefgh"]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "de"]), f"s{min(5, rng.geometric(0.4))}"
        rows.append((" ".join(rng.choice(vocabulary, rng.integers(0, 12))) + "; 12 Word_word", lang, source))
    rows += [(None, None, None), ("", "en", None), ("only here", "fr", "s1"), ("only there", "fr", "s2"), (None, "en", "bare"), ("1 2 3", "zz", "a"), ("worta " * 3000, "en", "s1")] + [("same same", "en", "s9")] * 40
    df = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in rows], "text string, lang string, source string, n int, term string").repartition(5)
    got = {tuple(r) for r in divergence.divergence(df, 10, 5).collect()}
    assert got == audit(rows, 10, 5)
    assert divergence.divergence(df.limit(0)).collect() == []
    assert {r["value"] for r in divergence.divergence(df, 10_000).where("part = 'pair'").collect()} == {0}


def sentences(rows, learn, priors):
    docs = [(i, learn(i), [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), 0]) for i, t in rows]
    c1, c2, c12, c23, c3 = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, own, w in docs:
        p = [1, 1, *w]
        for a, b, c in zip(p, p[1:], p[2:], strict=False) if own else ():
            c1[c], c2[b], c12[a, b], c23[b, c], c3[a, b, c] = c1[c] + 1, c2[b] + 1, c12[a, b] + 1, c23[b, c] + 1, c3[a, b, c] + 1
    total, known = sum(c1.values()), len(c1)
    q = lambda p: int(code(np.array([p]))[0])
    (x, y), out = priors, []
    for i, own, w in docs:
        p, score = [1, 1, *w], 0
        for a, b, c in zip(p, p[1:], p[2:], strict=False):
            one = q((c1[c] + 1) / (total + known + 1))
            two = q((c23[b, c] + x * 10 ** (-one / CODES)) / (c2[b] + x)) if c23[b, c] else (q(x / (c2[b] + x)) if c2[b] else 0) + one
            score += q((c3[a, b, c] + y * 10 ** (-two / CODES)) / (c12[a, b] + y)) if c3[a, b, c] else (q(y / (c12[a, b] + y)) if c12[a, b] else 0) + two
        base = sum(math.log10((c1[c] + 1) / (total + known + 1)) for c in w)
        out.append((i, not own, len(w), sum(c1[c] > 0 for c in w), total, round(base, 6), round(-score / CODES, 6)))
    return sorted(out, key=repr)


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def learn():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2


@pytest.mark.parametrize(("split", "block", "bucket"), [(1 << 22, 1 << 21, 1 << 19), (1 << 22, 3000, 5000), (50, 3000, 5000)])
def test_lm_scores(documents, monkeypatch, split, block, bucket):
    """In one block, in many blocks and buckets, and with middle words that are dealt by the words beside them."""
    rows, df = documents
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    monkeypatch.setattr(lm, "WORD_BYTES", block * 8)
    got = lm.score(df, learn(), priors=(30.0, 2.0), split=split).collect()
    assert sorted([(*tuple(r)[:5], round(r[5], 6), round(r[6], 6)) for r in got], key=repr) == sentences(rows, learned, (30.0, 2.0))


def test_lm_edges(spark, empty):
    assert lm.score(empty, learn()).collect() == []
    one = spark.createDataFrame([(2, "a b"), (2, None)], "doc_id long, text string")
    nothing = lm.score(one, F.lit(False)).collect()
    assert [(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in nothing] == [(True, 0, 0, 0.0, 0.0)] * 2


def test_lm_tells_known_text_and_keeps_its_levels(spark, tmp_path):
    texts = ["the cat sat on the mat", "the dog sat on the rug", "a cat and a dog"] * 5
    df = spark.createDataFrame([*enumerate(texts), (100, "the cat sat on the rug"), (101, "rug the on sat cat the")], "doc_id long, text string")
    model = lm.Model(df, F.col("doc_id") < 100, priors=(5.0, 1.0))
    got = {r["doc_id"]: r for r in model.scores().collect()}
    assert got[100]["score"] > got[101]["score"] and got[100]["score"] > got[100]["base_score"]
    assert abs(got[100]["base_score"] - got[101]["base_score"]) < 1e-9
    levels = model.levels().collect()
    (tmp_path / "trie").write_bytes(levels[0]["trie"])
    mapped = Trie.load(str(tmp_path / "trie"))
    assert mapped.words.n > 0 and isinstance(mapped.code3, np.ndarray)


def test_monotone_sequences():
    rng = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 5), (60, 70), (1000, 10**12), (5000, 5001)):
        v = np.sort(rng.integers(0, top, n))
        assert (Monotone(*Monotone.coded(v))[np.arange(n)] == v).all()
        v = np.unique(v)
        asked = np.concatenate([v, rng.integers(0, top + 10, 500), v + 1])
        at = {x: i for i, x in enumerate(v.tolist())}
        assert Monotone(*Monotone.coded(v)).find(asked).tolist() == [at.get(x, -1) for x in asked.tolist()]
