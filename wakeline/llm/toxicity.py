"""Toxicity by a factorisation machine over hashed terms.

A term is a lower-cased word or the first 3, 4 or 5 letters of a longer one; a document has each hashed term at most once.
Grouped counts over about COUNT_ROWS learning rows of each label (all, if fewer) choose the FEATURES terms whose presence tells
most about the label. The machine adds a weight for each term and an inner product of factors for each pair of terms, so that
an insult weighs otherwise beside a group's mention than alone. It is fitted on about LEARN_ROWS of those rows of each label.

Null and empty texts score as texts without terms. Rows without id or label are scored but not learned from. If there is
nothing to learn from, every score is the share 0. Every document gives one row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import bounded_sample, held_out, table

BUCKETS = 1 << 18
FEATURES = 512
FACTORS = 8
LEARN_ROWS = 10_000
COUNT_ROWS = 40_000
MIN_ROWS = 5
EPOCHS = 12
_WORD = re.compile(r"[^\W\d_]+")
_KNOWN: dict[str, tuple[int, ...]] = {}
_KNOWN_MOST = 300_000


def terms(text: str | None) -> set[int]:
    """The buckets of a text's terms. Words met before are looked up; the table of them is bounded."""
    out: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        if (got := _KNOWN.get(w)) is None:
            parts = {"=" + w[:40], *("^" + w[:n] for n in (3, 4, 5) if len(w) > n)}
            got = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)
            if len(_KNOWN) >= _KNOWN_MOST:
                _KNOWN.clear()
            _KNOWN[w] = got
        out.update(got)
    return out


class Machine:
    """Weights of the chosen buckets. A row is the set of its chosen buckets."""

    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.spot = {int(b): i for i, b in enumerate(buckets)}
        self.bias, self.w, self.v = bias, w, v

    def row(self, text: str | None) -> np.ndarray:
        return np.fromiter((self.spot[b] for b in terms(text) if b in self.spot), np.int64)

    def raw(self, spots: np.ndarray) -> float:
        v = self.v[spots]
        return float(self.bias + self.w[spots].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()))


def _told(n1: np.ndarray, n0: np.ndarray, total1: float, total0: float) -> np.ndarray:
    """How much a term's presence tells about the label: mutual information, signless."""
    n = total1 + total0
    out = np.zeros(len(n1))
    for a, t in ((n1, total1), (n0, total0)):
        for x, margin in ((a, n1 + n0), (t - a, n - n1 - n0)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(x > 0, x / n * np.log(x * n / (t * np.maximum(margin, 1e-9))), 0.0)
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, n: int, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam over shuffled batches of the logistic loss; rows hold the indices of present terms."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            take = order[at : at + 256]
            size = np.array([len(rows[i]) for i in take])
            flat = np.concatenate([rows[i] for i in take]) if size.sum() else np.empty(0, np.int64)
            owner = np.repeat(np.arange(len(take)), size)
            vf = v[flat]
            total = np.zeros((len(take), FACTORS))
            np.add.at(total, owner, vf)
            squares = np.bincount(owner, (vf * vf).sum(axis=1), len(take))
            z = bias + np.bincount(owner, w[flat], len(take)) + 0.5 * ((total**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
            gw = np.bincount(flat, g[owner], n) + decay * w
            gv = decay * v
            np.add.at(gv, flat, g[owner, None] * (total[owner] - vf))
            bias -= rate * float(g.sum())
            step += 1
            for p, grad, (m1, m2) in ((w, gw, state[0]), (v, gv, state[1])):
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return bias, w, v


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Machine | None:
    """labels: doc_id and y (0 or 1), each id once. The sample has a fixed bound, so its ids are broadcast to the texts."""
    chosen = bounded_sample(labels, "y", "doc_id", COUNT_ROWS)
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                n[y][list(terms(text))] += 1
        some = np.nonzero(n.sum(axis=0))[0]
        yield pd.DataFrame({"bucket": some, "n0": n[0][some], "n1": n[1][some]})

    counts = sample.select("text", "y").mapInPandas(counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_ROWS).toPandas()
    told = _told(counts["n1"].to_numpy(float), counts["n0"].to_numpy(float), totals[1], totals[0])
    buckets = np.sort(counts["bucket"].to_numpy()[np.lexsort((counts["bucket"], -told))[:FEATURES]])
    known = set(buckets.tolist())

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "spots": [np.searchsorted(buckets, sorted(terms(t) & known)).astype("int32") for t in batch["text"]]})

    rows = bounded_sample(sample, "y", "doc_id", LEARN_ROWS).select("text", "y").mapInPandas(reduced, "y int, spots array<int>").toPandas()
    order = np.lexsort((rows["spots"].map(lambda s: zlib.crc32(np.asarray(s).tobytes())), rows["y"]))  # no dependence on how rows came in
    spots = [np.asarray(rows["spots"].iloc[i], np.int64) for i in order]
    return Machine(buckets, *fit(spots, rows["y"].to_numpy(float)[order], len(buckets)))


def score(docs: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """The rows of docs with a column score from 0 to 1, in the place of a column of that name."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if machine is None:
            return pd.Series(0.0, index=texts.index)
        z = np.array([machine.raw(machine.row(t)) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("score", scored(F.col(text)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    machine = learn(docs, labels)
    return score(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
