"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's posterior and its path's posterior.

A logistic model over counts of the whole text gives the document's evidence. Labelled outcomes (weight 1) and the evidence of
the other documents (weight SOFT) are summed by host and path. A host's rate is shrunk towards the global rate and a path's
towards its host's, with strengths estimated from the spread between hosts and between paths, so sparse sites stay close to
their parents. The score adds the path's log odds against the global ones to the document's; a document's own share is left out
of its path's sums, so neither its label nor its evidence counts twice.

Labels are learned from about LEARN_ROWS labelled rows of each kind (all, if fewer); all other sums cover all rows.

Null and empty texts have counts of zero; null hosts and paths form groups of their own. Without labels of both kinds the
evidence is the neutral 0.5. Every document gives one row. Labels of the held-out fold and of null ids are never used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import bounded_sample, held_out, looked_up, staged, table

LEARN_ROWS = 10_000
SOFT = 0.1
KEEP_AT = 0.5
FEATURES = ("size", "letters", "digits", "symbols", "marks", "spaces", "word", "fresh", "lines", "line", "wide")

_CLASS = np.zeros(256, np.int64)  # 0: anything else; the classes of single bytes
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _c >= 128 or _ch.isalpha() else 2 if _ch.isdigit() else 3 if _ch in "#$%&*@^~|<>{}[]=+\\_/" else 4 if _ch in ".,;:!?'\"()-" else 5 if _ch.isspace() else 0


def counts(text: str | None) -> list[float]:
    """The FEATURES of a text, each about 0 to 3."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by = np.bincount(_CLASS[data], minlength=6) / max(1, len(data))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(data)) / 5, by[1], by[2] * 10, by[3] * 10, by[4] * 10, by[5] * 3,
        len(text) / (1 + len(words)) / 10, len(set(words)) / (1 + len(words)), len(set(lines)) / (1 + len(lines)), np.log1p(len(text) / (1 + len(lines))) / 5, max(map(len, words), default=0) / 50,
    ]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton's method for a logistic model; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) + 1e-9
        w -= np.linalg.solve(hess, grad)
    return w


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: float) -> float:
    """Prior weight by moments: what the spread of the rates leaves beyond the noise of counting."""
    rate = F.col("good") / F.col("n")
    row = sites.where("n > 0").agg(F.sum(F.col("n") * (rate - mean) ** 2).alias("s"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") ** 2).alias("q")).first()
    if not row["n"] or row["g"] < 2:
        return 50.0
    noise = mean * (1 - mean)
    spread = (row["s"] - (row["g"] - 1) * noise) / max(row["n"] - row["q"] / row["n"], 1e-9)
    return float(min(5000.0, max(2.0, noise / spread - 1))) if spread > 0 else 5000.0


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, keep of every row of docs. labels: doc_id and 0 or 1; each id once."""

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(counts)

    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), features(F.col(text)).alias("x")).join(marks, "doc_id", "left"), "quality-counts")
    sample = bounded_sample(rows.where("y is not null"), "y", "doc_id", LEARN_ROWS).select("x", "y").toPandas()
    evidence = F.lit(0.5)
    if sample["y"].nunique() == 2:
        weights = fitted(np.stack(sample["x"].to_list()), sample["y"].to_numpy(float)).tolist()
        z = sum((F.col("x")[i] * w for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
        evidence = 1 / (1 + F.exp(-z))
    rows = rows.select("doc_id", "host", "path", "y", evidence.alias("evidence"))
    weight = F.when(F.col("y").isNull(), SOFT).otherwise(1.0)
    paths = rows.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * F.coalesce(F.col("y").cast("double"), F.col("evidence"))).alias("good"))
    paths = staged(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = min(1 - 1e-6, max(1e-6, (total["good"] or 0.0) / total["n"])) if total["n"] else 0.5
    s_host, s_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select("host", ((F.col("good") + s_host * mean) / (F.col("n") + s_host)).alias("host_rate"))
    # A host with very many paths is hot here: salted too.
    rates = looked_up(paths, hosts, ["host"], F.col("path")).select("host", "path", "host_rate", "good", "n")
    own = weight * F.coalesce(F.col("y").cast("double"), F.col("evidence"))
    others = (F.greatest(F.col("good") - own, F.lit(0.0)) + s_path * F.col("host_rate")) / (F.greatest(F.col("n") - weight, F.lit(0.0)) + s_path)
    score_col = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + _logit(F.col("path_rate")) - _logit(F.lit(mean)))))
    out = looked_up(rows, rates, ["host", "path"], F.col("doc_id")).withColumn("path_rate", others).withColumn("score", score_col)
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= KEEP_AT).alias("keep"))


def site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL; null where there is none."""
    path = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/([^/]+)", 1)
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.nullif(path, F.lit(""))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents name a source and a language: these stand for a host and a path on it."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang")).withColumn("held_out", held_out("doc_id"))
