"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters' vectors, each rotated by the letter's place, into
one product; a text bundles (adds) the vectors of its n-grams; a language's prototype bundles its learning texts, each at unit
length. A text gets the language whose prototype has the largest cosine; ties go to the smaller name.

Null texts and texts without a letter are `und` with score 0; so is every text if nothing can be learned. Rows with null lang
or null id are predicted but not learned from. Every document gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import bounded_sample, held_out, table

DIM = 1024
GRAM = 3
SYMBOLS = 4096
#: No letter lies at or beyond the last of these code points.
POINTS = 0x40000
#: Learning texts of a language: its prototype hardly moves beyond this.
LEARN_ROWS = 4000
SHARPNESS = 12.0
CHUNK = 1 << 20


class Profiles:
    """Letter vectors and text vectors. Equal seeds give equal vectors on every executor."""

    def __init__(self, dim: int = DIM, seed: int = 11) -> None:
        base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        base[0] = np.roll(np.where(np.arange(dim) % 2 == 0, 1, -1).astype(np.int8), 1)  # the space between words
        self.turned = [np.roll(base, place, axis=1) for place in range(GRAM)]
        self.dim = dim
        # 0 stands for whatever is no letter; a letter's symbol is its lower-case code point, folded.
        points = (chr(c).lower() if not 0xD800 <= c < 0xE000 else " " for c in range(POINTS))
        self.symbol = np.fromiter((1 + ord(s[0]) * 2654435761 % (SYMBOLS - 1) if s[0].isalpha() else 0 for s in points), np.int64, POINTS)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the text's n-grams and their counts, without those that only hold spaces."""
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        tail = np.zeros(1, np.int64)
        for at in range(0, len(text), CHUNK):
            points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.concatenate([tail, self.symbol[np.minimum(points, POINTS - 1)]])
            tail = s[-(GRAM - 1) :]
            if at + CHUNK >= len(text):
                s = np.append(s, 0)
            s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]  # one space between words
            code = s[: 1 - GRAM].copy() if len(s) >= GRAM else np.empty(0, np.int64)
            for place in range(1, GRAM):
                code = code * SYMBOLS + s[place : len(s) - GRAM + 1 + place][: len(code)]
            u, n = np.unique(code, return_counts=True)
            codes, inverse = np.unique(np.concatenate([codes, u]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        keep = (codes != 0) & ((codes // SYMBOLS % SYMBOLS) != 0)
        return codes[keep], counts[keep]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        letters = [codes // SYMBOLS ** (GRAM - 1 - place) % SYMBOLS for place in range(GRAM)]
        out = self.turned[0][letters[0]]
        for place in range(1, GRAM):
            out = out * self.turned[place][letters[place]]
        return out

    def bundled(self, texts: list[str], width: int = 2048) -> np.ndarray:
        """A row for each text, at unit length (zeros without letters); n-grams are bound once for all texts given."""
        found = [self.grams(t) for t in texts]
        out = np.zeros((len(texts), self.dim), np.float32)
        codes = np.unique(np.concatenate([c for c, _ in found])) if found else np.empty(0, np.int64)
        spots = [np.searchsorted(codes, c) for c, _ in found]
        for at in range(0, len(codes), width):
            vectors = self.bound(codes[at : at + width]).astype(np.float32)
            counts = np.zeros((len(texts), len(vectors)), np.float32)
            for row, (spot, (_, n)) in enumerate(zip(spots, found, strict=True)):
                lo, hi = np.searchsorted(spot, (at, at + width))
                counts[row, spot[lo:hi] - at] = n[lo:hi]
            out += counts @ vectors
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


_KEPT: dict[int, Profiles] = {}


def _profiles() -> Profiles:
    """One set of letter vectors for a Python worker."""
    return _KEPT.setdefault(DIM, _KEPT.get(DIM) or Profiles())


def _slices(texts: pd.Series, rows: int = 256, chars: int = 2_000_000) -> Iterator[list[int]]:
    take, size = [], 0
    for i, t in enumerate(texts):
        if take and (len(take) == rows or size + len(t) > chars):
            yield take
            take, size = [], 0
        take.append(i)
        size += len(t)
    if take:
        yield take


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes. Sums come to the driver: languages x DIM numbers, whatever the number of texts."""
    sample = bounded_sample(rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col("doc_id")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()), "lang", "doc_id", LEARN_ROWS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for take in _slices(batch["text"]):
                vectors = _profiles().bundled(batch["text"].iloc[take].tolist())
                for name, v in zip(batch["lang"].iloc[take], vectors, strict=True):
                    total[name] = total.get(name, 0.0) + v.astype(np.float64)
        yield pd.DataFrame([(n, i, float(x)) for n, v in total.items() for i, x in enumerate(v)], columns=["lang", "i", "x"])

    found = sample.select("lang", "text").mapInPandas(sums, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    names = sorted(found["lang"].unique())
    protos = np.zeros((len(names), DIM), np.float32)
    for row, name in enumerate(names):
        own = found[found["lang"] == name]
        protos[row, own["i"]] = own["x"]
    length = np.linalg.norm(protos, axis=1, keepdims=True)
    return names, protos / np.where(length > 0, length, 1)


def guessed(text: Column, model: tuple[list[str], np.ndarray]) -> Column:
    """lang_pred, score (a share of 1 that the best cosine takes against the others) and cosine of a text."""
    names, protos = model

    @F.pandas_udf("lang_pred string, score double, cosine double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        texts = texts.fillna("")
        out = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cosine": 0.0})
        if not names:
            return out
        for take in _slices(texts):
            vectors = _profiles().bundled(texts.iloc[take].tolist())
            cos = vectors @ protos.T
            best = cos.argmax(axis=1)
            odds = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
            some = np.abs(vectors).max(axis=1) > 0
            top = np.take_along_axis(cos, best[:, None], 1)[:, 0].astype(float)
            out.loc[take, "lang_pred"] = np.where(some, np.array(names, object)[best], "und")
            out.loc[take, "score"] = np.where(some, 1 / odds.sum(axis=1), 0.0)
            out.loc[take, "cosine"] = np.where(some, top, 0.0)
        return out

    return guess(text)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs with what is guessed of them in _lang, in the place of a column of that name."""
    return docs.withColumn("_lang", guessed(F.col(text), model))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    model = learn(docs.where(~F.col("held_out")))
    return predict(docs, model).select("doc_id", "held_out", F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.cosine").alias("cosine"))


#: In the pipeline a text goes if it has no letter, or is long enough to judge and like no language that the table holds.
MIN_COSINE = 0.2
ENOUGH_CHARS = 200


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a language stay, and all with letters that are too short to judge. If nothing can be learned, every row stays.

    The prototypes are learned from the rows of docs outside the held-out fold. Null and empty texts have no letter and go, rows
    that repeat and rows with null ids are judged one by one, columns of any name pass through.
    """
    model = learn(docs.where(~held_out("doc_id")))
    if not model[0]:
        return docs
    lang = guessed(F.col("text"), model)
    return docs.where((lang["lang_pred"] != "und") & ((lang["cosine"] >= MIN_COSINE) | (F.length("text") < ENOUGH_CHARS)))
