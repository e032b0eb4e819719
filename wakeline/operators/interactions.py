"""Interactions of the entities of a frame: pairwise scores, normalisation over groups, and products with features.

A frame is what `frame` names, for example (source_file, window, step). Its pairs are its output, one row for each ordered pair; a
crowded frame's are dealt over tasks by their first entity, so a task holds a bounded part of them.

Where only sums over partners are asked for, `summed` joins entities of equal values to one state and works its pairs out where they
are summed: no pair is shuffled or written. Of up to MET_STATES states all pairs are met, in blocks; of more only those pairs that
`fields` can't sum by groups. A task holds the states of one frame (eight bytes a value), the names of those that ask in it (eight
bytes each, those of one state in one row), blocks of BLOCK_PAIRS pairs and the moments of the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators import fields

FRAME = ("source_file", "window", "step")
#: Entities of a frame that meet all others of it in one task.
TASK_ENTITIES = 512
#: States of a frame that meet all others of it in one task, names that these carry, and pairs that are worked out at once.
TASK_STATES, TASK_NAMES, BLOCK_PAIRS = 1 << 16, 1 << 20, 1 << 18
#: Most states of a frame that meet singly.
MET_STATES = 1 << 12
#: Fixed value: what keeps a sum of zeros from dividing by zero.
EPSILON = 1e-5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """The product of a matrix (a row for each output) and an array column, plus a bias."""
    rows = F.array(*[F.array(*map(F.lit, map(float, w))) for w in weights])
    out = F.transform(rows, lambda w: dot(w, x))
    return out if bias is None else F.zip_with(out, F.array(*map(F.lit, map(float, bias))), lambda a, b: a + b)


def head(x: Column, i: int, heads: int, width: int) -> Column:
    """The part of an array of `width` numbers that belongs to head i."""
    return F.slice(x, i * (width // heads) + 1, width // heads)


def pairs(nodes: DataFrame, values: Sequence[str], frame: Sequence[str] = FRAME, entity: str = "vessel_id") -> DataFrame:
    """Every ordered pair of a frame's entities, an entity with itself too: the frame, `entity`, its values, and the partner's as
    other and other_<value>."""
    crowd = nodes.groupBy(*frame).agg(F.ceil(F.count("*") / TASK_ENTITIES).alias("_parts")).where("_parts > 1")
    rows = nodes.select(*frame, entity, *values).join(crowd, list(frame), "left").fillna(1, ["_parts"])
    left = rows.withColumn("_part", F.pmod(F.xxhash64(entity), F.col("_parts"))).drop("_parts")
    right = rows.select(*frame, F.col(entity).alias("other"), *[F.col(v).alias(f"other_{v}") for v in values], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, [*frame, "_part"]).drop("_part")


def attention_scores(nodes: DataFrame, width: int, heads: int = 1, frame: Sequence[str] = FRAME, entity: str = "vessel_id") -> DataFrame:
    """nodes: the frame, entity, query and key (arrays of `width` numbers). A row for each pair and head with the scaled product of
    query and key; the scale is the root of the whole width, not of a head's."""
    both = pairs(nodes, ("query", "key"), frame, entity)
    each = F.array(*[dot(head(F.col("query"), i, heads, width), head(F.col("other_key"), i, heads, width)) / width**0.5 for i in range(heads)])
    return both.select(*frame, entity, "other", F.posexplode(each).alias("head", "score"))


def softmax(scores: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """weight: the exponential of a score over the group's sum; the group's largest score is taken off first."""
    own = Window.partitionBy(*group)
    raised = scores.withColumn("_e", F.exp(F.col(score) - F.max(score).over(own)))
    return raised.withColumn("weight", F.col("_e") / F.sum("_e").over(own)).drop("_e")


def zero_softmax(scores: DataFrame, group: Sequence[str], score: str = "score", eps: float = EPSILON) -> DataFrame:
    """weight: (e^x - 1)^2 over the group's sum of these plus eps; a score of zero has weight zero."""
    raised = scores.withColumn("_e", F.pow(F.exp(score) - 1, F.lit(2.0)))
    return raised.withColumn("weight", F.col("_e") / (F.sum("_e").over(Window.partitionBy(*group)) + eps)).drop("_e")


def gated(weight: Column, mask: Column, own: Column, threshold: float = 0.5) -> Column:
    """A weight times its mask, which counts where it is over the threshold, plus 1 for an entity with itself."""
    return weight * (F.when(mask > threshold, mask).otherwise(0.0) + own.cast("double"))


def propagated(adjacency: DataFrame, features: DataFrame, columns: Sequence[str], frame: Sequence[str] = FRAME, entity: str = "vessel_id", keep: Sequence[str] = ()) -> DataFrame:
    """The product of a sparse matrix and features: for every entity (and `keep`, for example its head) the sum over its partners
    of weight times the partner's columns. adjacency: the frame, entity, other, weight; zero weights need no rows."""
    right = features.select(*frame, F.col(entity).alias("other"), *columns)
    met = adjacency.where("weight <> 0").join(right, [*frame, "other"])
    return met.groupBy(*frame, entity, *keep).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns])


def prelu(x: Column, slope: float = 0.25) -> Column:
    return F.when(x >= 0, x).otherwise(slope * x)


def graph_convolution(adjacency: DataFrame, features: DataFrame, columns: Sequence[str], weights: Sequence[Sequence[float]], slope: float = 0.25, frame: Sequence[str] = FRAME, entity: str = "vessel_id") -> DataFrame:
    """out: the activated product of adjacency, features and weights, an array for each entity."""
    summed = propagated(adjacency, features, columns, frame, entity)
    return summed.select(*frame, entity, F.transform(linear(F.array(*columns), weights), lambda x: prelu(x, slope)).alias("out"))


NAMELESS = np.iinfo(np.int64).min


@dataclass
class States:
    """Some states of a frame: their values (a row for each), how many entities share each, the largest of these, and whether it has a
    name at all. Entities without a name are states of their own."""

    values: np.ndarray
    members: np.ndarray
    entity: np.ndarray
    named: np.ndarray

    def __getitem__(self, some: slice | np.ndarray) -> States:
        return States(self.values[some], self.members[some], self.entity[some], self.named[some])


@dataclass
class Work:
    """From some states and all those of their frame that they meet, the columns of the first: pair by pair, and (None: not for these)
    for many states."""

    singly: Callable[[States, States], dict[str, np.ndarray]]
    many: Callable[[States, States], dict[str, np.ndarray] | None] | None = None


def summed(nodes: DataFrame, values: Sequence[str], work: Work, columns: str, frame: Sequence[str] = FRAME, entity: str = "vessel_id") -> DataFrame:
    """The frame, `entity`, n (its partners, itself too), last (the largest of them) and columns, `work` of each entity's state.
    Partners with a null value count in n and last alone; of an entity with one the columns are null. Rows whose frame has a null
    belong to no frame and go.

    A state's row carries the names of its entities, so nobody is joined with the sums afterwards and `nodes` is worked out once.
    """
    kind = nodes.schema[entity].dataType.simpleString()
    framed = nodes.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in frame]))
    about = {"members": F.count("*"), "entity": F.coalesce(F.max(entity).cast("long"), F.lit(0).cast("long")), "names": F.collect_list(entity)}
    found = framed.groupBy(*frame, *values, F.col(entity).isNull().alias("nameless")).agg(*[x.alias(c) for c, x in about.items()])
    # These facts need every column of found, so one exchange serves them and the states.
    facts = found.groupBy(*frame).agg(F.count("*").alias("states"), F.sum("members").alias("n"), F.max(F.when(~F.col("nameless"), F.col("entity"))).alias("last"), F.sum(F.size("names")).alias("named"))
    parts = F.greatest(F.ceil(F.col("states") / TASK_STATES), F.ceil(F.col("named") / TASK_NAMES))
    rows = found.join(facts.select(*frame, "n", "last", parts.alias("_parts")), list(frame))
    own = F.pmod(F.xxhash64("entity", "nameless"), F.col("_parts"))
    dealt = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).withColumn("asks", F.col("_part") == own)
    dealt = dealt.withColumn("names", F.when(F.col("asks"), F.col("names"))).drop("_parts")
    passed = [*frame, "nameless", "members", "names", "n", "last"]
    added = {f.split()[0]: f.split()[1] for f in columns.split(", ")}
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def run(rows: pa.Table) -> pa.Table:
        x = [rows.column(v).cast(pa.float64()) for v in values]
        known = np.logical_and.reduce([c.is_valid().to_numpy() for c in x])
        numbers = np.stack([c.fill_null(0).to_numpy() for c in x], 1)
        every = States(numbers, rows.column("members").to_numpy(), rows.column("entity").to_numpy(), ~rows.column("nameless").to_numpy())
        asks = rows.column("asks").to_numpy()
        whole, asking, met = known[asks], every[asks], every[known]
        size = len(whole)
        out = {c: np.zeros(size, kinds[k].to_pandas_dtype()) for c, k in added.items()}
        step = max(1, BLOCK_PAIRS // max(1, int(known.sum())))
        with np.errstate(all="ignore"):
            found = work.many(asking[whole], met) if work.many and known.sum() > MET_STATES and whole.any() else None
            for c, y in (found or {}).items():
                out[c][whole] = y
            for at in np.split(np.flatnonzero(whole), range(step, int(whole.sum()), step)) if found is None else ():
                if len(at):
                    for c, y in work.singly(asking[at], met).items():
                        out[c][at] = y
        told = rows.filter(pa.array(asks)).select(passed)
        names = told.column("names")  # Spark asks for lists that may hold nulls
        told = told.set_column(passed.index("names"), "names", names.cast(pa.list_(pa.field("element", names.type.value_type))))
        for c, k in added.items():
            told = told.append_column(c, pa.array(out[c], kinds[k], mask=~whole))
        return told

    schema = ", ".join([*[f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in passed], columns])
    told = dealt.groupBy(*frame, "_part").applyInArrow(run, schema)
    nobody = F.array_repeat(F.lit(None).cast(kind), F.col("members").cast("int"))
    return told.select(*frame, F.explode(F.when(F.col("nameless"), nobody).otherwise(F.col("names"))).alias(entity), "n", "last", *added)


def score_sums(query: np.ndarray, key: np.ndarray, heads: int = 1) -> Work:
    """total and most of each head: the sum of its scores (see attention_scores) and the largest. query and key are the matrices of
    `linear`."""

    def work(own: States, met: States) -> dict[str, np.ndarray]:
        out = {}
        for h, (q, k) in enumerate(zip(np.split(own.values @ query.T, heads, 1), np.split(met.values @ key.T, heads, 1), strict=True)):
            score = q @ k.T / len(query) ** 0.5
            out |= {f"total{h}": score @ met.members, f"most{h}": score.max(1)}
        return out

    def many(own: States, met: States) -> dict[str, np.ndarray] | None:
        out = {}
        for h, (q, k) in enumerate(zip(np.split(query, heads), np.split(key, heads), strict=True)):
            asks, offered = own.values @ q.T / len(query) ** 0.5, met.values @ k.T
            if not np.isfinite(np.abs(asks).max(0) @ np.abs(offered).max(0)):
                return None
            most = np.empty(len(asks))
            for rows, some in fields.contenders(asks, offered, lambda *_: 0.0):
                most[rows] = (asks[rows] @ offered[some].T).max(1)
            out |= {f"total{h}": asks @ (met.members @ offered), f"most{h}": most}
        return out

    return Work(work, many)


def _softmax(own: States, met: States, query: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and softmax weight of each pair, of one of the members that are met."""
    score = (own.values @ query.T) @ (met.values @ key.T).T / len(query) ** 0.5
    raised = np.exp(score - score.max(1, keepdims=True))
    return score, raised / (raised @ met.members)[:, None]


def attention_sums(query: np.ndarray, key: np.ndarray, digits: int) -> Work:
    """total and squares of the softmax weights, and top, the partner of the largest weight, of weights that are equal when rounded the
    largest partner (NAMELESS: none of these has a name)."""

    def work(own: States, met: States) -> dict[str, np.ndarray]:
        _, weight = _softmax(own, met, query, key)
        short = np.rint(weight * 10.0**digits)
        ahead = (short == short.max(1, keepdims=True)) | np.isnan(short).any(1, keepdims=True)
        top = np.where(ahead & met.named, met.entity, NAMELESS).max(1)
        return {"total": weight @ met.members, "squares": weight**2 @ met.members, "top": top}

    maps = query.T @ key / len(query) ** 0.5

    def many(own: States, met: States) -> dict[str, np.ndarray] | None:
        asks = own.values @ maps
        softmax, twice = (fields.exponential_sums(x, met.values, met.members) for x in (asks, 2 * asks))
        if softmax is None or twice is None:
            return None

        def margin(rows: np.ndarray, least: float) -> float:
            """Scores further below the largest are of smaller rounded weights."""
            return -np.log1p(-min(1.0, 2 * 10.0**-digits * softmax[rows].max() / np.exp(least)))

        top = np.empty(len(asks), np.int64)
        for rows, some in fields.contenders(asks, met.values, margin):
            score = (own.values[rows] @ query.T) @ (met.values[some] @ key.T).T / len(query) ** 0.5
            short = np.rint(np.exp(score) / softmax[rows, None] * 10.0**digits)
            top[rows] = np.where((short == short.max(1, keepdims=True)) & met.named[some], met.entity[some], NAMELESS).max(1)
        # What a sum is divided by is that sum.
        return {"total": np.ones(len(asks)), "squares": twice / softmax**2, "top": top}

    return Work(work, many)


def adjacency_sums(query: np.ndarray, key: np.ndarray) -> Work:
    """Attention, gated by the sigmoid of the score (see gated) and normalised as in zero_softmax: zeros, how many weights are zero;
    total; and sum0, sum1, ... of weight times each value. For entities with a name, over partners with one: of the others nobody knows
    whether they are the entity itself."""

    def work(own: States, met: States) -> dict[str, np.ndarray]:
        score, weight = (x[:, met.named] for x in _softmax(own, met, query, key))
        met = met[met.named]
        if not len(met.members):
            return {}
        mask = 1 / (1 + np.exp(-score))
        mask[~(mask > 0.5)] = 0.0
        raised = (np.exp(weight * mask) - 1) ** 2
        # Of the members of an entity's own state one is itself.
        order = np.argsort(met.entity)
        row, at = np.arange(len(score)), order[np.minimum(np.searchsorted(met.entity, own.entity, sorter=order), len(order) - 1)]
        rest, itself = raised[row, at], (np.exp(weight[row, at] * (mask[row, at] + 1)) - 1) ** 2
        whole = raised @ met.members + (itself - rest) + EPSILON
        sums = (raised @ (met.values * met.members[:, None]) + (itself - rest)[:, None] * own.values) / whole[:, None]
        zeros = (raised == 0) @ met.members + (itself == 0) - (rest == 0)
        return {"zeros": zeros, "total": (whole - EPSILON) / whole} | {f"sum{i}": x for i, x in enumerate(sums.T)}

    maps = query.T @ key / len(query) ** 0.5

    def many(own: States, met: States) -> dict[str, np.ndarray] | None:
        asks = own.values @ maps
        softmax = fields.exponential_sums(asks, met.values, met.members)
        met = met[met.named]
        if softmax is None or not len(met.members):
            return softmax if softmax is None else {}
        share = 1 / softmax

        def raised(score: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """(e^g - 1)^2 of the weight times the sigmoid, g, in place; three terms do for a small g."""
            g = np.exp(score)
            work = g + 1
            g *= g
            g /= work
            g *= share[rows, None]
            if not tiny:
                return np.square(np.expm1(g, g), g)
            np.multiply(g, 7 / 12, work)
            work += 1
            work *= g
            work += 1
            g *= g
            g *= work
            return g

        most = (np.abs(asks).max(0) * np.abs(met.values).max(0)).sum()
        tiny = np.exp(most) * share.max() < 2e-4
        found = fields.positive_sums(asks, met.values, met.members.astype(float), raised, np.expm1(share / 2) ** 2)
        if found is None:
            return None
        ahead, total, sums = found
        score = (asks * own.values).sum(1)
        weight = np.exp(score) * share
        mask = np.where(score > fields.POSITIVE, 1 / (1 + np.exp(-score)), 0.0)
        rest, itself = np.expm1(weight * mask) ** 2, np.expm1(weight * (mask + 1)) ** 2
        whole = total + (itself - rest) + EPSILON
        sums = (sums + (itself - rest)[:, None] * own.values) / whole[:, None]
        zeros = met.members.sum() - ahead + (itself == 0) - (rest == 0)
        return {"zeros": zeros, "total": (whole - EPSILON) / whole} | {f"sum{i}": x for i, x in enumerate(sums.T)}

    return Work(work, many)


def inverse_distance_sums(most: float) -> Work:
    """near: the sum of inverse distances, each at most `most`, and 0 where two coincide; known: of how many partners."""

    def work(own: States, met: States) -> dict[str, np.ndarray]:
        d = np.sqrt(sum((a[:, None] - b) ** 2 for a, b in zip(own.values.T, met.values.T, strict=True)))
        return {"near": np.where(d == 0, 0.0, np.fmin(1 / d, most)) @ met.members, "known": met.members.sum()}

    def many(own: States, met: States) -> dict[str, np.ndarray] | None:
        near = fields.inverse_distance_sums(own.values, met.values, met.members, most) if own.values.shape[1] == 2 else None
        return None if near is None else {"near": near, "known": met.members.sum()}

    return Work(work, many)
