"""Sliding windows of L consecutive observed frames in which an entity is complete, and what is computed on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import numpy as np

FEATURES = ("lon", "lat", "sog", "heading")


def frame_index(frames: DataFrame) -> DataFrame:
    """idx: rank from 0 of a frame among the file's distinct frames. Only distinct frames are ranked, then joined back."""
    distinct = frames.select("source_file", "frame_id").distinct()
    order = Window.partitionBy("source_file").orderBy("frame_id")
    return frames.join(distinct.withColumn("idx", F.row_number().over(order) - 1), ["source_file", "frame_id"])


def rounded4(c: Column) -> Column:
    """Four decimals in single precision, half to even."""
    return (F.rint(c.cast("float") * F.lit(10000).cast("float")) / 1e4).cast("float")


#: Frames of a track that one task starts windows in.
SPAN = 4096


def spans(indexed: DataFrame, length: int, span: int) -> DataFrame:
    """The rows with span, the range of frames whose windows need them: their own, and the one before where it reaches over by the
    length of a window less one. A track of any length is dealt over as many tasks as it has spans."""
    own = F.floor(F.col("idx") / span)
    reached = F.greatest(F.lit(0), F.floor((F.col("idx") - (length - 1)) / span))
    return indexed.withColumn("span", F.explode(F.sequence(reached, own)))


def members(indexed: DataFrame, length: int, skip: int = 1, span: int = SPAN) -> DataFrame:
    """source_file, start, vessel_id, path: entities with exactly one row in each of the window's frames."""
    ahead = Window.partitionBy("source_file", "vessel_id", "span").orderBy("idx").rangeBetween(0, length - 1)
    seen = spans(indexed, length, span).withColumns({
        "_n": F.count("*").over(ahead), "_last": F.max("idx").over(ahead),
        "path": F.collect_list(F.struct("idx", *FEATURES)).over(ahead),
    })
    full = seen.where((F.floor(F.col("idx") / span) == F.col("span")) & (F.col("_n") == length) & (F.col("_last") == F.col("idx") + length - 1) & (F.col("idx") % skip == 0))
    return full.select("source_file", F.col("idx").alias("start"), "vessel_id", "path").dropDuplicates(["source_file", "start", "vessel_id"])


def windows(indexed: DataFrame, length: int, skip: int = 1, min_entities: int = 1) -> DataFrame:
    """members of windows with more than min_entities complete entities."""
    found = members(indexed, length, skip)
    big = found.groupBy("source_file", "start").agg(F.count("*").alias("n")).where(F.col("n") > min_entities)
    return found.join(big.select("source_file", "start"), ["source_file", "start"], "left_semi")


def steps(found: DataFrame) -> DataFrame:
    """A row for each member and step, with first differences; that of step 0 is 0."""
    before = F.concat(F.slice("path", 1, 1), F.slice("path", 1, F.size("path") - 1))
    rows = found.select("source_file", "start", "vessel_id", F.posexplode(F.arrays_zip(F.col("path").alias("p"), before.alias("q"))).alias("step", "x"))
    now, last = (lambda c: F.col(f"x.p.{c}")), (lambda c: F.col(f"x.q.{c}"))
    return rows.select("source_file", "start", "vessel_id", "step", *[now(c).alias(c) for c in FEATURES], *[F.when(F.col("step") == 0, 0.0).otherwise(F.coalesce(now(c) - last(c), F.lit(0.0))).alias(f"d_{c}") for c in FEATURES])


def nodes(found: DataFrame, columns: tuple[str, ...] = tuple(f"d_{c}" for c in FEATURES)) -> DataFrame:
    """A row for each window and step: the columns of its entities, in the order of their ids. Deltas by default."""
    one = F.struct("vessel_id", F.array(*columns).alias("x"))
    every = steps(found).groupBy("source_file", "start", "step").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return every.select("source_file", "start", "step", F.col("all.x").alias("nodes"))


def numbered(found: DataFrame) -> DataFrame:
    """window: the number from 0 of a window among those of all files, by file name and start. Only windows are ranked, by file."""
    one = found.select("source_file", "start").distinct()
    own = one.withColumn("_own", F.row_number().over(Window.partitionBy("source_file").orderBy("start")) - 1)
    sizes = one.groupBy("source_file").agg(F.count("*").alias("_n"))
    ahead = sizes.select("source_file", (F.sum("_n").over(Window.orderBy("source_file")) - F.col("_n")).alias("_ahead"))
    placed = own.join(ahead, "source_file").select("source_file", "start", (F.col("_own") + F.col("_ahead")).alias("window"))
    return found.join(placed, ["source_file", "start"])


def shuffled(found: DataFrame, seed: int = 0) -> DataFrame:
    """The rows in an order of windows that the seed decides, the same in every run."""
    return found.orderBy(F.xxhash64(F.lit(seed), "source_file", "start"), "source_file", "start", "vessel_id")


def shuffle_order(found: DataFrame, seed: int = 0) -> DataFrame:
    """source_file, start, position: the number from 0 of each window in an order that the seed decides. Windows are ranked in parts
    by the first digits of a hash, so no task holds all of them."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "source_file", F.col("start").cast("string")).cast("binary"))
    one = found.select("source_file", "start").distinct().withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
    own = one.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("_key", "source_file", "start")) - 1)
    # At most 4096 parts are summed up in one task.
    sizes = one.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    return own.join(ahead, "_part").select("source_file", "start", (F.col("_own") + F.col("_ahead")).alias("position"))


def split_paths(found: DataFrame, observed: int, predicted: int) -> DataFrame:
    """The observed and the predicted part of every path, and the mask of ones."""
    return found.select("source_file", "start", "vessel_id", F.slice("path", 1, observed).alias("observed"), F.slice("path", observed + 1, predicted).alias("predicted"), F.array_repeat(F.lit(1.0), observed + predicted).alias("mask"))


def ordinals(found: DataFrame) -> DataFrame:
    """ordinal of an entity in its window, and the window's first and last offset in the list of all members."""
    sizes = found.groupBy("source_file", "start").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source_file").orderBy("start")
    ends = sizes.withColumn("last_offset", F.sum("n").over(order)).withColumn("first_offset", F.col("last_offset") - F.col("n"))
    own = Window.partitionBy("source_file", "start").orderBy("vessel_id")
    return found.select("source_file", "start", "vessel_id").withColumn("ordinal", F.row_number().over(own) - 1).join(ends.drop("n"), ["source_file", "start"])


def most_present(indexed: DataFrame, length: int) -> DataFrame:
    """Largest number of distinct entities in any window, complete or not."""
    top = indexed.groupBy("source_file").agg(F.max("idx").alias("_top"))
    placed = indexed.join(top, "source_file").where(F.col("_top") >= length - 1)
    starts = F.sequence(F.greatest(F.lit(0), F.col("idx") - length + 1), F.least("idx", F.col("_top") - length + 1))
    seen = placed.select("source_file", "vessel_id", F.explode(starts).alias("start"))
    return seen.groupBy("source_file", "start").agg(F.count_distinct("vessel_id").alias("n")).agg(F.max("n").alias("max_present"))


def residual_matrix(n: int) -> np.ndarray:
    """y'My is the squared error of the best quadratic through n equally spaced points."""
    if n < 4:
        raise ValueError("at least four predicted steps are needed")
    x = np.vander(np.arange(n), 3)
    return np.eye(n) - x @ np.linalg.solve(x.T @ x, x.T)


def curvature(path: Column, predicted: int) -> Column:
    """The squared error of the best quadratics through the last points of lon and lat."""
    m = residual_matrix(predicted)
    last = F.slice(path, -predicted, predicted)
    error = lambda c: sum((last[i][c].cast("double") * last[j][c].cast("double") * float(m[i, j]) for i in range(predicted) for j in range(predicted)), F.lit(0.0))
    return error("lon") + error("lat")


def non_linear(found: DataFrame, predicted: int, threshold: float = 0.002) -> DataFrame:
    """1 if a quadratic misses the last points of lon and lat by at least threshold (sum of squares)."""
    total = curvature(F.col("path"), predicted)
    return found.select("source_file", "start", "vessel_id", total.alias("residual"), (total >= threshold).cast("int").alias("non_linear"))


def differences(path: Column) -> Column:
    """A path's first differences; those of its first step are 0."""
    zero = F.lit(0.0)
    one = lambda x, i: F.struct(*[F.when(i == 0, zero.cast("float")).otherwise((x[c] - F.get(path, i - 1)[c]).cast("float")).alias(c) for c in FEATURES])
    return F.transform(path, one)
