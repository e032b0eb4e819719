"""Scores of predicted tracks. Rows are (source_file, window, vessel_id, step, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.config import PUBLISHED

SCENE = ("source_file", "window")
TRACK = (*SCENE, "vessel_id")
STEP = (*TRACK, "step")


def integrated(acc: DataFrame) -> DataFrame:
    """Positions from accelerations: summed to velocity (plus the last one), summed to position (plus the last one)."""
    order = Window.partitionBy(*TRACK).orderBy("step")
    v = acc.withColumns({f"v_{c}": F.sum(f"acc_{c}").over(order) + F.col(f"vel_{c}") for c in ("lon", "lat")})
    return v.withColumns({c: F.sum(f"v_{c}").over(order) + F.col(f"last_{c}") for c in ("lon", "lat")}).select(*STEP, "lon", "lat")


def absolute(rel: DataFrame, columns: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """Running sums of differences from each track's first node (first_<column>)."""
    order = Window.partitionBy(*TRACK).orderBy("step")
    return rel.withColumns({c: F.sum(f"d_{c}").over(order) + F.col(f"first_{c}") for c in columns})


def distances(pred: DataFrame, truth: DataFrame, keys: tuple[str, ...] = STEP) -> DataFrame:
    t = truth.select(*keys, F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))
    return held(pred.join(t, list(keys)))


def ade_fde(dist: DataFrame, last_step: int) -> DataFrame:
    """Means over windows of each window's mean distance: over all steps, and of the last step."""
    one = dist.groupBy(*SCENE).agg(F.avg("distance").alias("ade"), F.avg(F.when(F.col("step") == last_step, F.col("distance"))).alias("fde"))
    return one.agg(F.avg("ade").alias("ade"), F.avg("fde").alias("fde"), F.count("*").alias("windows"))


def by_step(dist: DataFrame, slots: int = 5) -> DataFrame:
    """The mean over windows of each step's mean distance; slots without steps stay null."""
    one = dist.groupBy(*SCENE, "step").agg(F.avg("distance").alias("d")).groupBy("step").agg(F.avg("d").alias("distance"))
    return dist.sparkSession.range(1, slots + 1).select(F.col("id").cast("int").alias("step")).join(one, "step", "left")


def persistence(observed: DataFrame, truth: DataFrame) -> DataFrame:
    """Distances of the last observed position, held for every predicted step."""
    held = truth.select(*STEP).join(observed.select(*TRACK, "lon", "lat"), list(TRACK))
    return distances(held, truth)


def held(rows: DataFrame) -> DataFrame:
    """distance of rows that hold a position (lon, lat) beside the truth (t_lon, t_lat): persistence without a join."""
    return rows.withColumn("distance", F.sqrt((F.col("lon") - F.col("t_lon")) ** 2 + (F.col("lat") - F.col("t_lat")) ** 2))


def scene_scores(dist: DataFrame, counts: DataFrame, last_step: int) -> DataFrame:
    """ade_fde of the first n entities (by id) of each window; counts: source_file, window, n."""
    rank = Window.partitionBy(*SCENE).orderBy("vessel_id")
    ids = dist.select(*TRACK).distinct().withColumn("_r", F.row_number().over(rank)).join(counts, list(SCENE)).where(F.col("_r") <= F.col("n"))
    return ade_fde(dist.join(ids.select(*TRACK), list(TRACK), "left_semi"), last_step)


def best_of_k(dist: DataFrame, last_step: int) -> DataFrame:
    """Of each window's samples the one of least mean distance, with its own final distance; ades: those of all samples, in order."""
    one = dist.groupBy(*SCENE, "sample").agg(F.avg("distance").alias("ade"), F.avg(F.when(F.col("step") == last_step, F.col("distance"))).alias("fde"))
    return one.groupBy(*SCENE).agg(F.min_by(F.struct("sample", "ade", "fde"), F.struct("ade", "sample")).alias("b"), F.array_sort(F.collect_list(F.struct("sample", "ade"))).alias("_all")).select(*SCENE, "b.sample", "b.ade", "b.fde", F.col("_all.ade").alias("ades"))


def huber(d: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(d) <= delta, 0.5 * d * d).otherwise(delta * (F.abs(d) - 0.5 * delta))


def position_loss(pred: DataFrame, truth: DataFrame, steps: int, scale: float = 10.0) -> DataFrame:
    """Per window: the weighted sum of each step's mean loss, weights falling linearly to 1 and adding to 1."""
    both = pred.join(truth.select(*STEP, F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat")), list(STEP))
    one = both.groupBy(*SCENE, "step").agg(F.avg((huber(F.col("lon") - F.col("t_lon")) + huber(F.col("lat") - F.col("t_lat"))) / 2).alias("loss"))
    weight = (F.lit(steps) - (F.col("step") - 1)) / F.lit(steps * (steps + 1) / 2)
    return one.groupBy(*SCENE).agg((F.sum(weight * F.col("loss")) * scale).alias("loss"))


def gaussian_nll(x: Column, y: Column, mx: Column, my: Column, log_sx: Column, log_sy: Column, raw_rho: Column) -> Column:
    """Negative log-likelihood of a bivariate normal; deviations are exponentials, the correlation a hyperbolic tangent."""
    sx, sy, rho = F.exp(log_sx), F.exp(log_sy), F.tanh(raw_rho)
    # The least product of deviations, the least 1 - rho^2 and the least density.
    area, free = F.greatest(sx * sy, F.lit(1e-6)), F.greatest(1 - rho**2, F.lit(1e-6))
    zx, zy = x - mx, y - my
    z = (zx / sx) ** 2 + (zy / sy) ** 2 - 2 * (rho * zx * zy) / area
    density = F.exp(-z / (2 * free)) / (2 * 3.141592653589793 * (area * F.sqrt(free)))
    return -F.log(F.greatest(density, F.lit(1e-20)))


def gaussian_loss(rows: DataFrame, nll: Column) -> DataFrame:
    """loss: the mean of the negative log-likelihoods of all rows."""
    return rows.agg(F.avg(nll).alias("loss"))


def batch_losses(losses: DataFrame, batch: int = 32) -> DataFrame:
    """losses: kind, position (from 0), loss. The sum of each batch over the full batch size, a last short one, too."""
    own = losses.groupBy("kind", F.floor(F.col("position") / batch).alias("batch"))
    return own.agg((F.sum("loss") / batch).alias("loss"))


def normal(seed: int, keys: tuple[Column, ...]) -> tuple[Column, Column]:
    """Two independent standard normal draws that the seed and the keys decide, alike on any partitioning: two 52-bit parts of the
    keys' MD5 as uniform numbers inside (0, 1), turned by Box and Muller's formula. Null keys count as empty text."""
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]).cast("binary"))
    uniform = lambda at: (F.conv(F.substring(told, at, 13), 16, 10).cast("long") + 0.5) / 2**52
    away, turn = F.sqrt(-2 * F.log(uniform(1))), 2 * 3.141592653589793 * uniform(14)
    return away * F.cos(turn), away * F.sin(turn)


def samples(params: DataFrame, k: int = 20, seed: int = 0, keys: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """k draws for each row of mx, my, log_sx, log_sy, raw_rho; the row's keys and the draw's number decide it."""
    drawn = params.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    a, b = normal(seed, (*[F.col(c) for c in keys], F.col("sample")))
    drawn = drawn.withColumns({"_a": a, "_b": b})
    rho = F.tanh("raw_rho")
    # Fixed value: the least 1 - rho^2.
    free = F.sqrt(F.greatest(1 - rho**2, F.lit(1e-6)))
    return drawn.withColumns({"lon": F.col("mx") + F.exp("log_sx") * F.col("_a"), "lat": F.col("my") + F.exp("log_sy") * (rho * F.col("_a") + free * F.col("_b"))}).drop("_a", "_b")


def against_published(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """scores: horizon, distance. The published average error of that horizon and the ratio, N/A where none is known."""
    known = spark.createDataFrame([(h, a) for h, (a, _) in PUBLISHED.items()], "horizon int, published double")
    ratio = F.coalesce(F.format_string("%.2f", F.col("distance") / F.col("published")), F.lit("N/A"))
    return scores.join(F.broadcast(known), "horizon", "left").withColumn("ratio", F.when(F.col("published").isNull() | F.col("distance").isNull(), "N/A").otherwise(ratio))


def compared(dist: DataFrame, predicted: int, step_minutes: int = 10, slots: int = 5) -> DataFrame:
    """measure, horizon (minutes), distance, published, ratio, windows: each step's mean distance, then ADE and FDE over all steps,
    beside the published figures of their horizon."""
    spark = dist.sparkSession
    whole = ade_fde(dist, predicted)
    steps = by_step(dist, slots).crossJoin(F.broadcast(whole.select("windows"))).select(F.concat(F.lit("step "), "step").alias("measure"), (F.col("step") * step_minutes).alias("horizon"), "distance", F.lit("ADE").alias("kind"), "windows")
    both = whole.select("windows", F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("measure"), F.col(k).alias("distance")) for k in ("ade", "fde")])).alias("x"))
    rows = steps.unionByName(both.select("x.measure", F.lit(predicted * step_minutes).alias("horizon"), "x.distance", F.col("x.measure").alias("kind"), "windows"))
    # A handful of fixed rows.
    known = spark.createDataFrame([(h, k, v) for h, (a, f) in PUBLISHED.items() for k, v in (("ADE", a), ("FDE", f))], "horizon int, kind string, published double")
    ratio = F.coalesce(F.format_string("%.2fx", F.when(F.col("distance").isNotNull(), F.col("distance") / F.col("published"))), F.lit("N/A"))
    told = F.when(F.col("distance").isNull() | F.col("published").isNull(), "N/A").otherwise(ratio)
    return rows.join(F.broadcast(known), ["horizon", "kind"], "left").select("measure", "horizon", "distance", "published", told.alias("ratio"), "windows")


def best_epoch(log: DataFrame) -> DataFrame:
    """The epoch of least loss for each kind of loss; of ties the first."""
    return log.groupBy("kind").agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss"))


def inverse_distance(d: Column) -> Column:
    return F.when(d == 0, 0.0).otherwise(1 / d)


def closer_to_zero(current: Column, new: Column) -> Column:
    """Whether the new value wins: it is nearer to zero, or as near and the smaller of the two."""
    return F.least(F.struct(F.abs(current).alias("far"), current.alias("x")), F.struct(F.abs(new).alias("far"), new.alias("x")))["x"] != current


def sparse(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score > threshold, score).otherwise(0.0)
