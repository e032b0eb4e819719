"""Profile of a frame table: sizes, gap-free segments, density, gaps and verdicts. Rows: split, frame_id, vessel_id, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.config import EXPECTED_STATS


def sizes(frames: DataFrame) -> DataFrame:
    return frames.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("vessel_id").alias("vessels"), F.count_distinct("frame_id").alias("frames"))


def segments(frames: DataFrame, max_step: int = 1) -> DataFrame:
    """Runs of frames of one vessel whose numbers rise by max_step at most: split, vessel_id, segment, length (rows)."""
    order = Window.partitionBy("split", "vessel_id").orderBy("frame_id")
    new = F.when(F.col("frame_id") - F.lag("frame_id").over(order) > max_step, 1).otherwise(0)
    rows = frames.select("split", "vessel_id", "frame_id", new.alias("_new")).withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("split", "vessel_id", "segment").agg(F.count("*").alias("length"))


def segment_summary(found: DataFrame, length: int) -> DataFrame:
    """Segments, usable ones, windows that they allow, and exact percentiles of their lengths."""
    marks = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    p = F.percentile("length", F.array(*[F.lit(m) for m in marks]))
    return found.groupBy("split").agg(
        F.count("*").alias("segments"), F.sum((F.col("length") >= length).cast("long")).alias("usable"),
        F.sum(F.greatest(F.lit(0), F.col("length") - length + 1)).alias("windows"), p.alias("_p"),
    ).select("split", "segments", "usable", "windows", *[F.col("_p")[i].alias(f"p{round(m * 100)}") for i, m in enumerate(marks)])


def density(frames: DataFrame) -> DataFrame:
    n = frames.groupBy("split", "frame_id").agg(F.count_distinct("vessel_id").alias("n"))
    return n.groupBy("split").agg(F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), (F.avg((F.col("n") < 2).cast("double")) * 100).alias("lonely_percent"))


def gaps(frames: DataFrame) -> DataFrame:
    order = Window.partitionBy("split").orderBy("frame_id")
    rows = frames.select("split", "frame_id").distinct().withColumn("step", F.col("frame_id") - F.lag("frame_id").over(order))
    return rows.groupBy("split").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.sum(F.when(F.col("step") > 1, 1).otherwise(0)).alias("gaps"))


def total_windows(summary: DataFrame) -> DataFrame:
    """The windows that all splits together allow."""
    return summary.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"))


def verdicts(summary: DataFrame, stats: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Issues of a profile: too small deviations of positions, missing splits, too few windows in all. No issue, no row."""
    spark = summary.sparkSession
    missing = spark.createDataFrame([(s,) for s in splits], "about string").join(summary.select(F.col("split").alias("about")), "about", "left_anti").withColumn("issue", F.lit("missing split"))
    few = F.when(F.col("windows") < 1000, "under 1000 windows").when(F.col("windows") < 10000, "under 10000 windows")
    total = total_windows(summary).select(F.lit("windows").alias("about"), few.alias("issue")).where("issue is not null")
    flat = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("about"), F.col(f"{c}_std").alias("v")) for c in ("lon", "lat")])).alias("s")).where("s.v < 0.1")
    return missing.unionByName(total).unionByName(flat.select("s.about", F.lit("deviation under 0.1").alias("issue")))


def expected_ranges(stats: DataFrame) -> DataFrame:
    """about, mean, std of each column of a statistics row, and whether each is in the range expected of scaled data."""
    one = lambda c: F.struct(F.lit(c).alias("about"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"), F.col(f"{c}_mean").between(*EXPECTED_STATS[c][0]).alias("mean_ok"), F.col(f"{c}_std").between(*EXPECTED_STATS[c][1]).alias("std_ok"))
    return stats.select(F.explode(F.array(*[one(c) for c in EXPECTED_STATS])).alias("s")).select("s.*")
