"""Sinks: frames by split, statistics as JSON, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.config import LAT_SCALE, LON_SCALE


def _frame_columns(frames: DataFrame) -> list:
    return ["frame_id", "vessel_id", F.col("lon").alias("LON"), F.col("lat").alias("LAT"), F.col("sog").alias("SOG"), F.col("heading").alias("Heading")]


def frames_by_split(frames: DataFrame, path: str, fmt: str = "parquet") -> None:
    """frames has split and date_str besides the frame columns; both become folders. Rows of a day go together, but a large day is cut
    into several tasks and files, each sorted."""
    out = frames.select("split", "date_str", *_frame_columns(frames)).hint("rebalance", "split", "date_str").sortWithinPartitions("split", "date_str", "frame_id", "vessel_id")
    out.write.mode("overwrite").partitionBy("split", "date_str").option("header", True).format(fmt).save(path)


def frames_csv(frames: DataFrame, path: str) -> None:
    frames.select(*_frame_columns(frames)).orderBy("frame_id", "vessel_id").write.mode("overwrite").option("header", True).csv(path)


def _stats_columns() -> list:
    return [F.struct(F.col(f"{c.lower()}_mean").alias("mean"), F.col(f"{c.lower()}_std").alias("std")).alias(c) for c in ("LON", "LAT", "SOG", "Heading")]


def stats_by_day(stats: DataFrame, frames: DataFrame, path: str) -> None:
    """A copy of the single statistics row for each split and day of the frames."""
    days = frames.select("split", "date_str").distinct()
    days.crossJoin(F.broadcast(stats)).select("split", "date_str", *_stats_columns()).write.mode("overwrite").partitionBy("split", "date_str").json(path)


def stats_json(stats: DataFrame, path: str, note: str | None = None) -> None:
    """A single row, so one file."""
    stats.select(*_stats_columns(), *([F.lit(note).alias("_note")] if note else [])).coalesce(1).write.mode("overwrite").json(path)


def fixed_stats(spark: SparkSession) -> DataFrame:
    """The constants of the inverse min-max scaling as a statistics row."""
    row = (*LON_SCALE, *LAT_SCALE, 0.0, 30.695, 0.0, 3.141592653589793)
    return spark.createDataFrame([row], ", ".join(f"{c}_{k} double" for c in ("lon", "lat", "sog", "heading") for k in ("mean", "std")))


def metrics(scores: DataFrame, path: str, run: str) -> None:
    """Scores of a run, in a folder of its own; a repeated run replaces it."""
    scores.write.mode("overwrite").json(f"{path}/run={run}")
