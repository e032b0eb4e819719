"""Jobs over files: raw reports to normalised frames by split, and nested trajectories to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.config import BASELINE_WINDOWS, CleanParams, EvaluationParams, WindowParams, job_preset
from wakeline.operators import frames, scores, tracks, windows
from wakeline.sources import readers, sinks
from wakeline.sources.scratch import shared_folder


def prepared(reports: DataFrame, p: CleanParams) -> DataFrame:
    """Clean reports on a regular grid, at times when enough entities of the file are present."""
    grid = tracks.resample(tracks.clean(reports, p), p.step_s, p.max_gap_s, p.rolling)
    return tracks.shared_times(grid, p.min_entities)


def frame_table(reports: DataFrame, p: CleanParams, stats: DataFrame | None = None, zscore: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Frames of every file and the statistics that scaled them: those given, else those of all rows; none without zscore."""
    rows = prepared(reports, p)
    if zscore:
        stats = frames.statistics(rows) if stats is None else stats
        rows = frames.zscored(rows, stats)
    return frames.frame_format(rows), stats if zscore else None


def split_frames(reports: DataFrame, p: CleanParams) -> tuple[DataFrame, DataFrame]:
    """Frames with split and date_str from each file's name, scaled by the statistics of the training files alone, and these.

    Files whose name tells no split are left out. The prepared rows are written to the shared folder, as the statistics and the
    frames both need them; they go when the application ends.
    """
    name = F.col("source_file")
    routed = reports.where(frames.split_of_day(frames.day_of_name(name)).isNotNull())
    rows = prepared(routed, p).withColumn("split", frames.split_of_day(frames.day_of_name(name))).withColumn("date_str", frames.date_of_name(name))
    path = shared_folder(reports.sparkSession, "prepared")
    rows.write.mode("overwrite").parquet(path)
    rows = reports.sparkSession.read.schema(rows.schema).parquet(path)
    stats = frames.statistics(rows.where("split = 'train'"))
    return frames.frame_format(frames.zscored(rows, stats), keep=("split", "date_str")), stats


def reports_to_frames(spark: SparkSession, folder: str, out: str, region: str = "southwestern", inner: str | None = None, nrows: int | None = None) -> None:
    """Archives AIS_*.zip of a folder to out/frames by split and day, out/stats, and out/stats_by_day with a copy for each day."""
    found, stats = split_frames(readers.reports_zip(spark, folder, inner, nrows), job_preset(region))
    sinks.frames_by_split(found, f"{out}/frames")
    sinks.stats_json(stats, f"{out}/stats")
    sinks.stats_by_day(stats, found, f"{out}/stats_by_day")


def trajectories_to_frames(spark: SparkSession, path: str, out: str) -> None:
    """Nested trajectories to a sorted frame table in out/frames and the fixed statistics in out/stats."""
    sinks.frames_csv(frames.flattened(readers.trajectories_json(spark, path)), f"{out}/frames")
    sinks.stats_json(sinks.fixed_stats(spark), f"{out}/stats", note="fixed scaling")


def dataset(rows: DataFrame, p: WindowParams) -> DataFrame:
    """Windows of frame tables: window (its number over all files), source_file, start, vessel_id; observed, predicted and their
    first differences; non_linear and the mask. Features are rounded in single precision before anything is computed on them."""
    rounded = rows.select("source_file", "frame_id", "vessel_id", *[windows.rounded4(F.col(c)).alias(c) for c in windows.FEATURES])
    found = windows.numbered(windows.windows(windows.frame_index(rounded), p.length, p.skip, p.min_entities))
    bare = F.transform("path", lambda x: F.struct(*[x[c].alias(c) for c in windows.FEATURES]))
    placed = found.select("window", "source_file", "start", "vessel_id", bare.alias("path"))
    both = placed.withColumn("rel", windows.differences(F.col("path")))
    part = lambda c, seen: F.slice(c, 1, p.observed) if seen else F.slice(c, p.observed + 1, p.predicted)
    return both.select(
        "window", "source_file", "start", "vessel_id", part("path", True).alias("observed"), part("path", False).alias("predicted"), part("rel", True).alias("observed_rel"), part("rel", False).alias("predicted_rel"),
        (windows.curvature(F.col("path"), p.predicted) >= p.threshold).cast("int").alias("non_linear"), F.array_repeat(F.lit(1.0), p.length).alias("mask"),
    )


def _truth(found: DataFrame) -> DataFrame:
    steps = found.select(*scores.TRACK, F.posexplode("predicted").alias("i", "p"))
    lon, lat = frames.unscaled(F.col("p.lon"), F.col("p.lat"))
    return steps.select(*scores.TRACK, (F.col("i") + 1).alias("step"), lon.alias("lon"), lat.alias("lat"))


def evaluation(found: DataFrame, predictions: DataFrame, predicted: int, step_minutes: int = 10, slots: int = 5) -> DataFrame:
    """Scores of predicted accelerations (source_file, window, vessel_id, step, acc_lon, acc_lat) of the windows that dataset() gives:
    summed twice from the last observed velocity and position, scaled back to degrees, compared with what followed."""
    at, by = F.element_at("observed", -1), F.element_at("observed_rel", -1)
    last = found.select(*scores.TRACK, *[at[c].alias(f"last_{c}") for c in ("lon", "lat")], *[by[c].alias(f"vel_{c}") for c in ("lon", "lat")])
    position = scores.integrated(predictions.join(last, list(scores.TRACK)))
    lon, lat = frames.unscaled(F.col("lon"), F.col("lat"))
    dist = scores.distances(position.select(*scores.STEP, lon.alias("lon"), lat.alias("lat")), _truth(found))
    return scores.compared(dist, predicted, step_minutes, slots)


def baseline(found: DataFrame, predicted: int, windows_taken: int = BASELINE_WINDOWS) -> DataFrame:
    """ade, fde, windows of the last observed position, held, over the first windows."""
    first = found.where(F.col("window") < windows_taken)
    at = F.element_at("observed", -1)
    lon, lat = frames.unscaled(at["lon"], at["lat"])
    return scores.ade_fde(scores.persistence(first.select(*scores.TRACK, lon.alias("lon"), lat.alias("lat")), _truth(first)), predicted)


def evaluate(spark: SparkSession, p: EvaluationParams, predictions: DataFrame, out: str) -> DataFrame:
    """The evaluation of a split's frame tables, written to out/run=<tag>-<split>; a split without windows is an error."""
    found = dataset(readers.frames_csv(spark, p.folder), p.windows)
    if found.isEmpty():
        raise ValueError(f"no windows in {p.folder}")
    result = evaluation(found, predictions, p.windows.predicted, p.step_minutes, p.slots)
    sinks.metrics(result, out, f"{p.tag}-{p.split}")
    return result
