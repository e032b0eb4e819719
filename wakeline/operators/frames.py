"""Statistics, scaling, frame numbers and file routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.config import BUCKET_MS, LAT_SCALE, LON_SCALE, REGIONS, SPLIT_DAYS

FEATURES = ("lon", "lat", "sog", "heading")


def statistics(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: mean and sample deviation of each column; a deviation that is null, NaN or 0 becomes 1."""
    one = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])
    safe = lambda s: F.when(F.col(s).isNull() | F.isnan(s) | (F.col(s) == 0), 1.0).otherwise(F.col(s)).alias(s)
    return one.select(*[x for c in columns for x in (F.col(f"{c}_mean"), safe(f"{c}_std"))])


def zscored(df: DataFrame, stats: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """stats is an aggregate without groups, a single row, so it is broadcast."""
    both = df.crossJoin(F.broadcast(stats))
    return both.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*stats.columns)


def unscaled(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The inverse of the fixed min-max scaling."""
    return lon * LON_SCALE[1] + LON_SCALE[0], lat * LAT_SCALE[1] + LAT_SCALE[0]


def frame_format(df: DataFrame, unit_s: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """frame_id: time units since the first row of the file, half to even. First times are joined in: no task holds a whole file.
    keep: further columns to carry."""
    first = df.groupBy("source_file").agg(F.min("ts").alias("_t0"))
    since = (F.unix_micros("ts") - F.unix_micros("_t0")) / (unit_s * 1e6)
    return df.join(first, "source_file").select("source_file", F.bround(since).cast("int").alias("frame_id"), F.col("mmsi").alias("vessel_id"), *FEATURES, *keep)


def bucket_of(ms: Column) -> Column:
    return F.floor(ms / BUCKET_MS).cast("int")


def day_of_name(name: Column) -> Column:
    """Day of month where AIS_yyyy_mm_dd.zip stands in the name, else null."""
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"AIS_\d{4}_\d{2}_(\d{2})\.zip", 1).try_cast("int")


def date_of_name(name: Column) -> Column:
    found = F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"AIS_(\d{4}_\d{2}_\d{2})\.zip", 1)
    return F.nullif(found, F.lit(""))


def split_of_day(day: Column) -> Column:
    """train, val or test; days outside all of them give null."""
    return reduce(lambda c, kv: c.when(day.between(*kv[1]), kv[0]), SPLIT_DAYS.items(), F.when(F.lit(False), ""))


def flattened(trajectories: DataFrame, column: str = "trajectories") -> DataFrame:
    """Frames from nested arrays: empty trajectories go, the entity is that of a trajectory's first point."""
    one = trajectories.select("source_file", F.explode(column).alias("t")).where(F.size("t") > 0)
    points = one.select("source_file", F.col("t")[0][12].cast("long").alias("vessel_id"), F.explode("t").alias("p"))
    return points.select("source_file", bucket_of(F.col("p")[0]).alias("frame_id"), "vessel_id", *[F.col("p")[i].alias(c) for i, c in ((2, "lon"), (1, "lat"), (3, "sog"), (4, "heading"))])


def region_of(lat: Column, lon: Column) -> Column:
    """The region in whose box a position lies; outside of all of them null."""
    return reduce(lambda c, kv: c.when(lat.between(*kv[1][0]) & lon.between(*kv[1][1]), kv[0]), REGIONS.items(), F.when(F.lit(False), ""))
