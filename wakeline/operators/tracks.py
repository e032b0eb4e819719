"""Cleaning, deduplication, sessions, regular grids and co-occurrence of position reports.

Rows: source_file, mmsi, ts, lon, lat, sog, heading, status, ordinal (the order in the file). Every key holds source_file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.config import CleanParams

REQUIRED = ("mmsi", "ts", "lat", "lon", "sog", "heading", "status")
TRACK = ("source_file", "mmsi")


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def parsed_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Text to UTC timestamps, whatever the session's zone; text with a zone of its own keeps it, what can't be parsed is null."""
    text = F.trim(F.col(column).cast("string"))
    return df.withColumn(column, F.coalesce(F.try_to_timestamp(F.concat(text, F.lit("Z"))), F.try_to_timestamp(text)))


def clean(df: DataFrame, p: CleanParams) -> DataFrame:
    """No null in a required column, nine-digit ids, four inclusive ranges."""
    kept = require(df).na.drop(subset=list(REQUIRED))
    ranges = F.col("lat").between(*p.lat) & F.col("lon").between(*p.lon) & F.col("sog").between(*p.sog) & F.col("heading").between(*p.heading)
    return kept.where(F.col("mmsi").cast("long").cast("string").rlike("^[0-9]{9}$") & ranges)


def last_of_duplicates(df: DataFrame) -> DataFrame:
    """Of rows with one track and time the last of the input stays."""
    order = Window.partitionBy(*TRACK, "ts").orderBy(F.desc("ordinal"))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def segments(df: DataFrame, max_gap_s: int) -> DataFrame:
    """segment: a new one starts after a gap of strictly more than max_gap_s."""
    track = Window.partitionBy(*TRACK).orderBy("ts")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(track)
    return df.withColumn("_new", F.when(gap > max_gap_s * 1_000_000, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(track)).drop("_new")


#: Grid points that one task fills; longer segments are cut into blocks of so many.
BLOCK_POINTS = 1 << 16
_POSITION, _MEASURED = ("lon", "lat"), ("sog", "heading")
_FILLED = (*_POSITION, *_MEASURED, "status")


def _known(rows: DataFrame, key: list[str], rolling: tuple[int, int]) -> DataFrame:
    """Of each row of a key the last values known up to it, <column>_a, and the first from it on, <column>_b. Positions come with their
    times; speed and heading are known where the rolling mean is. Looking ahead is looking back in the other order: frames that
    only grow cost one step a row."""
    order = Window.partitionBy(*key).orderBy("ts")
    back, ahead = (o.rowsBetween(Window.unboundedPreceding, 0) for o in (order, Window.partitionBy(*key).orderBy(F.desc("ts"))))
    around = order.rowsBetween(-rolling[0], rolling[1])
    timed = {c: F.when(F.col(c).isNotNull(), F.struct(F.unix_micros("ts").alias("t"), F.col(c).alias("x"))) for c in _POSITION}
    filled = lambda c, w: F.last(c, ignorenulls=True).over(w)
    smooth = rows.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(around)) for c in _MEASURED} | {f"_{c}_a": filled(k, back) for c, k in timed.items()} | {"_status_a": filled("status", back)})
    held = smooth.withColumns({f"_{c}_a": filled(c, back) for c in _MEASURED})
    return held.withColumns({f"_{c}_b": filled(timed.get(c, F.col(c)), ahead) for c in _FILLED})


def _interpolated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Positions linear between the known ones and then held, the rest from before, else from after; rows that stay empty go."""
    now = F.unix_micros("ts")

    def linear(c: str):
        a, b = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        return F.coalesce(F.col(c), a["x"] + (b["x"] - a["x"]) * ((now - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0))), a["x"]).alias(c)

    rest = [F.coalesce(f"_{c}_a", f"_{c}_b").alias(c) for c in (*_MEASURED, "status")]
    return rows.select(*key, "ts", *map(linear, _POSITION), *rest).na.drop(subset=[*_POSITION, *_MEASURED])


def _in_blocks(bounds: DataFrame, own: DataFrame, key: list[str], step: int, rolling: tuple[int, int], points: int) -> DataFrame:
    """Long segments: each block of grid points is filled by a task of its own, with copies of the rows beside it for the rolling
    mean. What a block has not seen itself comes from the blocks around, which tell their last and first known values in a row each."""
    numbers = F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / points))
    parts = bounds.select(*key, "lo", "top", F.explode(numbers).alias("_part"))
    places = F.sequence(F.col("_part") * points, F.least(F.col("top"), F.col("_part") * points + points - 1))
    grid = parts.select(*key, F.explode(places).alias("_i"), "lo").select(*key, "_i", F.timestamp_micros(F.unix_micros("lo") + F.col("_i") * step).alias("ts"))
    beside = F.sequence(F.greatest(F.floor((F.col("_i") - rolling[1]) / points), F.lit(0)), F.floor((F.col("_i") + rolling[0]) / points))
    block = [*key, "block"]
    rows = grid.join(own, [*key, "ts"], "left").withColumn("block", F.explode(beside)).repartition(*block)
    rows = _known(rows, block, rolling).where(F.floor(F.col("_i") / points) == F.col("block"))
    path = Window.partitionBy(*key)
    told = lambda way, c: F.last(c, ignorenulls=True).over(path.orderBy(way).rowsBetween(Window.unboundedPreceding, 0))
    ends, starts = rows.where(F.col("_i") % points == points - 1), rows.where((F.col("_i") % points == 0) & (F.col("_i") > 0))
    before = ends.select(*key, (F.col("block") + 1).alias("block"), *[told(F.col("block"), f"_{c}_a").alias(f"_{c}_c") for c in _FILLED])
    after = starts.select(*key, (F.col("block") - 1).alias("block"), *[told(F.desc("block"), f"_{c}_b").alias(f"_{c}_d") for c in _FILLED])
    both = rows.join(before, block, "left").join(after, block, "left")
    return both.withColumns({f"_{c}_a": F.coalesce(f"_{c}_a", f"_{c}_c") for c in _FILLED} | {f"_{c}_b": F.coalesce(f"_{c}_b", f"_{c}_d") for c in _FILLED})


def on_grid(df: DataFrame, step_s: int, rolling: int = 5, points: int = BLOCK_POINTS) -> DataFrame:
    """Segments of two rows or more on a regular grid from their first time: positions linear in time and then held, speed and
    heading by a centred rolling mean and then forward and backward fill, rows that stay empty dropped. Segments of more than
    `points` grid points are filled in blocks, with the same result."""
    key, step = [*TRACK, "segment"], step_s * 1_000_000
    around = (rolling - 1 - (rolling - 1) // 2, (rolling - 1) // 2)
    bounds = df.groupBy(*key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).where("n >= 2")
    bounds = bounds.withColumn("top", F.floor((F.unix_micros("hi") - F.unix_micros("lo")) / step))
    own = df.select(*key, "ts", *_FILLED)
    short = bounds.where(F.col("top") < points).select(*key, F.explode(F.sequence("lo", "hi", F.make_dt_interval(secs=F.lit(step_s)))).alias("ts"))
    whole = _interpolated(_known(short.join(own, [*key, "ts"], "left"), key, around), key)
    return whole.unionByName(_interpolated(_in_blocks(bounds.where(F.col("top") >= points), own, key, step, around, points), key))


def resample(df: DataFrame, step_s: int, max_gap_s: int, rolling: int = 5, points: int = BLOCK_POINTS) -> DataFrame:
    return on_grid(segments(last_of_duplicates(df), max_gap_s), step_s, rolling, points)


def shared_times(df: DataFrame, k: int) -> DataFrame:
    """Rows at times when at least k distinct entities of the file are present."""
    busy = df.groupBy("source_file", "ts").agg(F.count_distinct("mmsi").alias("n")).where(F.col("n") >= k)
    return df.join(busy.select("source_file", "ts"), ["source_file", "ts"], "left_semi")
