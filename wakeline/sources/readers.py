"""Sources: delimited and zipped reports, frame tables, nested trajectories, statistics. Schemas are declared, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.operators.tracks import parsed_time
from wakeline.sources import archives
from wakeline.sources.headers import NoFiles, by_name

RAW = "MMSI long, BaseDateTime string, LAT double, LON double, SOG double, Heading double, Status string"
FRAMES = "frame_id int, vessel_id long, LON double, LAT double, SOG double, Heading double"
SPLITS = ("train", "val", "test")
_NAMES = {"MMSI": "mmsi", "BaseDateTime": "ts", "LAT": "lat", "LON": "lon", "SOG": "sog", "Heading": "heading", "Status": "status"}


def _reports(raw: DataFrame, nrows: int | None) -> DataFrame:
    """Text columns to typed ones; what can't be read is null. nrows: the first rows of each file."""
    kinds = dict(x.split() for x in RAW.split(", "))
    named = parsed_time(raw.select(*[F.col(a).try_cast(kinds[a]).alias(b) for a, b in _NAMES.items()], "source_file", "ordinal"))
    if nrows is None:
        return named
    order = Window.partitionBy("source_file").orderBy("ordinal")
    return named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= nrows).drop("_n")


def reports_csv(spark: SparkSession, path: str | list[str], nrows: int | None = None) -> DataFrame:
    """Plain CSV reports, each file by its own header; columns beyond the required ones are tolerated."""
    return _reports(by_name(spark, path, tuple(_NAMES)), nrows)


def reports_zip(spark: SparkSession, path: str, inner: str | None = None, nrows: int | None = None, names: str = "AIS_*.[zZ][iI][pP]") -> DataFrame:
    """Zip archives: the member named, else the first that ends in .csv; ValueError if there is none. See sources/archives.py."""
    archives.register(spark)
    told = {"names": names} | ({"inner": inner} if inner else {}) | ({"nrows": nrows} if nrows is not None else {})
    return _reports(spark.read.format("reports_zip").options(**told).load(path), None)


def frames_csv(spark: SparkSession, path: str, names: str = "*.[cC][sS][vV]", compat_float_ids: bool = False) -> DataFrame:
    """Frame tables of a folder, each file by its own header, measurements in single precision; a folder without such files, a file
    that lacks a column and a field that is no number are errors.

    compat_float_ids: ids in single precision, too, in which some ids of nine digits fall together.
    """
    kinds = dict(x.split() for x in FRAMES.split(", "))
    try:
        df = by_name(spark, path, tuple(kinds), names)
    except NoFiles as none:
        raise ValueError(f"no frame tables under {path}") from none
    number = lambda c: F.col(c).cast("double").cast(kinds[c])
    vessel = F.col("vessel_id").cast("float").cast("long") if compat_float_ids else F.coalesce(F.col("vessel_id").try_cast("long"), number("vessel_id"))
    return df.select("source_file", number("frame_id").alias("frame_id"), vessel.alias("vessel_id"), *[F.col(c).cast("float").alias(c.lower()) for c in ("LON", "LAT", "SOG", "Heading")])


def split_frames_csv(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS, names: str = "*.[cC][sS][vV]") -> DataFrame:
    """The frame tables of every split's folder, with a column split. names="day_*.csv" takes daily files alone."""
    return reduce(DataFrame.unionByName, [frames_csv(spark, f"{root}/{s}", names).withColumn("split", F.lit(s)) for s in splits])


def trajectories_json(spark: SparkSession, path: str, names: str = "*.json", split: int = archives.SPLIT_BYTES) -> DataFrame:
    """A row for each trajectory of nested documents, cut while they are read; trajectories is an array of that one. Malformed
    documents are errors. See sources/archives.py."""
    archives.register(spark)
    rows = spark.read.format("nested_trajectories").options(names=names, split=split).load(path)
    return rows.select("source_file", "position", F.array("trajectory").alias("trajectories"))


def stats_json(spark: SparkSession, path: str) -> DataFrame:
    """One row of <column>_mean and <column>_std; entries that are no objects, such as notes, are passed over."""
    one = "struct<mean:double,std:double>"
    s = spark.read.text(path, wholetext=True).select(F.from_json("value", f"LON {one}, LAT {one}, SOG {one}, Heading {one}").alias("s"))
    return s.select(*[F.col(f"s.{c}.{k}").alias(f"{c.lower()}_{k}") for c in ("LON", "LAT", "SOG", "Heading") for k in ("mean", "std")])
