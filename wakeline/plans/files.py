"""Registered queries of the sources: files are written from the events to the shared folder and read back, with DuckDB SQL."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import frames
from wakeline.plans.tracks import _REPORTS, NUM, reports
from wakeline.sources import archives, readers
from wakeline.sources.scratch import shared_folder

#: Column orders of the files; the second has a column more.
ORDERS = (("MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading", "Status"), ("Status", "note", "Heading", "SOG", "LON", "LAT", "BaseDateTime", "MMSI"))
MISSING_EVERY = 7


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports under the names of raw files; every seventh has no status."""
    r = reports(spark, sf_dir, "second")
    status = F.when(F.col("ordinal") % MISSING_EVERY == 0, "NA").otherwise(F.col("status"))
    return r.select(F.col("mmsi").alias("MMSI"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("BaseDateTime"), F.col("lat").alias("LAT"), F.col("lon").alias("LON"), F.col("sog").alias("SOG"), F.col("heading").alias("Heading"), status.alias("Status"), F.lit("x").alias("note"), "ordinal")


def header_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two column orders in one folder each, read together."""
    folder = shared_folder(spark, "reports")
    for i, order in enumerate(ORDERS):
        _texts(spark, sf_dir).where(F.col("ordinal") % 2 == i).select(*order).write.option("header", True).csv(f"{folder}/{i}")
    got = readers.reports_csv(spark, [f"{folder}/{i}" for i in range(len(ORDERS))])
    return got.select("mmsi", "ts", *[F.round(c, 6).alias(c) for c in NUM], "status")


def zipped_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each day, read back in the order of its rows."""
    folder = shared_folder(spark, "archives")
    columns = list(ORDERS[0])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by day: each day's member is written while it comes."""
        day, stack, member = None, [], None
        for batch in batches:
            for name, rows in batch.groupby("day", sort=False):
                if name != day:
                    while stack:
                        stack.pop().close()
                    system, inner = archives.opened(f"{folder}/AIS_{name}.zip")
                    file = system.open_output_stream(inner)
                    archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                    member = io.TextIOWrapper(archive.open(f"{name}.csv", "w", force_zip64=True), "utf-8", newline="")
                    stack, day = [file, archive, member], name
                    rows[columns].head(0).to_csv(member, index=False)
                rows[columns].to_csv(member, index=False, header=False)
            yield pd.DataFrame({"n": [len(batch)]})
        while stack:
            stack.pop().close()

    rows = _texts(spark, sf_dir).withColumn("day", F.translate(F.substring("BaseDateTime", 1, 10), "-", "_"))
    rows.repartition("day").sortWithinPartitions("day", "ordinal").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    got = readers.reports_zip(spark, folder)
    return got.select(frames.date_of_name(F.col("source_file")).alias("day"), "ordinal", "mmsi", "ts", F.round("lon", 6).alias("lon"), "status")


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of two points, one for each event, and empty ones, as documents that are cut while they are read."""
    folder = shared_folder(spark, "documents")
    r = reports(spark, sf_dir, "microsecond").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"), "lat", "lon", "mmsi")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        for batch in batches:
            one = lambda ms, lat, lon, mmsi: [ms, lat, lon, 1.0, 2.0, *[0] * 7, mmsi]
            yield pd.DataFrame({"value": [json.dumps([one(*x), one(x[0] + 600_000, *x[1:])]) + "," for x in batch.itertuples(index=False)]})
        yield pd.DataFrame({"value": ["[]]"]})

    r.mapInPandas(lines, "value string").write.mode("overwrite").text(folder)
    got = frames.flattened(readers.trajectories_json(spark, folder, names="*.txt", split=1 << 18))
    return got.select("frame_id", "vessel_id", F.round("lon", 6).alias("lon"), "lat")


_SECONDS = _REPORTS.format(unit="second")
_STATUS = f"case when ordinal % {MISSING_EVERY} <> 0 then status end status"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "header_reports": (header_reports, f"with {_SECONDS} select mmsi, ts, {', '.join(f'round({c}, 6) {c}' for c in NUM)}, {_STATUS} from a"),
    "zipped_reports": (zipped_reports, f"with {_SECONDS} select strftime(ts, '%Y_%m_%d') as day, row_number() over (partition by ts::date order by ordinal) - 1 ordinal, mmsi, ts, round(lon, 6) lon, {_STATUS} from a"),
    "nested_documents": (nested_documents, "select (floor(epoch_us(ts) // 1000 / 600000) + k)::int frame_id, 100000000 + user_id vessel_id, round(value, 6) lon, json_extract(props, '$.k')::int::double lat from events, range(2) n(k)"),
}
