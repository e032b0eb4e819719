"""Readers, sinks, jobs and the operators' edge cases on small files and rows."""

from __future__ import annotations

import datetime
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from wakeline.config import CleanParams, job_preset
from wakeline.operators import frames, profile, scores, tracks, windows
from wakeline.plans import jobs
from wakeline.sources import archives, readers, sinks

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,Heading,Status,Extra"
ROWS = ["367000001,2021-12-01T00:00:03,30,-118.5,1.5,10,0,x", "36700000,2021-12-01T00:00:03,30,-118,1.5,10,0,x", "367000002,bad,30,-118,1.5,10,0,x", "367000003,2021-12-01T00:00:04,oops,-118,,10,0,x"]


def csv(path, rows, head=HEAD):
    path.write_text("\n".join([head, *rows]) + "\n")
    return str(path)


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in members.items():
            z.writestr(name, "\n".join([HEAD, *rows]) + "\n")


def track(spark, rows, file="f"):
    """rows: minute, lon, sog."""
    t0 = datetime.datetime(2021, 12, 1)
    data = [(file, 367000001, t0 + datetime.timedelta(minutes=m), float(x), 0.0, s, 1.0, "0", i) for i, (m, x, s) in enumerate(rows)]
    return spark.createDataFrame(data, "source_file string, mmsi long, ts timestamp, lon double, lat double, sog double, heading double, status string, ordinal long")


def test_reports_csv(spark, tmp_path):
    got = readers.reports_csv(spark, csv(tmp_path / "a.csv", ROWS)).orderBy("ordinal").collect()
    assert [r["mmsi"] for r in got] == [367000001, 36700000, 367000002, 367000003]
    assert got[0]["ts"] == datetime.datetime(2021, 12, 1, 0, 0, 3) and got[2]["ts"] is None
    assert got[3]["lat"] is None and got[3]["sog"] is None
    with pytest.raises(ValueError, match="LON"):
        readers.reports_csv(spark, csv(tmp_path / "b.csv", [], HEAD.replace("LON", "X")))


def test_columns_of_any_order(spark, tmp_path):
    """Each file is read by its own header, whatever the others' order is; what is missing is null in text columns, too."""
    csv(tmp_path / "a.csv", ["367000001,2021-12-01T00:00:03,30,-118.5,1.5,10,NA,x"])
    csv(tmp_path / "b.csv", ["x,-118.5,30,2021-12-01T00:00:03,0,n/a,10,367000002"], "Extra,LON,LAT,BaseDateTime,Status,SOG,Heading,MMSI")
    (tmp_path / "c.csv").write_bytes('\ufeff"LAT",MMSI,BaseDateTime,LON,SOG,Heading,Status,LAT\r\n30,367000003,2021-12-01T00:00:03,-118.5,1.5,10,,99\r\n'.encode())
    got = {r["mmsi"]: r for r in readers.reports_csv(spark, str(tmp_path)).collect()}
    assert sorted(got) == [367000001, 367000002, 367000003]
    assert {(r["lat"], r["lon"], r["heading"]) for r in got.values()} == {(30.0, -118.5, 10.0)}
    assert [got[m]["status"] for m in sorted(got)] == [None, "0", None] and got[367000002]["sog"] is None
    csv(tmp_path / "d.csv", [], HEAD.replace("SOG", "speed"))
    with pytest.raises(ValueError, match="SOG in .*d.csv"):
        readers.reports_csv(spark, str(tmp_path))
    (tmp_path / "d.csv").write_text("")
    with pytest.raises(ValueError, match="no header in .*d.csv"):
        readers.reports_csv(spark, str(tmp_path))


def test_frames_of_any_order(spark, tmp_path):
    csv(tmp_path / "a.csv", ["7,367000002,1.5,2,3,4"], "frame_id,vessel_id,LON,LAT,SOG,Heading")
    csv(tmp_path / "b.csv", ["367000002,7,2,1.5,3,4,z"], "vessel_id,frame_id,LAT,LON,SOG,Heading,more")
    got = readers.frames_csv(spark, str(tmp_path)).drop("source_file").collect()
    assert [tuple(r) for r in got] == [(7, 367000002, 1.5, 2.0, 3.0, 4.0)] * 2
    csv(tmp_path / "c.csv", ["1,2,x,2,3,4"], "frame_id,vessel_id,LON,LAT,SOG,Heading")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.frames_csv(spark, str(tmp_path)).collect()
    csv(tmp_path / "c.csv", [], "frame_id,vessel_id,LON,LAT,SOG")
    with pytest.raises(ValueError, match="Heading in .*c.csv"):
        readers.frames_csv(spark, str(tmp_path))


def test_rows_of_each_file(spark, tmp_path):
    for name in "ab":
        csv(tmp_path / f"{name}.csv", ROWS)
    got = readers.reports_csv(spark, f"{tmp_path}/*.csv", nrows=2).groupBy("source_file").count().collect()
    assert [r["count"] for r in got] == [2, 2]


def test_reports_zip(spark, tmp_path):
    archive(tmp_path / "AIS_2021_12_01.ZIP", {"readme.txt": [], "one.CSV": ROWS, "two.csv": ROWS[:1]})
    archive(tmp_path / "other.zip", {"one.csv": ROWS})
    got = readers.reports_zip(spark, str(tmp_path))
    assert sorted(r["ordinal"] for r in got.collect()) == [0, 1, 2, 3]
    assert [r["lat"] for r in got.orderBy("ordinal").collect()] == [30.0, 30.0, 30.0, None]
    assert readers.reports_zip(spark, str(tmp_path), inner="two.csv").count() == 1
    assert readers.reports_zip(spark, str(tmp_path), nrows=3).count() == 3
    archive(tmp_path / "AIS_2021_12_02.zip", {"readme.txt": []})
    with pytest.raises(Exception, match="no CSV member"):
        readers.reports_zip(spark, str(tmp_path)).collect()


def test_zip_in_pieces(spark, tmp_path, monkeypatch):
    """A member of many pieces keeps its order; both readers agree on what is missing."""
    rows = [f"{367000000 + i % 90},2021-12-01T00:00:{i % 60:02},{30 + i % 5},-118,{'NA' if i % 7 == 0 else 1.5},10,{'NA' if i % 11 == 0 else 0},x" for i in range(120_000)]
    archive(tmp_path / "AIS_2021_12_01.zip", {"a.csv": rows})
    got = readers.reports_zip(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 1
    csv(tmp_path / "a.csv", rows)
    plain = readers.reports_csv(spark, f"{tmp_path}/a.csv")
    assert got.orderBy("ordinal").select("ordinal").limit(3).collect() == [(0,), (1,), (2,)]
    columns = ["mmsi", "ts", "lat", "sog", "status"]
    assert got.groupBy(*columns).count().exceptAll(plain.groupBy(*columns).count()).count() == 0
    assert got.agg(F.max("ordinal"), F.count("*"), F.count("sog"), F.count("status")).first() == (119_999, 120_000, 120_000 - 17_143, 120_000 - 10_910)
    batches = archives.ReportsZipReader({"path": str(tmp_path)}).read(archives.Archive(f"{tmp_path}/AIS_2021_12_01.zip"))
    assert [b.num_rows for b in batches] == [50_000, 50_000, 20_000]
    assert readers.reports_zip(spark, f"file:{tmp_path}/AIS_2021_12_01.zip", nrows=5).count() == 5
    with pytest.raises(Exception, match="nowhere"):
        readers.reports_zip(spark, f"{tmp_path}/nowhere").collect()


def cut(path, split):
    """All parts of a document, as tasks read them."""
    reader = archives.TrajectoriesReader({"path": str(path), "split": split})
    return [(b.column(1)[i].as_py(), b.column(2)[i].as_py()) for p in reader.partitions() for b in reader.read(p) for i in range(b.num_rows)]


def test_trajectories_cut_anywhere(tmp_path, monkeypatch):
    path = tmp_path / "t.json"
    rng = random.Random(5)
    for trial in range(40):
        monkeypatch.setattr(archives, "READ_BYTES", rng.choice([1, 2, 7, 64, 1000]))
        whole = [[[rng.choice([1, -2.5, 3e10, None]) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 6))]
        text = json.dumps(whole, separators=rng.choice([(",", ":"), (", ", ":"), (" ,\n  ", ":")])).replace("[", rng.choice(["[", "[ ", "[" + " " * 90]))
        path.write_text(text + rng.choice(["", "\n"]))
        for split in (3, 17, 101, 1 << 20):
            assert [t for _, t in cut(path, split)] == [t for t in whole if t], (trial, split, text)


@pytest.mark.parametrize("text", ["", "{}", "[", "[[[1]]", "[[[1]],]", "[[[1]] [[2]]]", "[[[1]]]x", "[[[1,]]]", "[[[1]],5]", "[[[1]],[2]]", '[[["a"]]]', "[[[1]],[[[2]]]]", "[[],[[1]],[]", "[[[1],[2]"])
def test_malformed_trajectories(tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(ValueError, match="t.json"):
        cut(tmp_path / "t.json", 1 << 20)


def test_large_document(spark, tmp_path):
    """One document gives many rows on many tasks."""
    one = [[600_000.0 * i, 1.0, 2.0, 3.0, 4.0, 0, 0, 0, 0, 0, 0, 0, 7] for i in range(50)]
    (tmp_path / "t.json").write_text(json.dumps([one] * 400 + [[]]))
    rows = readers.trajectories_json(spark, str(tmp_path), split=100_000)
    assert rows.rdd.getNumPartitions() > 5 and rows.count() == 400
    assert frames.flattened(rows).groupBy("frame_id").count().where("count = 400").count() == 50
    (tmp_path / "u.json").write_text("[[[1, 2]")
    with pytest.raises(Exception, match="u.json"):
        readers.trajectories_json(spark, str(tmp_path)).collect()


def test_utc_whatever_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([("2021-12-01T00:00:00",), ("2021-12-01T00:00:00+01:00",), ("no",), (None,)], "ts string")
        assert [r[0] for r in tracks.parsed_time(df).select(F.unix_seconds("ts")).collect()] == [1638316800, 1638313200, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clean_bounds(spark):
    p = CleanParams(lat=(30.0, 35.0), lon=(-120.0, -115.0), sog=(1.0, 22.0))
    row = (367000001, datetime.datetime(2021, 12, 1), 30.0, -120.0, 22.0, 360.0, "0")
    rows = [row, *[tuple(None if i == k else x for i, x in enumerate(row)) for k in range(7)], (36700000, *row[1:]), (*row[:2], 29.999, *row[3:]), (*row[:2], float("nan"), *row[3:])]
    df = spark.createDataFrame(rows, "mmsi long, ts timestamp, lat double, lon double, sog double, heading double, status string")
    assert tracks.clean(df, p).count() == 1
    assert tracks.clean(df.limit(0), p).count() == 0
    with pytest.raises(ValueError, match="sog"):
        tracks.clean(df.drop("sog"), p)


def test_resample_by_hand(spark):
    df = track(spark, [(0, 0, 1.0), (4, 4, 2.0), (10, 10, 3.0), (17, 17, 4.0), (25, 25, 5.0), (33, 33, 6.0)])
    got = tracks.resample(df, 600, 600).orderBy("ts").select("lon", "sog").collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0), (10.0, 3.0), (10.0, 2.0), (10.0, 3.0)]
    assert tracks.resample(track(spark, [(0, 0, 1.0)]), 600, 600).count() == 0
    assert tracks.resample(track(spark, [(0, 0, 1.0), (3, 1, 1.0)]), 600, 600).count() == 1
    gap = tracks.segments(track(spark, [(0, 0, 1.0), (10, 1, 1.0), (20.02, 2, 1.0)]), 600)
    assert [r["segment"] for r in gap.orderBy("ts").collect()] == [0, 0, 1]


def test_resample_nulls(spark):
    """A null first position has no earlier one to hold, so its row goes; speeds are filled forward, then backward."""
    df = track(spark, [(0, 0, None), (10, 10, None), (20, 20, None), (30, 30, 7.0), (40, 40, None)]).withColumn("lon", F.when(F.col("ordinal") > 0, F.col("lon")))
    assert [(r["lon"], r["sog"]) for r in tracks.resample(df, 600, 600).orderBy("ts").collect()] == [(10.0, 7.0), (20.0, 7.0), (30.0, 7.0), (40.0, 7.0)]
    last = tracks.last_of_duplicates(track(spark, [(0, 1, 1.0), (0, 2, 2.0)])).collect()
    assert [r["lon"] for r in last] == [2.0]


def test_long_segment_is_linear(spark):
    df = spark.range(60_000).select(F.lit("f").alias("source_file"), F.lit(367000001).cast("long").alias("mmsi"), F.timestamp_seconds(F.col("id") * 120).alias("ts"), *[F.col("id").cast("double").alias(c) for c in ("lon", "lat", "sog", "heading")], F.lit("0").alias("status"), F.col("id").alias("ordinal"))
    assert tracks.resample(df, 60, 600).where("abs(lon - unix_seconds(ts) / 120.0) < 1e-6").count() == 119_999


def test_statistics_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 1.0), (1.0, 4.0, None, 3.0)], "lon double, lat double, sog double, heading double")
    got = frames.statistics(df).first()
    assert (got["lon_std"], got["sog_std"]) == (1.0, 1.0) and abs(got["lat_std"] - 2**0.5) < 1e-12
    assert frames.statistics(df.limit(1)).first()["lat_std"] == 1.0


def test_names_and_frames(spark):
    names = [("x/AIS_2021_12_09.zip",), ("in/AIS_2021_12_31.zip.bak",), ("AIS_2021_12_1.zip",), ("other",)]
    df = spark.createDataFrame(names, "n string").select(frames.day_of_name(F.col("n")).alias("d"), frames.date_of_name(F.col("n")).alias("s"))
    assert [tuple(r) for r in df.collect()] == [(9, "2021_12_09"), (31, "2021_12_31"), (None, None), (None, None)]
    f = frames.frame_format(track(spark, [(0, 0, 1.0), (0.5, 0, 1.0), (1.5, 0, 1.0), (2.5, 0, 1.0)]))
    assert sorted(r["frame_id"] for r in f.collect()) == [0, 0, 2, 2]


def window_rows(spark, rows):
    return spark.createDataFrame([(f, i, v, float(i), 0.0, 0.0, 0.0) for f, i, v in rows], "source_file string, frame_id int, vessel_id long, lon double, lat double, sog double, heading double")


def test_windows_holes_duplicates_skip(spark):
    rows = [("a", i, v) for i in range(6) for v in (1, 2)] + [("b", i, 1) for i in range(4)]
    rows = [r for r in rows if r != ("a", 4, 2)] + [("a", 5, 2)]  # a hole at 4, a frame twice: the count of three still fits
    found = windows.members(windows.frame_index(window_rows(spark, rows)), 3)
    assert sorted((r["source_file"], r["start"], r["vessel_id"]) for r in found.collect()) == [("a", 0, 1), ("a", 0, 2), ("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 3, 1), ("a", 3, 2), ("b", 0, 1), ("b", 1, 1)]
    every = windows.windows(windows.frame_index(window_rows(spark, rows)), 3, skip=2)
    assert sorted({(r["source_file"], r["start"]) for r in every.collect()}) == [("a", 0)]
    numbers = windows.numbered(found).select("source_file", "start", "window").distinct().collect()
    assert sorted((r["window"], r["source_file"], r["start"]) for r in numbers) == [(0, "a", 0), (1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 0), (5, "b", 1)]
    order = [tuple(r)[:3] for r in windows.shuffled(found, 3).collect()]
    assert order == [tuple(r)[:3] for r in windows.shuffled(found.repartition(5), 3).collect()]
    n = windows.nodes(found).where("source_file = 'a' and start = 0").orderBy("step").collect()
    assert [r["nodes"] for r in n] == [[[0.0] * 4] * 2, [[1.0, 0.0, 0.0, 0.0]] * 2, [[1.0, 0.0, 0.0, 0.0]] * 2]
    with pytest.raises(ValueError):
        windows.residual_matrix(3)


def test_frame_tables(spark, tmp_path):
    head = "frame_id,vessel_id,LON,LAT,SOG,Heading"
    for split in readers.SPLITS:
        (tmp_path / split).mkdir()
        csv(tmp_path / split / "day_1.CSV", ["0,367000001,1.5,2,3,4", "0,367000010,1.5,2,3,4"], head)
        csv(tmp_path / split / "notes.txt", ["0,1,1,2,3,4"], head)
    got = readers.split_frames_csv(spark, str(tmp_path))
    assert got.groupBy("split").count().orderBy("split").collect() == [("test", 2), ("train", 2), ("val", 2)]
    assert readers.split_frames_csv(spark, str(tmp_path), names="day_*.CSV").count() == 6
    assert dict(got.dtypes)["lon"] == "float" and got.select("vessel_id").distinct().count() == 2
    assert readers.frames_csv(spark, f"{tmp_path}/train", compat_float_ids=True).select("vessel_id").distinct().count() == 1
    with pytest.raises(ValueError, match="no frame tables"):
        readers.frames_csv(spark, f"{tmp_path}/train", names="*.none")
    (tmp_path / "bare").mkdir()
    csv(tmp_path / "bare" / "a.csv", [], head)
    assert readers.frames_csv(spark, f"{tmp_path}/bare").count() == 0
    sinks.frames_csv(got, f"{tmp_path}/out")
    assert readers.frames_csv(spark, f"{tmp_path}/out").count() == 6


def test_trajectories_to_frames(spark, tmp_path):
    point = lambda ms, lon, mmsi: [ms, 1.0, lon, 3.0, 4.0, 0, 0, 0, 0, 0, 0, 0, mmsi]
    (tmp_path / "t.json").write_text(json.dumps([[point(600_000, 1.0, 7), point(599_999, 2.0, 8)], []]))
    got = frames.flattened(readers.trajectories_json(spark, f"{tmp_path}/t.json")).orderBy("frame_id").collect()
    assert [(r["frame_id"], r["vessel_id"], r["lon"]) for r in got] == [(0, 7, 2.0), (1, 7, 1.0)]
    assert all(r["source_file"].endswith("t.json") for r in got)
    jobs.trajectories_to_frames(spark, f"{tmp_path}/t.json", f"{tmp_path}/out")
    assert [(r["frame_id"], r["vessel_id"]) for r in readers.frames_csv(spark, f"{tmp_path}/out/frames").orderBy("frame_id").collect()] == [(0, 7), (1, 7)]
    assert round(readers.stats_json(spark, f"{tmp_path}/out/stats/*.json").first()["lon_std"], 5) == 72.60811
    ranges = profile.expected_ranges(readers.stats_json(spark, f"{tmp_path}/out/stats/*.json")).collect()
    assert all(r["mean_ok"] and r["std_ok"] for r in ranges) and len(ranges) == 4


def test_reports_to_frames(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    for day in (1, 26):
        rows = [f"{367000001 + v},2021-12-{day:02}T00:{10 * m:02}:00,{30 + v + m * 0.01 * (1 + day)},-118,{2 + m},90,0,x" for v in range(2) for m in range(4)]
        archive(src / f"AIS_2021_12_{day:02}.zip", {"a.csv": rows})
    archive(src / "AIS_notes.zip", {"a.csv": ROWS})
    jobs.reports_to_frames(spark, str(src), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/frames")
    assert sorted((r["split"], r["date_str"], r["count"]) for r in got.groupBy("split", "date_str").count().collect()) == [("train", "2021_12_01", 8), ("val", "2021_12_26", 8)]
    assert sorted({r["frame_id"] for r in got.collect()}) == [0, 10, 20, 30]
    train = got.where("split = 'train'").agg(F.avg("LAT"), F.stddev_samp("LAT"), F.max("LON")).first()
    assert abs(train[0]) < 1e-9 and abs(train[1] - 1) < 1e-9 and abs(train[2]) < 1e-9
    assert spark.read.json(f"{tmp_path}/out/stats_by_day").count() == 2
    assert job_preset("northeastern").lat == (41.0, 46.0)
    frame, stats = jobs.frame_table(tracks.parsed_time(readers.reports_zip(spark, str(src))), job_preset(), zscore=False)
    assert stats is None and frame.count() == 16


def test_statistics_and_metrics_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"LON": {"mean": 1, "std": 2}, "LAT": {"mean": 1, "std": 2}, "SOG": {"mean": 1, "std": 2}, "Heading": {"mean": 1, "std": 2}, "_note": "n"}))
    assert readers.stats_json(spark, f"{tmp_path}/s.json").first()["heading_std"] == 2.0
    one = spark.createDataFrame([(1.0, 2.0)], "ade double, fde double")
    for _ in range(2):
        sinks.metrics(one, f"{tmp_path}/m", "a")
    sinks.metrics(one, f"{tmp_path}/m", "b")
    assert spark.read.json(f"{tmp_path}/m").count() == 2


def test_score_edges(spark):
    df = spark.createDataFrame([(1.0, -1.0), (-1.0, 1.0), (2.0, 2.0), (3.0, 1.0), (1.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(scores.closer_to_zero(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False]
    nll = scores.gaussian_nll(*[F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, -20.0, -20.0, 30.0)])
    assert abs(spark.range(1).select(nll).first()[0] + math.log(1 / (2 * math.pi * 1e-9))) < 1e-6
    rows = [(f, 0, v, s, float(v), float(v)) for f, vs in (("a", (1,)), ("b", (2, 3))) for v in vs for s in (1, 2, 3)]
    dist = spark.createDataFrame([r[:5] for r in rows], "source_file string, window int, vessel_id long, step int, distance double")
    got = scores.ade_fde(dist, 3).first()
    assert (got["ade"], got["windows"]) == (1.75, 2)  # windows of one number in two files stay apart; means of means
    assert [r["distance"] for r in scores.by_step(dist).orderBy("step").collect()][3:] == [None, None]
