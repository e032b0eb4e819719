"""Interactions, mergeable statistics, runs, draws, long segments, spans of windows and the evaluation job, on small rows."""

from __future__ import annotations

import math
import time
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.config import EvaluationParams, WindowParams
from wakeline.operators import frames, interactions, moments, scores, tracks, windows
from wakeline.plans import graphs, jobs
from wakeline.sources import runs, sinks

FRAME = ["source_file", "step"]


def nodes(spark, rows):
    return spark.createDataFrame(rows, "source_file string, step int, vessel_id long, query array<double>, key array<double>, x double")


def test_pairs_of_crowded_frames(spark, monkeypatch):
    """Every ordered pair once, however many tasks a frame is dealt over; frames of one name in two files stay apart."""
    rows = [(f, 0, v, [1.0], [float(v)], 1.0) for f, n in (("a", 9), ("b", 1), ("c", 3)) for v in range(n)]
    for most in (512, 2):
        monkeypatch.setattr(interactions, "TASK_ENTITIES", most)
        got = interactions.pairs(nodes(spark, rows), ("x",), FRAME).select("source_file", "vessel_id", "other").collect()
        assert sorted(tuple(r) for r in got) == sorted((f, a, b) for f, n in (("a", 9), ("b", 1), ("c", 3)) for a in range(n) for b in range(n))
    assert interactions.pairs(nodes(spark, []), ("x",), FRAME).count() == 0


def test_attention_equals_numpy(spark):
    rng = np.random.default_rng(1)
    q, k, x = rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), rng.normal(size=5)
    n = nodes(spark, [("a", 0, v, q[v].tolist(), k[v].tolist(), float(x[v])) for v in range(5)])
    s = interactions.attention_scores(n, 4, 2, FRAME)
    by = ["source_file", "step", "head", "vessel_id"]
    soft = {(r["head"], r["vessel_id"], r["other"]): r["weight"] for r in interactions.softmax(s, by).collect()}
    zero = {(r["head"], r["vessel_id"], r["other"]): r["weight"] for r in interactions.zero_softmax(s, by).collect()}
    for h in range(2):
        raw = q[:, 2 * h : 2 * h + 2] @ k[:, 2 * h : 2 * h + 2].T / 2
        a = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
        b = (np.exp(raw) - 1) ** 2
        b = b / (b.sum(1, keepdims=True) + 1e-5)
        assert np.allclose([[soft[h, i, j] for j in range(5)] for i in range(5)], a)
        assert np.allclose([[zero[h, i, j] for j in range(5)] for i in range(5)], b)
        summed = interactions.propagated(interactions.softmax(s, by), n, ["x"], FRAME, keep=["head"]).where(F.col("head") == h).orderBy("vessel_id").collect()
        assert np.allclose([r["x"] for r in summed], a @ x)
    large = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1000.0), ("b", 0, 0.0)], "g string, i int, score double")
    assert {(r["g"], r["i"]): r["weight"] for r in interactions.softmax(large, ["g"]).collect()} == {("a", 0): 0.0, ("a", 1): 1.0, ("b", 0): 1.0}
    assert interactions.zero_softmax(large.where("g = 'b'"), ["g"]).first()["weight"] == 0.0
    one = spark.createDataFrame([(0.3, 0.5, False), (0.3, 0.6, False), (0.3, 0.5, True)], "w double, m double, own boolean")
    assert [round(r[0], 9) for r in one.select(interactions.gated(F.col("w"), F.col("m"), F.col("own"))).collect()] == [0.0, 0.18, 0.3]


def test_moments_merge_in_any_order(spark, tmp_path):
    files = {"a": [1.0, 2.0, 4.0], "b": [1e9, 1e9 + 1], "c": [7.0], "d": [None]}
    df = spark.createDataFrame([(f, v, 1.0, None, 2.0) for f, vs in files.items() for v in vs], "source_file string, lon double, lat double, sog double, heading double")
    whole = frames.statistics(df).first()
    state = moments.moments(df)
    got = moments.finalised(state).first()
    assert math.isclose(got["lon_mean"], whole["lon_mean"]) and math.isclose(got["lon_std"], whole["lon_std"], rel_tol=1e-12)
    assert (got["lat_std"], got["sog_std"], got["sog_mean"]) == (1.0, 1.0, None)
    for order in list(permutations("abcd"))[::6]:
        parts = state.where("false")
        for f in order:
            parts = moments.merged(parts.unionByName(moments.moments(df.where(F.col("source_file") == f)))).select(F.lit("x").alias("source_file"), "column", "n", "mean", "m2")
        step = moments.finalised(parts).first()
        assert math.isclose(step["lon_mean"], whole["lon_mean"]) and math.isclose(step["lon_std"], whole["lon_std"], rel_tol=1e-9)
    path = f"{tmp_path}/state"
    moments.recorded(state.withColumn("mean", F.lit(0.0)), path, 1)
    moments.recorded(state, path, 2)
    assert moments.finalised(moments.known(spark.read.parquet(path))).first()["lon_mean"] == got["lon_mean"]
    assert moments.finalised(state.limit(0)).first()["lon_std"] == 1.0


def test_resumed_log_equals_unbroken_one(spark, tmp_path):
    rows = [("r", kind, e, float((e * 7 + len(kind)) % 5), f"r/{e}") for e in range(8) for kind in ("train", "val")]
    df = spark.createDataFrame(rows, "run string, kind string, epoch int, loss double, checkpoint string")
    runs.append(df, f"{tmp_path}/whole", 0)
    broken = f"{tmp_path}/broken"
    runs.append(df.where("epoch < 5 and not (epoch = 4 and kind = 'val')"), broken, 0)
    assert runs.resume_at(runs.log(spark, broken)).first() == ("r", 4, "r/3")  # the last epoch has no validation
    for _ in range(2):  # a retried job writes twice
        runs.append(df.where("epoch >= 4"), broken, 1)
    whole, resumed = runs.log(spark, f"{tmp_path}/whole"), runs.log(spark, broken)
    assert sorted(whole.collect()) == sorted(resumed.collect())
    assert sorted(runs.best(resumed).collect()) == [("r", "train", 0, 0.0, "r/0"), ("r", "val", 1, 0.0, "r/1")]
    assert sorted(runs.latest(resumed).select("kind", "epoch").collect()) == [("train", 7), ("val", 7)]
    runs.append(df.limit(0), f"{tmp_path}/none", 0)
    assert runs.resume_at(runs.log(spark, f"{tmp_path}/none")).count() == 0


def test_draws_spread_and_correlate(spark):
    rows = spark.range(2000).select(F.col("id").alias("ordinal"), F.lit(3.0).alias("mx"), F.lit(-1.0).alias("my"), F.lit(0.0).alias("log_sx"), F.lit(0.5).alias("log_sy"), F.lit(0.6).alias("raw_rho"))
    drawn = scores.samples(rows, 20, 3)
    x, y = np.array(drawn.select("lon", "lat").collect()).T
    assert abs(x.mean() - 3) < 0.02 and abs(y.mean() + 1) < 0.04
    assert abs(x.std() - 1) < 0.02 and abs(y.std() - math.exp(0.5)) < 0.04
    assert abs(np.corrcoef(x, y)[0, 1] - math.tanh(0.6)) < 0.02
    key = ["ordinal", "sample"]
    assert drawn.orderBy(*key).collect() == scores.samples(rows.repartition(7), 20, 3).orderBy(*key).collect()
    assert drawn.select("lon").distinct().count() == 40_000
    assert scores.samples(rows, 20, 4).select("lon").intersect(drawn.select("lon")).count() == 0


@pytest.mark.parametrize("points", [3, 7, 1000])
def test_long_segments_fill_alike(spark, points):
    rng = np.random.default_rng(points)
    rows = []
    for v in range(4):
        at = 0
        for i in range(120):
            at += int(rng.integers(1, 9))
            value = lambda: float(rng.normal()) if rng.random() < 0.3 else None
            rows.append(("f", 367000001 + v, at * 60, value(), value(), value(), value(), rng.choice(["a", None]), i))
    df = spark.createDataFrame([(f, m, t, a, b, c, d, None if s is None else str(s), o) for f, m, t, a, b, c, d, s, o in rows], "source_file string, mmsi long, t long, lon double, lat double, sog double, heading double, status string, ordinal long")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    whole, cut = (tracks.resample(df, 60, 100_000, points=p) for p in (1 << 16, points))
    assert whole.count() > 1000 and whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_windows_by_spans(spark):
    rng = np.random.default_rng(6)
    rows = [("f", i, v, float(i)) for v in range(5) for i in range(90) if rng.random() < 0.93 for _ in range(1 + (rng.random() < 0.02))]
    df = spark.createDataFrame([(f, i, v, x, 0.0, 0.0, 0.0) for f, i, v, x in rows], "source_file string, idx int, vessel_id long, lon double, lat double, sog double, heading double")
    every = [{(r["start"], r["vessel_id"], tuple(p["idx"] for p in r["path"])) for r in windows.members(df, 6, 2, span).collect()} for span in (4096, 30, 6, 2)]
    assert len(every[0]) > 50 and every.count(every[0]) == 4


def test_shuffle_order(spark):
    found = spark.range(300).select(F.lit("f").alias("source_file"), F.col("id").cast("int").alias("start"), F.lit(1).alias("vessel_id"))
    one = {r["start"]: r["position"] for r in windows.shuffle_order(found, 1).collect()}
    assert sorted(one.values()) == list(range(300)) and one == {r["start"]: r["position"] for r in windows.shuffle_order(found.repartition(9), 1).collect()}
    other = {r["start"]: r["position"] for r in windows.shuffle_order(found, 2).collect()}
    assert other != one and abs(np.corrcoef([one[i] for i in range(300)], range(300))[0, 1]) < 0.2


def track_frames(spark, vessels=2, n=8):
    rows = [("f", i, 367000001 + v, 0.1 * i + 0.00004, 0.05 * i * v, 1.0, 2.0) for v in range(vessels) for i in range(n)]
    return spark.createDataFrame(rows, "source_file string, frame_id int, vessel_id long, lon double, lat double, sog double, heading double")


def test_dataset_rounds_first(spark):
    p = WindowParams(observed=3, predicted=4)
    got = jobs.dataset(track_frames(spark), p).orderBy("window", "vessel_id").collect()
    assert [(r["window"], r["start"]) for r in got] == [(0, 0), (0, 0), (1, 1), (1, 1)]
    first = got[0]
    assert len(first["observed"]) == 3 and len(first["predicted_rel"]) == 4 and first["mask"] == [1.0] * 7 and first["non_linear"] == 0
    assert [x["lon"] for x in first["observed"]] == [float(np.float32(np.around(np.float32(0.1 * i + 0.00004), 4))) for i in range(3)]
    assert first["observed_rel"][0]["lon"] == 0.0 and first["predicted_rel"][0]["lon"] == float(np.float32(np.float32(0.3) - np.float32(0.2)))
    assert jobs.dataset(track_frames(spark, vessels=1), p).count() == 0
    assert jobs.dataset(track_frames(spark), WindowParams(observed=3, predicted=4, skip=2)).select("start").distinct().count() == 1
    with pytest.raises(ValueError, match="four"):
        jobs.dataset(track_frames(spark), WindowParams(observed=3, predicted=3))


def test_evaluation_job(spark, tmp_path):
    """Tracks of constant velocity are foretold by zero accelerations; the file has the scores of every step."""
    p = EvaluationParams(str(tmp_path), "harbour", "val", "a", WindowParams(observed=3, predicted=4))
    sinks.frames_csv(track_frames(spark), p.folder)
    one = jobs.dataset(track_frames(spark), p.windows)
    files = [r[0] for r in spark.read.text(p.folder).select("_metadata.file_path").distinct().collect()]
    zero = one.select("window", "vessel_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"), F.lit(0.0).alias("acc_lon"), F.lit(0.0).alias("acc_lat"))
    whole = spark.createDataFrame([(f,) for f in files], "source_file string").crossJoin(zero)
    got = {r["measure"]: r for r in jobs.evaluate(spark, p, whole, f"{tmp_path}/out").collect()}
    assert sorted(got) == ["ADE", "FDE", *[f"step {i}" for i in range(1, 6)]]
    assert got["step 5"]["distance"] is None and got["step 5"]["ratio"] == "N/A"
    assert got["FDE"]["distance"] < 1e-2 and got["FDE"]["published"] == 0.002378 and got["ADE"]["published"] == 0.001522
    assert spark.read.json(f"{tmp_path}/out/run=a-val").count() == 7
    held = jobs.baseline(one, 4).first()
    assert held["windows"] == 2 and held["fde"] > held["ade"] > 1
    with pytest.raises(ValueError, match="no windows"):
        jobs.evaluate(spark, EvaluationParams(str(tmp_path), "harbour", "val", "a", WindowParams(observed=30, predicted=4)), whole, f"{tmp_path}/out")


CROWD_QUERIES = ["attention", "graph_features", "sparse_adjacency", "interaction_scores", "nearness"]


@pytest.fixture(scope="session")
def crowd(tmp_path_factory):
    """Two hours of 1,200 vessels in few states, 2.9 million pairs; in the second folder some lack a measurement."""
    folders = [str(tmp_path_factory.mktemp("crowd")) for _ in range(2)]
    for lacking, folder in enumerate(folders):
        duckdb.execute(f"""copy (select i event_id, timestamp '2024-01-01' + to_minutes(60 * (i // 1200)) ts, i % 1200 user_id, 'view' event_type,
          (case when {lacking} and i % 97 = 0 then null else (i % 7) * 37.25 + case when i % 100 = 1 then i * 0.01 else 0 end end)::double as value,
          case when {lacking} and i % 89 = 0 then '{{}}' else '{{"k": ' || (i % 3) * 31 || '}}' end props from range(2400) t(i)) to '{folder}/events.parquet'""")
    return folders


@pytest.mark.parametrize("name", CROWD_QUERIES)
def test_crowd_equals_sql_without_shuffled_pairs(spark, crowd, monkeypatch, name):
    """Vessels of equal values are worked out once, in blocks of any size, and no pair is joined or shuffled. (A null weight is the
    largest in SQL, none here, so attention has none.)"""
    crowd = crowd[name != "attention"]
    monkeypatch.setattr(interactions, "TASK_STATES", 16)
    monkeypatch.setattr(interactions, "BLOCK_PAIRS", 500)
    wrote = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query, sql = graphs.QUERIES[name]
        df, bytes_before = query(spark, crowd), wrote()
        columns = sorted(df.columns)
        got = df.select(*columns).collect()
        time.sleep(1)
        assert wrote() - bytes_before < 2_000_000
        assert "other_" not in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{crowd}/events.parquet'")
    told = db.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
    key = lambda r: [r[columns.index(c)] for c in ("ts", "vessel_id", "head") if c in columns]
    got, told = sorted(map(tuple, got), key=key), sorted(told, key=key)
    assert len(got) == len(told) and [key(r) for r in got] == [key(r) for r in told]
    for a, b in zip(got, told, strict=True):
        assert all(x == pytest.approx(y, abs=2e-6 if name != "nearness" else 2e-5) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", CROWD_QUERIES)
def test_reports_are_shuffled_once(spark, tmp_path, monkeypatch, name):
    """Of 40,000 vessels in an hour, a hundred of a state, the reports cross the network once, and then states with names.
    (Before: reports twice or more, as they were joined with the sums of their states: 3.9 to 5.6 MB here, now 2.2 to 2.8.)"""
    duckdb.execute(f"""copy (select i event_id, timestamp '2024-01-01' + to_minutes(60 * (i // 40000)) ts, i % 40000 user_id, 'view' event_type,
      (hash(i % 400) % 10000 / 100)::double as value, '{{"k": ' || (i % 400) % 90 || '}}' props from range(80000) t(i)) to '{tmp_path}/events.parquet'""")
    wrote = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = wrote()
        graphs.QUERIES[name][0](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
        time.sleep(1)
        assert wrote() - at < 3_200_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
