"""Registered queries of the window dataset, the evaluation and the statistics that merge, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.config import BASELINE_WINDOWS, PUBLISHED, WindowParams
from wakeline.operators import moments, scores, windows
from wakeline.plans import jobs
from wakeline.plans.tracks import _DAYS, _HOURS, _INDEXED, _LAST, _WINDOWED, _WINDOWS, NUM, L, day_frames, day_windows, reports
from wakeline.sources import runs
from wakeline.sources.scratch import shared_folder

#: Three observed and four predicted steps; features are scaled as the frames of a job are.
PARAMS = WindowParams(observed=3, predicted=4, threshold=0.002)
SCALES = {"lon": 1000, "lat": 100, "sog": 40, "heading": 360}
SAMPLES, EPOCHS = 4, 50


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_frames(spark, sf_dir)
    return jobs.dataset(rows.withColumns({c: F.col(c) / s for c, s in SCALES.items()}), PARAMS)


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dataset(spark, sf_dir)
    total = lambda c, x: F.round(F.aggregate(c, F.lit(0.0), lambda acc, p: acc + p[x].cast("double")), 4)
    return d.select("window", "vessel_id", F.size("observed").alias("n_observed"), F.size("predicted").alias("n_predicted"), total("observed", "lon").alias("lon"), total("predicted", "sog").alias("sog"), total("observed_rel", "lat").alias("d_lat"), F.round(F.col("predicted_rel")[0]["heading"].cast("double"), 5).alias("d_heading"), "non_linear", F.size("mask").alias("n_mask"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset as a table: evaluations read it several times."""
    path = shared_folder(spark, "dataset")
    _dataset(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accelerations that grow with the step, from the last observed speed and heading."""
    d = _written(spark, sf_dir)
    last, step = F.element_at("observed", -1), F.explode(F.sequence(F.lit(1), F.lit(PARAMS.predicted))).alias("step")
    told = d.select(*scores.TRACK, last["sog"].cast("double").alias("sog"), last["heading"].cast("double").alias("heading"), step)
    told = told.select(*scores.STEP, (F.col("sog") * F.col("step") / 100).alias("acc_lon"), (F.col("heading") * F.col("step") / -200).alias("acc_lat"))
    return jobs.evaluation(d, told, PARAMS.predicted).withColumn("distance", F.round("distance", 5))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = jobs.baseline(_written(spark, sf_dir), PARAMS.predicted)
    return b.select(F.round("ade", 5).alias("ade"), F.round("fde", 5).alias("fde"), "windows")


def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of all reports from the states of each day, recorded in two parts of which the second repeats a day."""
    r = reports(spark, sf_dir).withColumn("source_file", F.date_format("ts", "yyyy_MM_dd"))
    path, even = shared_folder(spark, "moments"), F.day("ts") % 2 == 0
    moments.recorded(moments.moments(r.where(even | (F.day("ts") == 1)).withColumn("lon", F.when(F.day("ts") != 1, F.col("lon")))), path, 1)
    moments.recorded(moments.moments(r.where(~even)), path, 2)
    s = moments.finalised(moments.known(spark.read.parquet(path)))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.entities(reports(spark, sf_dir))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of epochs, the mean of a share of the events, by a run that stopped and was resumed: where it goes on, its best and last
    epochs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("run"), F.when(F.col("event_id") % 3 == 0, "val").otherwise("train").alias("kind"), (F.floor(F.col("event_id") / 3) % EPOCHS).alias("epoch"), "value")
    own = e.groupBy("run", "kind", "epoch").agg(F.round(F.avg("value"), 6).alias("loss")).withColumn("checkpoint", F.concat_ws("/", "run", F.col("epoch").cast("string")))
    path = shared_folder(spark, "runs")
    runs.append(own.where(F.col("epoch") < EPOCHS // 2).withColumn("loss", F.when(F.col("epoch") > 20, -1.0).otherwise(F.col("loss"))), path, 0)
    runs.append(own.where(F.col("epoch") > 20), path, 1)
    log = runs.log(spark, path)
    found = runs.best(log).select("run", "kind", F.col("epoch").alias("best_epoch"), F.col("loss").alias("best"), "checkpoint")
    return found.join(runs.latest(log).select("run", "kind", F.col("epoch").alias("last_epoch"), F.col("loss").alias("last")), ["run", "kind"]).join(runs.resume_at(log).select("run", F.col("epoch").alias("resume")), "run")


def sampled_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).select("ordinal", F.col("lon").alias("mx"), F.col("lat").alias("my"), F.lit(0.0).alias("log_sx"), F.lit(0.5).alias("log_sy"), (F.col("sog") / 20 - 1).alias("raw_rho"))
    return scores.samples(r, SAMPLES, 7).select("ordinal", "sample", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shuffle_order(day_windows(spark, sf_dir), 5).select("start", "position")


def gaussian_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    nll = scores.gaussian_nll(F.col("sog") / 40, F.col("heading") / 360, F.lit(0.4), F.lit(0.5), F.lit(-1.0), F.lit(0.2), F.col("sog") / 80 - 0.2)
    return scores.gaussian_loss(r, nll).select(F.round("loss", 6).alias("loss"))


_FINE = ", ".join(f"(round_even(({c} / {s})::float * 10000::float, 0) / 10000.0::double)::float {c}" for c, s in SCALES.items())
_DATASET = f"with {_DAYS}, {_LAST}, {_INDEXED.replace('lon, lat, sog, heading from b', _FINE + ' from b')}, {_WINDOWS}"
_BENT = " + ".join(f"(path[4].{c}::double - 3 * path[5].{c}::double + 3 * path[6].{c}::double - path[7].{c}::double) ** 2 / 20" for c in ("lon", "lat"))
_GONE = f"""{_DATASET}, k as (select start, vessel_id, unnest(range(1, 5)) step, path from v),
q as (select start, vessel_id, step, path[3].lon::double + step * (path[3].lon - path[2].lon)::double + path[3].sog::double / 100 * step * (step + 1) * (step + 2) / 6 lon,
  path[3].lat::double + step * (path[3].lat - path[2].lat)::double - path[3].heading::double / 200 * step * (step + 1) * (step + 2) / 6 lat, path[3 + step].lon::double t_lon, path[3 + step].lat::double t_lat, path from k),
x as (select start, step, sqrt(((lon - t_lon) * 72.60811::double) ** 2 + ((lat - t_lat) * 28.32044::double) ** 2) distance,
  sqrt(((path[3].lon::double - t_lon) * 72.60811::double) ** 2 + ((path[3].lat::double - t_lat) * 28.32044::double) ** 2) held from q),
o as (select start, avg(distance) ade, avg(distance) filter (where step = 4) fde from x group by start),
s as (select step, avg(d) d from (select start, step, avg(distance) d from x group by start, step) group by step)"""
_KNOWN = "(values " + ", ".join(f"({h}, {a}::double, {f}::double)" for h, (a, f) in PUBLISHED.items()) + ") pb(horizon, ade, fde)"
_U = lambda at: f"((('0x' || substr(h, {at}, 13))::bigint + 0.5) / 4503599627370496::double)"
_MOMENTS = ", ".join(f"round(avg({c}), 6) {c}_mean, round(case when coalesce(stddev_samp({c}), 0) = 0 then 1 else stddev_samp({c}) end, 6) {c}_std" for c in NUM)

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "dataset": (dataset, f"{_DATASET} select (dense_rank() over (order by start) - 1) as window, vessel_id, 3 n_observed, 4 n_predicted, round(path[1].lon::double + path[2].lon::double + path[3].lon::double, 4) lon, round(path[4].sog::double + path[5].sog::double + path[6].sog::double + path[7].sog::double, 4) sog, round((path[2].lat - path[1].lat)::double + (path[3].lat - path[2].lat)::double, 4) d_lat, round((path[4].heading - path[3].heading)::double, 5) d_heading, ({_BENT} >= 0.002)::int non_linear, {L} n_mask from v"),
    "evaluation": (evaluation, f"{_GONE}, r as (select 'step ' || n.step measure, (n.step * 10)::int horizon, d distance, 'ADE' kind from range(1, 6) n(step) left join s on s.step = n.step union all select upper(m), 40, case m when 'ade' then (select avg(ade) from o) else (select avg(fde) from o) end, upper(m) from (values ('ade'), ('fde')) t(m)), y as (select measure, r.horizon, distance, case kind when 'ADE' then ade else fde end published from r left join {_KNOWN} on pb.horizon = r.horizon) select measure, horizon, round(distance, 5) distance, published, case when distance is null or published is null then 'N/A' else format('{{:.2f}}x', distance / published) end ratio, (select count(*) from o) windows from y"),
    "baseline": (baseline, f"{_GONE}, z0 as (select start, avg(held) ade, avg(held) filter (where step = 4) fde from x group by start order by start limit {BASELINE_WINDOWS}) select round(avg(ade), 5) ade, round(avg(fde), 5) fde, count(*) windows from z0"),
    "merged_statistics": (merged_statistics, f"with {_HOURS} select {_MOMENTS} from a"),
    "entity_totals": (entity_totals, f"with {_HOURS} select count(*) as rows, count(distinct mmsi) vessels from a"),
    "run_log": (run_log, f"with e as (select event_type run, case when event_id % 3 = 0 then 'val' else 'train' end kind, (event_id // 3) % {EPOCHS} epoch, round(avg(value), 6) loss from events group by all), b as (select run, kind, min({{'loss': loss, 'epoch': epoch}}) x, max({{'epoch': epoch, 'loss': loss}}) y from e group by run, kind), f as (select run, max(epoch) + 1 resume from (select run, epoch, count(*) n from e group by run, epoch) join (select run, count(distinct kind) kinds from e group by run) using (run) where n = kinds group by run) select b.run, kind, x.epoch best_epoch, x.loss best, b.run || '/' || x.epoch checkpoint, y.epoch last_epoch, y.loss as last, resume from b join f using (run)"),
    "sampled_draws": (sampled_draws, f"with {_HOURS}, d as (select ordinal, sample, lon mx, lat my, tanh(sog / 20 - 1) rho, md5('7:' || ordinal || ':' || sample) h from a, range({SAMPLES}) n(sample)), g as (select *, sqrt(-2 * ln({_U(1)})) away, 2 * 3.141592653589793::double * {_U(14)} turn from d) select ordinal, sample::int sample, round(mx + away * cos(turn), 6) lon, round(my + exp(0.5::double) * (rho * away * cos(turn) + sqrt(greatest(1 - rho ** 2, 1e-6)) * away * sin(turn)), 6) lat from g"),
    "shuffled_order": (shuffled_order, f"{_WINDOWED}, d as (select distinct start from v) select start, row_number() over (order by md5('5:events:' || start)) - 1 as position from d"),
    "gaussian_loss": (gaussian_loss, f"with {_HOURS}, q as (select sog / 40 - 0.4 zx, heading / 360 - 0.5 zy, exp(-1.0::double) sx, exp(0.2::double) sy, tanh(sog / 80 - 0.2) rho from a), r as (select *, greatest(sx * sy, 1e-6) area, greatest(1 - rho ** 2, 1e-6) free from q) select round(avg(-ln(greatest(exp(-((zx / sx) ** 2 + (zy / sy) ** 2 - 2 * (rho * zx * zy) / area) / (2 * free)) / (2 * pi() * (area * sqrt(free))), 1e-20))), 6) loss from r"),
}
