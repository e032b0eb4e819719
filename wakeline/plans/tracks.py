"""The registered queries: every operator applied to whole tables, with DuckDB SQL beside it.

events stand for position reports: a user is a vessel, values and the key in props give the measurements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.config import BASELINE_WINDOWS, EXPECTED_STATS, REGIONS, CleanParams
from wakeline.operators import frames, profile, scores, tracks, windows
from wakeline.plans import jobs

HOUR, DAY, L = 3600, 86400, 7
BOX = CleanParams(lat=(0.0, 80.0), lon=(0.0, 1000.0), sog=(1.0, 38.0), heading=(0.0, 300.0), min_entities=2)
NUM = ("lon", "lat", "sog", "heading")

_REPORTS = """a as (select 'events' source_file, 100000000 + user_id mmsi, date_trunc('{unit}', ts) ts, value lon,
  json_extract(props, '$.k')::int::double lat, value % 40 sog, (value * 7) % 360 heading, event_type status, event_id ordinal from events)"""
_HOURS, _DAYS = _REPORTS.format(unit="hour"), _REPORTS.format(unit="day")
_LAST = """b as (select * exclude n from (select *, row_number() over (partition by mmsi, ts order by ordinal desc) n from a) where n = 1)"""
_SEGMENTS = """d as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by mmsi order by ts) > 86400000000 then 1 else 0 end new from b),
s as (select *, sum(new) over (partition by mmsi order by ts)::bigint segment from d)"""
_INDEXED = """f as (select source_file, (date_diff('day', (select min(ts) from b), ts))::int frame_id, mmsi vessel_id, lon, lat, sog, heading from b),
i as (select *, dense_rank() over (order by frame_id) - 1 idx from f)"""
_WINDOWS = f"""w as (select *, count(*) over z n, max(idx) over z top, list({{'idx': idx, 'lon': lon, 'lat': lat, 'sog': sog, 'heading': heading}}) over z path
  from i window z as (partition by vessel_id order by idx range between current row and {L - 1} following)),
m as (select idx start, vessel_id, path from w where n = {L} and top = idx + {L - 1}),
v as (select * from m where start in (select start from m group by start having count(*) > 1))"""
_FRAMED = f"with {_DAYS}, {_LAST}, {_INDEXED}"
_WINDOWED = f"{_FRAMED}, {_WINDOWS}"
_STEPS = f"""{_WINDOWED}, u as (select start, vessel_id, unnest(range({L})) step, path from v),
t as (select start, vessel_id, step, path[step + 1].lon lon, path[step + 1].lat lat, path[step + 1].sog sog, path[step + 1].heading heading from u)"""
# Truth: the last 3 of 7 steps; persistence holds step 3.
_HELD = f"""{_STEPS}, x as (select p.start, p.vessel_id, p.step - 3 step, sqrt((p.lon - o.lon) ** 2 + (p.lat - o.lat) ** 2) distance,
  o.lon, o.lat, p.lon t_lon, p.lat t_lat from t p join t o on p.start = o.start and p.vessel_id = o.vessel_id and o.step = 3 where p.step > 3)"""


def reports(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("value")
    return e.select(F.lit("events").alias("source_file"), (F.col("user_id") + 100000000).alias("mmsi"), F.date_trunc(unit, "ts").alias("ts"), v.alias("lon"), F.get_json_object("props", "$.k").cast("int").cast("double").alias("lat"), (v % 40).alias("sog"), ((v * 7) % 360).alias("heading"), F.col("event_type").alias("status"), F.col("event_id").alias("ordinal"))


def day_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_format(tracks.last_of_duplicates(reports(spark, sf_dir, "day")), DAY)


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windows(windows.frame_index(day_frames(spark, sf_dir)), L)


def _rounded(df: DataFrame, columns: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: the last three of seven steps; the position of step 3 is held for them. Both come from one row's path."""
    w = day_windows(spark, sf_dir).select("source_file", F.col("start").alias("window"), "vessel_id", F.col("path")[3].alias("o"), F.posexplode(F.slice("path", 5, 3)).alias("i", "p"))
    return scores.held(w.select(*scores.TRACK, (F.col("i") + 1).alias("step"), F.col("o.lon").alias("lon"), F.col("o.lat").alias("lat"), F.col("p.lon").alias("t_lon"), F.col("p.lat").alias("t_lat")))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_windows(spark, sf_dir).groupBy("start").agg(F.count("*").alias("vessels"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.clean(reports(spark, sf_dir), BOX).select("mmsi", "ts", "ordinal")


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.last_of_duplicates(reports(spark, sf_dir)).select("mmsi", "ts", "ordinal")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks.segments(tracks.last_of_duplicates(reports(spark, sf_dir)), DAY)
    return s.groupBy("mmsi", "segment").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tracks.resample(reports(spark, sf_dir), HOUR, DAY), NUM).select("mmsi", "segment", "ts", *NUM, "status")


def shared_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.shared_times(reports(spark, sf_dir, "minute"), 2).select("mmsi", "ts", "ordinal")


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels"), F.count_distinct("ts").alias("times"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames.statistics(reports(spark, sf_dir))
    return _rounded(s, tuple(s.columns))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    return _rounded(frames.zscored(r, frames.statistics(r)), NUM).select("ordinal", *NUM)


def unscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = frames.unscaled(F.col("lon"), F.col("lat"))
    return reports(spark, sf_dir).select("ordinal", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


def minute_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_format(reports(spark, sf_dir, "second")).groupBy("frame_id").agg(F.count("*").alias("n"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(frames.bucket_of(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def split_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("in/AIS_"), F.date_format("ts", "yyyy_MM_dd"), F.lit(".zip"))
    r = reports(spark, sf_dir).withColumn("split", frames.split_of_day(frames.day_of_name(name))).withColumn("date_str", frames.date_of_name(name))
    return r.where("split is not null").groupBy("split", "date_str").agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels"))


def frame_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.frame_index(day_frames(spark, sf_dir)).groupBy("frame_id", "idx").agg(F.count("*").alias("n"))


def window_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tuple(f"d_{c}" for c in NUM)
    return _rounded(windows.steps(day_windows(spark, sf_dir)), d).select("start", "vessel_id", "step", *d)


def window_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = windows.split_paths(day_windows(spark, sf_dir), 4, 3)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["lon"]), 4)
    return p.select("start", "vessel_id", F.size("observed").alias("n_observed"), F.size("predicted").alias("n_predicted"), total("observed").alias("lon_observed"), total("predicted").alias("lon_predicted"), F.size("mask").alias("n_mask"))


def window_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ordinals(day_windows(spark, sf_dir)).drop("source_file")


def most_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.most_present(windows.frame_index(day_frames(spark, sf_dir)), L)


def non_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.non_linear(day_windows(spark, sf_dir), 5, 50.0).select("start", "vessel_id", F.round("residual", 3).alias("residual"), "non_linear")


def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("ordinal", F.round(windows.rounded4(F.col("lon")).cast("double"), 4).alias("lon"))


def persistence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.ade_fde(_held(spark, sf_dir), 3), ("ade", "fde"))


def persistence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.by_step(_held(spark, sf_dir)), ("distance",))


def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline over the first windows of all files: here a limit is the feature."""
    first = windows.numbered(day_windows(spark, sf_dir)).where(F.col("window") < BASELINE_WINDOWS).select("source_file", F.col("start").alias("window")).distinct()
    return _rounded(scores.ade_fde(_held(spark, sf_dir).join(first, list(scores.SCENE), "left_semi"), 3), ("ade", "fde"))


def scene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _held(spark, sf_dir)
    counts = d.groupBy(*scores.SCENE).agg(F.least(F.lit(5), F.count_distinct("vessel_id")).alias("n"))
    return _rounded(scores.scene_scores(d, counts, 3), ("ade", "fde"))


def best_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _held(spark, sf_dir).withColumn("sample", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    d = d.withColumn("distance", F.abs(F.col("distance") - F.col("sample") * 100 * (1 + F.col("window") % 3)))
    b = scores.best_of_k(d, 3).withColumn("total", F.aggregate("ades", F.lit(0.0), lambda a, x: a + x)).withColumn("k", F.size("ades"))
    return _rounded(b, ("ade", "fde", "total")).drop("source_file", "ades")


def integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.steps(day_windows(spark, sf_dir))
    last = s.where("step = 3").select("source_file", "start", "vessel_id", F.col("d_lon").alias("vel_lon"), F.col("d_lat").alias("vel_lat"), F.col("lon").alias("last_lon"), F.col("lat").alias("last_lat"))
    acc = s.where("step > 3").select("source_file", "start", "vessel_id", (F.col("step") - 3).alias("step"), (F.col("sog") / 100).alias("acc_lon"), (F.col("sog") / -200).alias("acc_lat"))
    return _rounded(scores.integrated(acc.join(last, ["source_file", "start", "vessel_id"]).withColumnRenamed("start", "window")), ("lon", "lat")).drop("source_file")


def absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.steps(day_windows(spark, sf_dir)).withColumnRenamed("start", "window")
    first = s.where("step = 0").select(*scores.TRACK, F.col("lon").alias("first_lon"), F.col("lat").alias("first_lat"))
    rel = s.select(*scores.STEP, "d_lon", "d_lat").join(first, list(scores.TRACK))
    return _rounded(scores.absolute(rel), ("lon", "lat")).select("window", "vessel_id", "step", "lon", "lat")


def position_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _held(spark, sf_dir)
    return _rounded(scores.position_loss(d.select(*scores.STEP, "lon", "lat"), d.select(*scores.STEP, F.col("t_lon").alias("lon"), F.col("t_lat").alias("lat")), 3), ("loss",), 3).drop("source_file")


def gaussian_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    x = scores.gaussian_nll(F.col("sog") / 40, F.col("heading") / 360, F.lit(0.4), F.lit(0.5), F.col("lat") / 100 - F.when(F.col("lat") < 10, 20).otherwise(0), F.lit(0.2), F.when(F.col("sog") > 39, 30.0).otherwise(F.col("sog") / 80 - 0.2))
    return r.select("ordinal", F.round(x, 6).alias("nll"))


def published_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = scores.by_step(_held(spark, sf_dir)).select((F.col("step") * 10).alias("horizon"), "distance")
    return _rounded(scores.against_published(spark, steps), ("distance",)).select("horizon", "distance", "published", "ratio")


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("kind"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    return scores.best_epoch(log)


def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    return r.select("ordinal", F.round(scores.inverse_distance(F.col("lat")), 9).alias("inverse"), scores.closer_to_zero(F.round(F.col("lat") - 50), F.round(F.col("sog") - 20)).alias("closer"), F.round(scores.sparse(F.col("sog") / 40), 9).alias("kept"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = day_frames(spark, sf_dir)
    return f.withColumn("split", F.coalesce(frames.split_of_day(F.col("frame_id") + 1), F.lit("test")))


def profile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sizes(_split(spark, sf_dir))


def profile_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.segment_summary(profile.segments(_split(spark, sf_dir)), 2)


def profile_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.density(_split(spark, sf_dir)), ("mean", "lonely_percent"))


def profile_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.gaps(_split(spark, sf_dir))


def profile_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _split(spark, sf_dir)
    return profile.verdicts(profile.segment_summary(profile.segments(f), 2), frames.statistics(f))


def profile_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.total_windows(profile.segment_summary(profile.segments(_split(spark, sf_dir)), 2))


def expected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames.statistics(reports(spark, sf_dir)).withColumns({f"{c}_mean": 100 * F.col(f"{c}_mean") - 133 for c in NUM})
    return _rounded(profile.expected_ranges(s), ("mean", "std"), 4)


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh text is no time; these rows go with the nulls."""
    r = reports(spark, sf_dir, "second")
    text = F.when(F.col("ordinal") % 7 == 0, "2021-13-01 x").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    whole = CleanParams(lat=(-1e9, 1e9), lon=(-1e9, 1e9), sog=(-1e9, 1e9), heading=(-1e9, 1e9))
    return tracks.clean(tracks.parsed_time(r.withColumn("ts", text)), whole).select("ordinal", "ts")


def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = frames.region_of(25 + F.col("lat") / 4, -130 + F.col("lon") % 70)
    return reports(spark, sf_dir).groupBy(region.alias("region")).agg(F.count("*").alias("n"))


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of one point for each event, and an empty one: nested as the JSON documents are."""
    r = reports(spark, sf_dir, "microsecond").withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double"))
    zero = F.lit(0.0)
    point = F.array("ms", "lat", "lon", "sog", "heading", *[zero] * 7, F.col("mmsi").cast("double"))
    t = r.select("source_file", F.array(F.array(point), F.array().cast("array<array<double>>")).alias("trajectories"))
    return _rounded(frames.flattened(t), ("lon",)).select("source_file", "frame_id", "vessel_id", "lon", "lat")


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _rounded(scores.batch_losses(e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("position"), F.col("value").alias("loss"))), ("loss",))


def window_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(day_windows(spark, sf_dir)).select("start", "vessel_id", "window")


def shuffled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shuffled(day_windows(spark, sf_dir)).select("start", "vessel_id")


def window_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = windows.nodes(day_windows(spark, sf_dir))
    return n.select("start", "step", F.size("nodes").alias("n"), F.round(F.col("nodes")[0][0], 6).alias("first_lon"), F.round(F.element_at("nodes", -1)[1], 6).alias("last_lat"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty draws for each row; their mean lies within six deviations of the mean of twenty."""
    r = reports(spark, sf_dir).select("ordinal", F.col("lon").alias("mx"), F.col("lat").alias("my"), F.lit(0.0).alias("log_sx"), F.lit(0.5).alias("log_sy"), F.lit(0.3).alias("raw_rho"))
    drawn = scores.samples(r).groupBy("ordinal").agg(F.count("*").cast("int").alias("n"), F.avg(F.col("lon") - F.col("mx")).alias("x"), F.avg(F.col("lat") - F.col("my")).alias("y"))
    return drawn.select("ordinal", "n", ((F.abs("x") < 6 / 20**0.5) & (F.abs("y") < 6 * 1.65 / 20**0.5)).alias("near"))


JOB = CleanParams(lat=(0.0, 80.0), lon=(0.0, 1000.0), sog=(1.0, 38.0), heading=(0.0, 300.0), min_entities=2, max_gap_s=6 * HOUR, step_s=HOUR)


def frames_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reports, a file a day, to frames: clean, grid, co-occurrence, statistics of the training days, scaling, frame numbers."""
    name = F.concat(F.lit("AIS_"), F.date_format("ts", "yyyy_MM_dd"), F.lit(".zip"))
    found, _ = jobs.split_frames(reports(spark, sf_dir).withColumn("source_file", name), JOB)
    return _rounded(found.drop("source_file"), NUM, 5)


_GRID = f"""with {_HOURS}, {_LAST}, {_SEGMENTS},
g as (select mmsi, segment, unnest(generate_series(min(ts), max(ts), interval 1 hour)) ts from s group by mmsi, segment having count(*) >= 2),
j as (select g.*, s.lon, s.lat, s.sog, s.heading, s.status from g left join s using (mmsi, segment, ts)),
k as (select mmsi, segment, ts, epoch_us(ts) now, status,
  {", ".join(f"{c}, last_value({c} ignore nulls) over back {c}0, first_value({c} ignore nulls) over ahead {c}1, last_value(case when {c} is not null then epoch_us(ts) end ignore nulls) over back {c}a, first_value(case when {c} is not null then epoch_us(ts) end ignore nulls) over ahead {c}b" for c in ("lon", "lat"))},
  coalesce(sog, avg(sog) over around) sog, coalesce(heading, avg(heading) over around) heading from j
  window back as (partition by mmsi, segment order by ts rows between unbounded preceding and current row),
         ahead as (partition by mmsi, segment order by ts rows between current row and unbounded following),
         around as (partition by mmsi, segment order by ts rows between 2 preceding and 2 following)),
l as (select mmsi, segment, ts, {", ".join(f"coalesce({c}, {c}0 + ({c}1 - {c}0) * ((now - {c}a) / nullif({c}b - {c}a, 0)), {c}0) {c}" for c in ("lon", "lat"))},
  {", ".join(f"last_value({c} ignore nulls) over back {c}" for c in ("sog", "heading", "status"))} from k
  window back as (partition by mmsi, segment order by ts rows between unbounded preceding and current row)),
o as (select mmsi, segment, ts, lon, lat, {", ".join(f"first_value({c} ignore nulls) over ahead {c}" for c in ("sog", "heading", "status"))} from l
  window ahead as (partition by mmsi, segment order by ts rows between current row and unbounded following))
select mmsi, segment, ts, {", ".join(f"round({c}, 6) {c}" for c in NUM)}, status from o where lon is not null and lat is not null and sog is not null and heading is not null"""
_JOB = f"""with {_HOURS}, c as (select * replace ('AIS_' || strftime(ts, '%Y_%m_%d') || '.zip' as source_file) from a where lat between 0 and 80 and lon between 0 and 1000 and sog between 1 and 38 and heading between 0 and 300),
b as (select * exclude n from (select *, row_number() over (partition by source_file, mmsi, ts order by ordinal desc) n from c) where n = 1),
d as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by source_file, mmsi order by ts) > 21600000000 then 1 else 0 end new from b),
s as (select *, sum(new) over (partition by source_file, mmsi order by ts)::bigint segment from d),
g as (select source_file, mmsi, segment, unnest(generate_series(min(ts), max(ts), interval 1 hour)) ts from s group by source_file, mmsi, segment having count(*) >= 2),
j as (select g.*, s.lon, s.lat, s.sog, s.heading, s.status from g left join s using (source_file, mmsi, segment, ts)),
k as (select source_file, mmsi, segment, ts, epoch_us(ts) now, status,
  {", ".join(f"{c}, last_value({c} ignore nulls) over back {c}0, first_value({c} ignore nulls) over ahead {c}1, last_value(case when {c} is not null then epoch_us(ts) end ignore nulls) over back {c}a, first_value(case when {c} is not null then epoch_us(ts) end ignore nulls) over ahead {c}b" for c in ("lon", "lat"))},
  coalesce(sog, avg(sog) over around) sog, coalesce(heading, avg(heading) over around) heading from j
  window back as (partition by source_file, mmsi, segment order by ts rows between unbounded preceding and current row),
         ahead as (partition by source_file, mmsi, segment order by ts rows between current row and unbounded following),
         around as (partition by source_file, mmsi, segment order by ts rows between 2 preceding and 2 following)),
l as (select source_file, mmsi, segment, ts, {", ".join(f"coalesce({c}, {c}0 + ({c}1 - {c}0) * ((now - {c}a) / nullif({c}b - {c}a, 0)), {c}0) {c}" for c in ("lon", "lat"))},
  {", ".join(f"last_value({c} ignore nulls) over back {c}" for c in ("sog", "heading", "status"))} from k
  window back as (partition by source_file, mmsi, segment order by ts rows between unbounded preceding and current row)),
o as (select source_file, mmsi, segment, ts, lon, lat, {", ".join(f"first_value({c} ignore nulls) over ahead {c}" for c in ("sog", "heading", "status"))} from l
  window ahead as (partition by source_file, mmsi, segment order by ts rows between current row and unbounded following)),
oo as (select * from o where lon is not null and lat is not null and sog is not null and heading is not null),
q as (select * from oo where (source_file, ts) in (select (source_file, ts) from oo group by source_file, ts having count(distinct mmsi) >= 2)),
z as (select {", ".join(f"avg({c}) {c}_m, coalesce(nullif(stddev_samp({c}), 0), 1) {c}_s" for c in NUM)} from q where day(ts) <= 25)
select case when day(ts) <= 25 then 'train' when day(ts) <= 28 then 'val' else 'test' end split, strftime(ts, '%Y_%m_%d') date_str,
  round_even((epoch_us(ts) - min(epoch_us(ts)) over (partition by source_file)) / 60000000.0::double, 0)::int frame_id, mmsi vessel_id, {", ".join(f"round(({c} - {c}_m) / {c}_s, 5) {c}" for c in NUM)} from q, z"""
_SPLIT = f"""{_FRAMED}, y as (select *, case when frame_id + 1 between 1 and 25 then 'train' when frame_id + 1 between 26 and 28 then 'val' else 'test' end split from f)"""
_RUNS = f"""{_SPLIT}, r0 as (select split, vessel_id, frame_id, case when frame_id - lag(frame_id) over (partition by split, vessel_id order by frame_id) > 1 then 1 else 0 end new from y),
r1 as (select *, sum(new) over (partition by split, vessel_id order by frame_id rows unbounded preceding) segment from r0),
r2 as (select split, vessel_id, segment, count(*) length from r1 group by all),
r3 as (select split, count(*) segments, sum((length >= 2)::bigint)::bigint usable, sum(greatest(0, length - 1))::bigint windows, {", ".join(f"quantile_cont(length, {m}) p{round(m * 100)}" for m in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))} from r2 group by split)"""
_ADE = "select avg(a) ade, avg(f) fde, count(*) windows from (select start, avg(distance) a, avg(distance) filter (where step = 3) f from {} group by start)"
_ADE6 = "select round(ade, 6) ade, round(fde, 6) fde, windows from (" + _ADE + ")"
_MATRIX = [[(4, -9, 3, 5, -3), (-9, 22, -12, -6, 5), (3, -12, 18, -12, 3), (5, -6, -12, 22, -9), (-3, 5, 3, -9, 4)][i][j] for i in range(5) for j in range(5)]
_RESIDUAL = " + ".join(f"{_MATRIX[5 * i + j]} / 35.0 * (path[{i + 3}].lon * path[{j + 3}].lon + path[{i + 3}].lat * path[{j + 3}].lat)" for i in range(5) for j in range(5))

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "window_counts": (window_counts, f"{_WINDOWED} select start, count(*) vessels from v group by start"),
    "clean": (clean, f"with {_HOURS} select mmsi, ts, ordinal from a where lat between 0 and 80 and lon between 0 and 1000 and sog between 1 and 38 and heading between 0 and 300 and regexp_full_match(mmsi::varchar, '[0-9]{{9}}')"),
    "dedup_last": (dedup_last, f"with {_HOURS}, {_LAST} select mmsi, ts, ordinal from b"),
    "sessions": (sessions, f"with {_HOURS}, {_LAST}, {_SEGMENTS} select mmsi, segment, count(*) n, min(ts) first_ts, max(ts) last_ts from s group by mmsi, segment"),
    "resample": (resample, _GRID),
    "shared_times": (shared_times, f"with {_REPORTS.format(unit='minute')} select mmsi, ts, ordinal from a where ts in (select ts from a group by ts having count(distinct mmsi) >= 2)"),
    "report_counts": (report_counts, f"with {_HOURS} select count(*) n, count(distinct mmsi) vessels, count(distinct ts) times, min(ts) first_ts, max(ts) last_ts from a"),
    "statistics": (statistics, f"with {_HOURS} select " + ", ".join(f"round(avg({c}), 6) {c}_mean, round(case when coalesce(stddev_samp({c}), 0) = 0 then 1 else stddev_samp({c}) end, 6) {c}_std" for c in NUM) + " from a"),
    "zscore": (zscore, f"with {_HOURS}, q as (select " + ", ".join(f"avg({c}) {c}_m, stddev_samp({c}) {c}_s" for c in NUM) + " from a) select ordinal, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) {c}" for c in NUM) + " from a, q"),
    "unscale": (unscale, f"with {_HOURS} select ordinal, round(lon * 72.60811::double + -133.29703::double, 5) lon, round(lat * 28.32044::double + 20.90883::double, 5) lat from a"),
    "minute_frames": (minute_frames, f"with {_REPORTS.format(unit='second')} select round_even((epoch_us(ts) - (select min(epoch_us(ts)) from a)) / 60000000.0::double, 0)::int frame_id, count(*) n from a group by 1"),
    "buckets": (buckets, "select floor(floor(epoch_us(ts) / 1000) / 600000)::int bucket, count(*) n from events group by 1"),
    "split_days": (split_days, f"with {_HOURS} select case when day(ts) <= 25 then 'train' when day(ts) <= 28 then 'val' else 'test' end split, strftime(ts, '%Y_%m_%d') date_str, count(*) n, count(distinct mmsi) vessels from a group by 1, 2"),
    "frame_ranks": (frame_ranks, f"{_FRAMED} select frame_id, idx::int idx, count(*) n from i group by 1, 2"),
    "window_steps": (window_steps, f"{_STEPS} select start::int start, vessel_id, step::int step, " + ", ".join(f"round(coalesce({c} - lag({c}) over (partition by start, vessel_id order by step), 0), 6) d_{c}" for c in NUM) + " from t"),
    "window_parts": (window_parts, f"{_WINDOWED} select start, vessel_id, 4 n_observed, 3 n_predicted, round(path[1].lon + path[2].lon + path[3].lon + path[4].lon, 4) lon_observed, round(path[5].lon + path[6].lon + path[7].lon, 4) lon_predicted, 7 n_mask from v"),
    "window_ordinals": (window_ordinals, f"{_WINDOWED}, c as (select start, count(*) n from v group by start), e as (select start, (sum(n) over (order by start))::bigint last_offset, n from c) select start, vessel_id, row_number() over (partition by start order by vessel_id) - 1 ordinal, last_offset, last_offset - n first_offset from v join e using (start)"),
    "most_present": (most_present, f"{_FRAMED}, st as (select distinct idx start from i where idx <= (select max(idx) from i) - {L - 1}) select max(n) max_present from (select start, count(distinct vessel_id) n from st join i on i.idx between start and start + {L - 1} group by start)"),
    "non_linear": (non_linear, f"{_WINDOWED} select start, vessel_id, round({_RESIDUAL}, 3) residual, (({_RESIDUAL}) >= 50)::int non_linear from v"),
    "rounded": (rounded, f"with {_HOURS} select ordinal, round((round_even(lon::float * 10000::float, 0) / 10000.0::double)::float::double, 4) lon from a"),
    "persistence_scores": (persistence_scores, f"{_HELD} {_ADE6.format('x')}"),
    "persistence_steps": (persistence_steps, f"{_HELD}, z0 as (select step, avg(d) d from (select start, step, avg(distance) d from x group by start, step) group by step) select n.step::int step, round(d, 6) distance from range(1, 6) n(step) left join z0 on z0.step = n.step"),
    "first_windows": (first_windows, f"{_HELD} {_ADE6.format('(select * from x where start in (select distinct start from x order by start limit ' + str(BASELINE_WINDOWS) + '))')}"),
    "scene_scores": (scene_scores, f"{_HELD}, r as (select *, dense_rank() over (partition by start order by vessel_id) k from x) {_ADE6.format('(select * from r where k <= 5)')}"),
    "best_sample": (best_sample, f"{_HELD}, q as (select start, sample, avg(abs(distance - sample * 100 * (1 + start % 3))) ade, avg(abs(distance - sample * 100 * (1 + start % 3))) filter (where step = 3) fde from x, range(4) n(sample) group by 1, 2), r as (select *, row_number() over (partition by start order by ade, sample) k, sum(ade) over (partition by start) total from q) select start as window, sample::int sample, round(ade, 6) ade, round(fde, 6) fde, round(total, 6) total, 4 k from r where k = 1"),
    "integrated": (integrated, f"{_STEPS}, dd as (select *, coalesce(lon - lag(lon) over o, 0) d_lon, coalesce(lat - lag(lat) over o, 0) d_lat from t window o as (partition by start, vessel_id order by step)), z as (select p.start, p.vessel_id, p.step - 3 step, sum(p.sog / 100) over o + l.d_lon v_lon, sum(p.sog / -200) over o + l.d_lat v_lat, l.lon, l.lat from dd p join dd l on p.start = l.start and p.vessel_id = l.vessel_id and l.step = 3 where p.step > 3 window o as (partition by p.start, p.vessel_id order by p.step)) select start as window, vessel_id, step::int step, round(sum(v_lon) over o + lon, 6) lon, round(sum(v_lat) over o + lat, 6) lat from z window o as (partition by start, vessel_id order by step)"),
    "absolute": (absolute, f"{_STEPS} select start as window, vessel_id, step::int step, round(lon, 6) lon, round(lat, 6) lat from t"),
    "position_loss": (position_loss, f"{_HELD}, h as (select start, step, avg((case when abs(lon - t_lon) <= 1 then 0.5 * (lon - t_lon) ** 2 else abs(lon - t_lon) - 0.5 end + case when abs(lat - t_lat) <= 1 then 0.5 * (lat - t_lat) ** 2 else abs(lat - t_lat) - 0.5 end) / 2) loss from x group by 1, 2) select start as window, round(sum((3 - (step - 1)) / 6.0 * loss) * 10, 3) loss from h group by 1"),
    "gaussian_nll": (gaussian_nll, f"with {_HOURS}, q as (select ordinal, sog / 40 - 0.4 zx, heading / 360 - 0.5 zy, exp(lat / 100 - case when lat < 10 then 20 else 0 end) sx, exp(0.2) sy, tanh(case when sog > 39 then 30 else sog / 80 - 0.2 end) rho from a), r as (select *, greatest(sx * sy, 1e-6) area, greatest(1 - rho ** 2, 1e-6) free from q) select ordinal, round(-ln(greatest(exp(greatest(-700, -((zx / sx) ** 2 + (zy / sy) ** 2 - 2 * (rho * zx * zy) / area) / (2 * free))) / (2 * pi() * (area * sqrt(free))), 1e-20)), 6) nll from r"),
    "published_ratio": (published_ratio, f"{_HELD}, z0 as (select step, avg(d) d from (select start, step, avg(distance) d from x group by start, step) group by step), pb as (select * from (values (10, 0.000609::double), (20, 0.000853::double), (30, 0.001157::double), (40, 0.001522::double), (50, 0.002436::double)) t(horizon, published)) select n.step::int * 10 horizon, round(d, 6) distance, published, case when d is null then 'N/A' else format('{{:.2f}}', d / published) end ratio from range(1, 6) n(step) left join z0 on z0.step = n.step join pb on pb.horizon = n.step * 10"),
    "best_epoch": (best_epoch, "select event_type kind, arg_min(event_id, {'loss': value, 'epoch': event_id}) epoch, min(value) loss from events group by 1"),
    "scalar_helpers": (scalar_helpers, f"with {_HOURS} select ordinal, round(case when lat = 0 then 0 else 1 / lat end, 9) inverse, abs(round(sog - 20)) < abs(round(lat - 50)) or (abs(round(sog - 20)) = abs(round(lat - 50)) and round(sog - 20) < round(lat - 50)) closer, round(case when sog / 40 > 0.5 then sog / 40 else 0 end, 9) kept from a"),
    "profile_sizes": (profile_sizes, f"{_SPLIT} select split, count(*) as rows, count(distinct vessel_id) vessels, count(distinct frame_id) frames from y group by split"),
    "profile_segments": (profile_segments, f"{_RUNS} select * from r3"),
    "profile_density": (profile_density, f"{_SPLIT}, q as (select split, frame_id, count(distinct vessel_id) n from y group by 1, 2) select split, round(avg(n), 6) mean, median(n) median, min(n) least, max(n) most, round(avg((n < 2)::int::double) * 100, 6) lonely_percent from q group by split"),
    "profile_gaps": (profile_gaps, f"{_SPLIT}, q as (select split, frame_id, frame_id - lag(frame_id) over (partition by split order by frame_id) step from (select distinct split, frame_id from y)) select split, min(frame_id) first_frame, max(frame_id) last_frame, sum(case when step > 1 then 1 else 0 end)::bigint gaps from q group by split"),
    "profile_verdicts": (profile_verdicts, f"{_RUNS}, n as (select * from (values ('train'), ('val'), ('test')) t(split)), w as (select coalesce(sum(windows), 0) c from r3), sd as (select unnest(['lon', 'lat']) about, unnest([(select stddev_samp(lon) from y), (select stddev_samp(lat) from y)]) v) select split about, 'missing split' issue from n where split not in (select split from r3) union all select 'windows', case when c < 1000 then 'under 1000 windows' else 'under 10000 windows' end from w where c < 10000 union all select about, 'deviation under 0.1' from sd where v < 0.1"),
    "profile_total": (profile_total, f"{_RUNS} select coalesce(sum(windows), 0)::bigint windows from r3"),
    "expected_ranges": (expected_ranges, f"with {_HOURS}, t as (" + " union all ".join(f"select '{c}' about, avg(100 * {c} - 133) mean, stddev_samp({c}) std, {m[0]} m0, {m[1]} m1, {d[0]} d0, {d[1]} d1 from a" for c, (m, d) in EXPECTED_STATS.items()) + ") select about, round(mean, 4) mean, round(std, 4) std, mean between m0 and m1 mean_ok, std between d0 and d1 std_ok from t"),
    "parsed_times": (parsed_times, "select event_id ordinal, date_trunc('second', ts) ts from events where event_id % 7 <> 0"),
    "region_counts": (region_counts, f"with {_HOURS}, p as (select 25 + lat / 4 lat, -130 + lon % 70 lon from a), r as (select case " + " ".join(f"when lat between {la[0]} and {la[1]} and lon between {lo[0]} and {lo[1]} then '{n}'" for n, (la, lo) in REGIONS.items()) + " end region from p) select region, count(*) n from r group by region"),
    "flattened": (flattened, "select 'events' source_file, floor(epoch_us(ts) // 1000 / 600000)::int frame_id, 100000000 + user_id vessel_id, round(value, 6) lon, json_extract(props, '$.k')::int::double lat from events"),
    "batch_losses": (batch_losses, "select event_type kind, (event_id // 32)::bigint batch, round(sum(value) / 32, 6) loss from events group by 1, 2"),
    "window_numbers": (window_numbers, f"{_WINDOWED} select start, vessel_id, dense_rank() over (order by start) - 1 as window from v"),
    "shuffled_windows": (shuffled_windows, f"{_WINDOWED} select start, vessel_id from v"),
    "window_nodes": (window_nodes, f"{_STEPS}, dd as (select *, coalesce(lon - lag(lon) over o, 0) d_lon, coalesce(lat - lag(lat) over o, 0) d_lat from t window o as (partition by start, vessel_id order by step)) select start, step::int step, count(*)::int n, round(arg_min(d_lon, vessel_id), 6) first_lon, round(arg_max(d_lat, vessel_id), 6) last_lat from dd group by start, step"),
    "sampled": (sampled, f"with {_HOURS} select ordinal, 20 n, true near from a"),
    "frames_job": (frames_job, _JOB),
}
