"""A run's epochs as an append-only table: what was measured, where to go on, and the best epoch so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run string, kind string, epoch long, loss double, checkpoint string, attempt long"


def append(epochs: DataFrame, path: str, attempt: int) -> None:
    """epochs: run, kind, epoch, loss, and checkpoint, the place of what the epoch saved (may be null). attempt numbers the writes of
    a run: a run that was resumed writes with the next number."""
    epochs.select("run", "kind", F.col("epoch").cast("long"), F.col("loss").cast("double"), F.col("checkpoint").cast("string"), F.lit(attempt).cast("long").alias("attempt")).write.mode("append").parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run, kind and epoch: that of the last attempt; rows written twice by a retried job count once."""
    rows = spark.read.schema(LOG).parquet(path)
    last = rows.groupBy("run", "kind", "epoch").agg(F.max(F.struct("attempt", "loss", "checkpoint")).alias("x"))
    return last.select("run", "kind", "epoch", "x.loss", "x.checkpoint")


def resume_at(rows: DataFrame) -> DataFrame:
    """run, epoch, checkpoint: the epoch to go on with, one after the last that every kind of the run has, and what to load."""
    kinds = rows.groupBy("run").agg(F.count_distinct("kind").alias("kinds"))
    full = rows.groupBy("run", "epoch").agg(F.count("*").alias("n"), F.max("checkpoint").alias("checkpoint")).join(kinds, "run").where("n = kinds")
    last = full.groupBy("run").agg((F.max("epoch") + 1).alias("epoch"), F.max_by("checkpoint", "epoch").alias("checkpoint"))
    return rows.select("run").distinct().join(last, "run", "left").fillna(0, ["epoch"])


def best(rows: DataFrame) -> DataFrame:
    """run, kind, epoch, loss, checkpoint of the least loss of each kind; of ties the first epoch."""
    top = rows.where("loss is not null and not isnan(loss)").groupBy("run", "kind").agg(F.min(F.struct("loss", "epoch", "checkpoint")).alias("x"))
    return top.select("run", "kind", "x.epoch", "x.loss", "x.checkpoint")


def latest(rows: DataFrame) -> DataFrame:
    """run, kind, epoch, loss of the last epoch of each kind."""
    return rows.groupBy("run", "kind").agg(F.max("epoch").alias("epoch"), F.max_by("loss", "epoch").alias("loss"))
