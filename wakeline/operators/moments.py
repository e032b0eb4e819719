"""Statistics that merge: count, mean and sum of squared deviations by file, so new files need no second reading of the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.frames import FEATURES

STATE = "source_file string, column string, n long, mean double, m2 double"


def moments(df: DataFrame, columns: tuple[str, ...] = FEATURES, by: str = "source_file") -> DataFrame:
    """source_file, column, n, mean, m2: a row for each file and column; nulls don't count."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")) for c in columns]
    one = df.groupBy(F.col(by).alias("source_file")).agg(F.array(*parts).alias("parts"))
    return one.select("source_file", F.explode("parts").alias("p")).select("source_file", "p.*")


def merged(state: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """column, n, mean, m2 over all rows of the state (of each group `by`), whatever their order. Squares are taken around the
    common mean, which is known first: differences of large sums would lose digits."""
    own = Window.partitionBy(*by, "column")
    placed = state.where("n > 0").withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own))
    return placed.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"))


def finalised(state: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row of <column>_mean and <column>_std as frames.statistics gives it; a deviation that is 0 or unknown becomes 1."""
    one = merged(state)
    std = F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0)))
    safe = F.when(std.isNull() | F.isnan(std) | (std == 0), 1.0).otherwise(std)
    of = lambda c, x: F.max(F.when(F.col("column") == c, x))
    return one.agg(*[x for c in columns for x in (of(c, F.col("mean")).alias(f"{c}_mean"), F.coalesce(of(c, safe), F.lit(1.0)).alias(f"{c}_std"))])


def recorded(state: DataFrame, path: str, version: int) -> None:
    """Appends the state of some files. A file that is recorded again counts as its highest version says."""
    state.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def known(table: DataFrame) -> DataFrame:
    """The state that counts, a row for each file and column."""
    last = table.groupBy("source_file", "column").agg(F.max_by(F.struct("n", "mean", "m2"), "version").alias("s"))
    return last.select("source_file", "column", "s.*")


def entities(df: DataFrame) -> DataFrame:
    """Rows and distinct entities of all files: totals that need the ids, kept as distinct (file, id) rows."""
    return df.groupBy("source_file", "mmsi").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count_distinct("mmsi").alias("vessels"))
