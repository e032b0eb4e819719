"""Helpers that every operator of this subpackage shares: tables, folds, staged tables, salted look-ups."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


#: Rows of whole texts that go to Python at once; a Python worker and the Arrow buffers hold a few such batches.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text modulo 5; 0 marks the held-out rows. Null ids have no fold."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(col.cast("string")) % FOLDS).cast("int")


def held_out(doc_id: Column | str) -> Column:
    """Rows without an id are never learned from, so they count as held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where a single process runs all (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wakeline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Deletes a query's shuffle files when the query ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and lost executors lose nothing.

    The shuffle files of the write go when it ends. That costs nothing, as df is not run again. A table that nobody drops goes when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def owned(out: DataFrame, table: DataFrame) -> DataFrame:
    """out, a selection of a staged table: dropping it deletes that table."""
    _paths[out] = _paths.pop(table)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, small: DataFrame, key: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Left join in which a hot key of `rows` meets `salts` copies of its row of `small`.

    `small` has one row per key. Spark still broadcasts it if it is under the session's broadcast threshold.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*key, "_salt"], "left").drop("_salt")


def bounded_sample(rows: DataFrame, by: str, key: str, bound: int) -> DataFrame:
    """About `bound` rows of each value of `by`, all of them if there are fewer; chosen by a hash of `key`.

    `by` must have few values (labels, languages): one small grouped count comes to the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if all(n <= bound for n in counts.values()):
        return rows
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(share)
    return rows.where((F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0) < share)
