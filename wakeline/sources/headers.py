"""Delimited files whose columns stand in any order: each file is read by its own header.

Only headers come to the driver, a line of each file, read through Hadoop's file systems as Spark's own listing is. Files are grouped
by header; each group is one scan that parses the columns asked for and no others, and the groups are united by name.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as missing in a field, fixed values.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Headers that are read at the same time.
READERS = 16


class NoFiles(ValueError):
    """A folder holds no file that fits."""


def _first_line(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = at.getFileSystem(conf).open(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def headers(spark: SparkSession, files: Iterable[str]) -> dict[str, tuple[str, ...]]:
    """The column names of each file. A file without a header line is an error that names it."""
    files = list(files)
    with ThreadPoolExecutor(READERS) as pool:
        lines = dict(zip(files, pool.map(lambda f: _first_line(spark, f), files), strict=True))
    if bare := sorted(f for f, line in lines.items() if not (line or "").strip("﻿\r\n ")):
        raise ValueError(f"no header in {', '.join(bare)}")
    return {f: tuple(next(csv.reader([line.lstrip("﻿")]))) for f, line in lines.items()}


def _names(header: tuple[str, ...]) -> list[str]:
    """Of columns with one name the first keeps it."""
    return [name if name not in header[:i] else f"{name}.{i}" for i, name in enumerate(header)]


def known(c: Column) -> Column:
    """A field, null where it is one of MISSING."""
    return F.when(~c.isin(*MISSING), c)


def by_name(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], names: str | None = None) -> DataFrame:
    """The columns as text, with source_file and ordinal (the order of a file's rows); other columns are not parsed.

    A file that lacks a column is an error that names both. names: a glob that file names must fit.
    """
    plain = spark.read.option("pathGlobFilter", names) if names else spark.read
    files = plain.text(path).inputFiles()
    if not files:
        raise NoFiles(f"no files {names or ''} under {path}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in headers(spark, files).items():
        if lacking := [c for c in columns if c not in header]:
            raise ValueError(f"missing columns: {', '.join(lacking)} in {file}")
        groups.setdefault(header, []).append(file)

    def scan(header: tuple[str, ...], own: list[str]) -> DataFrame:
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in _names(header))
        rows = spark.read.schema(schema).option("header", True).csv(own)
        return rows.select(*[known(F.col(f"`{c}`")).alias(c) for c in columns], F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("ordinal"))

    return reduce(DataFrame.unionByName, [scan(h, own) for h, own in groups.items()])
