"""Data sources for files that Spark's own readers would hold whole: zip archives of reports and nested trajectory documents.

Both are Python data sources: register them with `register(spark)`, then spark.read.format("reports_zip") or
"nested_trajectories" with load(path). Files are opened through pyarrow's file systems (local paths and whatever URI it knows),
read in pieces and sent as Arrow batches, so neither an archive nor a document is ever in memory as a whole.
"""

from __future__ import annotations

import fnmatch
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a batch of reports, bytes read at once, and bytes of a document that one task starts trajectories in.
CHUNK_ROWS, READ_BYTES, SPLIT_BYTES = 50_000, 1 << 20, 64 << 20
REPORT_COLUMNS = ("MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading", "Status")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. file:/x counts as file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def listed(path: str, names: str) -> list[tuple[str, int]]:
    """Path and size of the files of a folder whose names fit the pattern, or of the one file that path names, in order."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    return sorted((prefix + f.path, f.size) for f in files if f.type == fs.FileType.File and (f is info or fnmatch.fnmatchcase(f.base_name, names)))


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ReportsZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p, _ in listed(self.options["path"], self.options.get("names", "AIS_*.[zZ][iI][pP]"))]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        inner, nrows = self.options.get("inner"), self.options.get("nrows")
        system, path = opened(partition.path)
        with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            found = [n for n in archive.namelist() if (n == inner if inner else n.lower().endswith(".csv"))]
            if not found:
                raise ValueError(f"no CSV member in {partition.path}")
            at = 0
            with archive.open(found[0]) as member:
                for part in pd.read_csv(member, usecols=list(REPORT_COLUMNS), dtype=str, chunksize=CHUNK_ROWS, nrows=int(nrows) if nrows else None):
                    texts = [pa.array(part[c], pa.string(), from_pandas=True) for c in REPORT_COLUMNS]
                    yield pa.record_batch([*texts, pa.array([partition.path] * len(part)), pa.array(range(at, at + len(part)), pa.int64())], [*REPORT_COLUMNS, "source_file", "ordinal"])
                    at += len(part)


class ReportsZip(DataSource):
    """A partition for each archive: the member named by `inner`, else the first that ends in .csv; an archive without one is an
    error. All fields are text, what is missing is null, ordinal counts a member's rows. Options: names, inner, nrows."""

    @classmethod
    def name(cls) -> str:
        return "reports_zip"

    def schema(self) -> str:
        return ", ".join([*(f"{c} string" for c in REPORT_COLUMNS), "source_file string", "ordinal long"])

    def reader(self, schema: object) -> DataSourceReader:
        return ReportsZipReader(self.options)


_OPEN, _CLOSE, _BETWEEN = re.compile(rb"\[\s*\["), re.compile(rb"\]\s*\]"), re.compile(rb"\s*(?:(,)|(\]))")
_EMPTY, _START, _NOTHING = re.compile(rb"\s*\[\s*\]"), re.compile(rb"\s*\["), re.compile(rb"\s*\]")


class Cutter:
    """Cuts an array of trajectories, each an array of points, into trajectories while it is read.

    A cutter yields the trajectories whose first bracket lies in [start, end) of the file. Two brackets that open one after the
    other always begin a trajectory, except at the very start, so a task can begin anywhere. What stands between trajectories is
    checked by the task of the one before: anything but one comma, and empty trajectories, is an error, and so is an end without
    the closing bracket.
    """

    def __init__(self, file: pa.NativeFile, path: str, start: int, end: int) -> None:
        self.file, self.path, self.start, self.end = file, path, start, end
        file.seek(start)
        # The buffer begins at byte `base` of the file; what lies before `at` is done with.
        self.buffer, self.base, self.at, self.over = b"", start, 0, False

    @property
    def place(self) -> int:
        return self.base + self.at

    def _more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.buffer, self.base, self.at = self.buffer[self.at :] + got, self.place, 0
        self.over = not got
        return bool(got)

    def _match(self, pattern: re.Pattern) -> re.Match | None:
        """A match at the place reached that more bytes could not change; all patterns need two bytes besides white space."""
        while True:
            m = pattern.match(self.buffer, self.at)
            if self.over or m and m.end() < len(self.buffer):
                return m
            if not m and any(len(self.buffer[self.at : self.at + n].translate(None, b" \t\r\n")) > 2 for n in (64, len(self.buffer))):
                return None
            self._more()

    def _taken(self, pattern: re.Pattern) -> re.Match | None:
        if m := self._match(pattern):
            self.at = m.end()
        return m

    def _bad(self, what: str) -> ValueError:
        return ValueError(f"{self.path}, byte {self.place}: {what}")

    def _to_first(self) -> bool:
        """Moves to the first trajectory of this part; False if there is none."""
        if self.start == 0:
            if not self._taken(_START):
                raise self._bad("no array of trajectories")
            if self._taken(_NOTHING):
                return self._end()
            return self._skip_empty()
        while not (m := _OPEN.search(self.buffer, self.at)):
            # The last bracket may be the first of a pair.
            rest = self.buffer.rstrip()
            self.at = max(self.at, len(rest) - 1 if rest.endswith(b"[") else len(self.buffer))
            if self.place >= self.end or not self._more():
                return False
        self.at = m.start()
        return self.place < self.end

    def _end(self) -> bool:
        while self._more():
            pass
        if self.buffer.strip():
            raise self._bad("text after the last trajectory")
        return False

    def _skip_empty(self) -> bool:
        """Moves over empty trajectories; False after the last one."""
        while self._taken(_EMPTY):
            if not self._next():
                return False
        if not self._taken(_START):
            raise self._bad("a trajectory must be an array")
        self.at -= 1
        return True

    def _next(self) -> bool:
        """Over what stands after a trajectory; False at the closing bracket."""
        m = self._taken(_BETWEEN)
        if not m:
            raise self._bad("expected a comma or the closing bracket")
        return self._end() if m[2] else True

    def __iter__(self) -> Iterator[tuple[int, list[list[float | None]]]]:
        if not self._to_first():
            return
        while self.place < self.end:
            looked = self.at
            while not (m := _CLOSE.search(self.buffer, looked)):
                # The last bracket may be the first of a pair.
                looked = max(self.at, len(self.buffer.rstrip()) - 1) - self.at
                if not self._more():
                    raise self._bad("a trajectory does not end")
            try:
                points = json.loads(self.buffer[self.at : m.end()])
                got = [[None if x is None else float(x) for x in p] for p in points if isinstance(p, list)]
            except (ValueError, TypeError) as wrong:
                raise self._bad(f"no trajectory: {wrong}") from wrong
            if len(got) != len(points):
                raise self._bad("a point must be an array")
            yield self.place, got
            self.at = m.end()
            if not self._next() or not self._skip_empty():
                return


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class TrajectoriesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Part]:
        size = int(self.options.get("split", SPLIT_BYTES))
        files = listed(self.options["path"], self.options.get("names", "*.json"))
        return [Part(p, at, at + size) for p, n in files for at in range(0, max(1, n), size)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.path)
        kind = pa.list_(pa.list_(pa.float64()))
        with system.open_input_file(path) as file:
            held, points = [], 0

            def batch() -> pa.RecordBatch:
                return pa.record_batch([pa.array([partition.path] * len(held)), pa.array([at for at, _ in held], pa.int64()), pa.array([t for _, t in held], kind)], ["source_file", "position", "trajectory"])

            for one in Cutter(file, partition.path, partition.start, partition.end):
                held.append(one)
                points += len(one[1])
                if points > CHUNK_ROWS:
                    yield batch()
                    held, points = [], 0
            if held:
                yield batch()


class NestedTrajectories(DataSource):
    """Documents that are an array of trajectories: a row for each that isn't empty, with the byte at which it stands. A document is
    dealt over tasks by bytes. Malformed documents are errors. Options: names, split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "nested_trajectories"

    def schema(self) -> str:
        return "source_file string, position long, trajectory array<array<double>>"

    def reader(self, schema: object) -> DataSourceReader:
        return TrajectoriesReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (ReportsZip, NestedTrajectories):
        spark.dataSource.register(source)
