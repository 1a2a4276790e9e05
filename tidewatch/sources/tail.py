"""A streaming source that follows a growing CSV file: only complete lines, each once.

Spark's file source reads a file once and so misses what is appended later. Offsets here are bytes: a batch ends after the last complete line,
and an unfinished line waits. A file that got shorter is read from its start. Rows with another number of fields than
the header are counted in the column `skipped` of the next row, not returned. The path must be readable by the driver;
a batch of a single growing file is one partition.
"""

from __future__ import annotations

import csv
import glob
import math
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from tidewatch.schema import SENSOR_CHANNELS

SCHEMA = "TimeStamp string, AI0_Vibration double, AI1_Vibration double, AI2_Current double, Equipment_state int, Idle int, has_truth boolean, skipped int"
MAX_BYTES = 1 << 20


def _number(text: str | None, kind: type):
    """A field as a number; null for what isn't one, and for whole numbers also where it is NaN, infinite or out of range."""
    try:
        value = float(text or "nan")
        if kind is int:
            return int(value) if abs(value) < 2**31 else None
        return value if math.isfinite(value) else None
    except ValueError:
        return None


def parse(header: list[str], lines: list[str]) -> list[tuple]:
    """The rows of complete lines below a header; a missing state or idle column counts as 0."""
    out, skipped = [], 0
    for fields in csv.reader(lines):
        if len(fields) != len(header):
            skipped += bool(fields)
            continue
        row = dict(zip(header, fields, strict=True))
        out.append((row.get("TimeStamp"), *(_number(row.get(c), float) for c in SENSOR_CHANNELS), _number(row.get("Equipment_state"), int) or 0, _number(row.get("Idle"), int) or 0, "Equipment_state" in row, skipped))
        skipped = 0
    return out


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _lines(self, start: int, end: int | None) -> tuple[list[str], int]:
        """The complete lines from a place on: of about MAX_BYTES, or of one longer line. Only line feeds end a line."""
        with open(self.path, "rb") as f:
            f.seek(start)
            data = f.read(MAX_BYTES if end is None else end - start)
            while end is None and b"\n" not in data and (more := f.read(MAX_BYTES)):
                data += more
        data = data[: data.rfind(b"\n") + 1]
        lines = data.decode("utf-8-sig" if start == 0 else "utf-8").split("\n")[:-1]
        return [x.removesuffix("\r") for x in lines], start + len(data)

    def _header(self) -> list[str]:
        with open(self.path, "rb") as f:
            line = f.readline()
        return next(csv.reader([line.decode("utf-8-sig")])) if line.endswith(b"\n") else []

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["at"]
        if not os.path.exists(self.path):
            return iter([]), start
        if os.path.getsize(self.path) < at:
            at = 0
        header = self._header()
        if not header:
            return iter([]), {"at": at}
        lines, end = self._lines(at, None)
        return iter(parse(header, lines[at == 0 :])), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["at"] if start["at"] <= end["at"] else 0
        lines, _ = self._lines(at, end["at"])
        return iter(parse(self._header(), lines[at == 0 :]))


class CsvTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def tail_csv(spark: SparkSession, path: str):
    """A streaming DataFrame of the file's rows as they are completed."""
    spark.dataSource.register(CsvTail)
    return spark.readStream.format("csv_tail").option("path", path).load()


class FilePart(InputPartition):
    """Bytes [start, end) of a file: the lines that end there."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def identity(path: str) -> str:
    """Tells a file from another one put in its place: its number in the file system and a digest of its header line."""
    with open(path, "rb") as f:
        return f"{os.fstat(f.fileno()).st_ino}-{zlib.crc32(f.readline(4096)):08x}"


class FolderReader(DataSourceStreamReader):
    """Growing files of a folder, read on executors: the driver looks at their sizes only.

    The offset holds each file's identity and size. A file that got shorter, or that another one has replaced, is read from its start. A
    batch's part of a file is cut into pieces of MAX_PART bytes; a line belongs to the piece that its line feed is in.
    """

    MAX_PART = 32 << 20

    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                out[path] = [identity(path), os.path.getsize(path)]
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        parts = []
        for path, (own, size) in sorted(end.items()):
            old, at = start.get(path, ["", 0])
            at = at if old == own and at <= size else 0
            parts += [FilePart(path, i, min(size, i + self.MAX_PART)) for i in range(at, size, self.MAX_PART)]
        return parts

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            first = f.readline()
            if not first.endswith(b"\n"):
                return iter([])
            header = next(csv.reader([first.decode("utf-8-sig").rstrip("\r\n")]))
            at = line_start(f, partition.start)
            f.seek(at)
            data = f.read(partition.end - at)
        data = data[: data.rfind(b"\n") + 1]
        lines = data.decode("utf-8-sig" if at == 0 else "utf-8").split("\n")[:-1]
        return iter(parse(header, [x.removesuffix("\r") for x in lines][at == 0 :]))

    def commit(self, end: dict) -> None:
        pass


def line_start(f, place: int, step: int = 65_536) -> int:
    """Where the line begins that the byte before `place` is in or ends."""
    at = place
    while at:
        low = max(0, at - step)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


class CsvFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["pattern"])


def tail_folder(spark: SparkSession, pattern: str):
    """A streaming DataFrame of the rows of all files that match the pattern, as they are completed, read on executors.

    Driver and executors must see the files by the same path.
    """
    spark.dataSource.register(CsvFolder)
    return spark.readStream.format("csv_folder").option("pattern", pattern).load()
