"""Raw observation files as a Spark data source: spark.read.format("obs_fcst_ana").

A partition is a file. The name of a file tells its experiment and analysis time, so a window of time and a list of experiments
decide which files are opened at all; read_window() gives both to the source and filters the rows too. Only the records of
the columns in the schema are decoded. Files are listed by the driver, one name for each analysis time.

The window goes in by options and not by pushed filters: Spark 4.1 keeps the filters of one query in the table of a DataFrame, and
another query of the same DataFrame then misses rows. Paths are those that pyarrow opens: local and mounted folders, and object
stores by their URI.

Cases: a file whose name holds no time is always read; an empty folder gives no rows, a missing one is an error; a file that is
broken or shorter than it says is an error.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ingest import _NULLABLE, _OBS, _schema, records

NAME = "obs_fcst_ana"
SCHEMA = "exp string, time timestamp, " + _schema(_OBS).replace("assim long", "assim boolean")
#: Fixed format: the experiment before the first dot, the time (to the minute) at the end.
_FILE = re.compile(r"^(?:([^.]+)\..*?)?(\d{8}_\d{4})z\.bin$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if re.match(r"^file:/[^/]", path):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def named(path: str) -> tuple[str | None, datetime | None]:
    """Experiment and time of a file's name."""
    m = _FILE.match(posixpath.basename(path))
    try:
        return (m[1], datetime.strptime(m[2], "%Y%m%d_%H%M")) if m else (None, None)
    except ValueError:
        return None, None


def may_hold(when: datetime | None, exp: str | None, after: datetime | None, until: datetime | None, exps: list[str] | None) -> bool:
    """Whether a file can have rows in (after, until] of these experiments; its name leaves out the seconds."""
    if when is not None and ((after and when + timedelta(seconds=59) <= after) or (until and when > until)):
        return False
    return exp is None or exps is None or exp in exps


def instant(text: str | None) -> datetime | None:
    """A time of an option, without a zone, in UTC; one without an offset is in UTC."""
    t = datetime.fromisoformat(text) if text else None
    return t.astimezone(UTC).replace(tzinfo=None) if t and t.tzinfo else t


class File(ds.InputPartition):
    def __init__(self, path: str, exp: str | None):
        super().__init__(path)
        self.exp = exp


class ObsReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.exp, self.order, self.nodata = options.get("exp"), options.get("order", "<"), float(options.get("nodata", "-9999"))
        self.after, self.until = instant(options.get("after")), instant(options.get("until"))
        self.exps = json.loads(options["exps"]) if "exps" in options else None

    def partitions(self) -> list[File]:
        system, root = opened(self.path)
        found = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith(".bin"))
        files = [(path, *named(path)) for path in found]
        # Spark runs at least one task; a partition without a path gives no rows.
        return [File(path, self.exp or exp) for path, exp, when in files if may_hold(when, self.exp or exp, self.after, self.until, self.exps)] or [File("", None)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        system, _ = opened(self.path)
        with system.open_input_stream(partition.value) as stream:
            parts = records(stream.read(), self.order)
        n, *when = struct.unpack(f"{self.order}9i", next(parts))
        out = {"exp": pa.array([partition.exp] * n, pa.string()), "time": pa.array(np.full(n, np.datetime64(datetime(*when[:6]), "us")), pa.timestamp("us", "UTC"))}
        for name, kind in _OBS:
            data = next(parts, b"")
            if len(data) != 4 * n:
                raise ValueError(f"{len(data) // 4} values of {name}, {n} announced in {partition.value}")
            if name not in self.columns:
                continue
            v = np.frombuffer(data, self.order + kind)
            if kind == "i4":
                out[name] = pa.array(v != 0) if name == "assim" else pa.array(v.astype("i8"))
            else:
                v = v.astype("f8")
                out[name] = pa.array(v, mask=np.abs(v - self.nodata) < 1e-4 * abs(self.nodata) if name in _NULLABLE else None)
        yield pa.RecordBatch.from_arrays([out[c] for c in self.columns], names=self.columns)


class ObsSource(ds.DataSource):
    """Options: path; exp, where names don't tell it; order (< or >) of bytes; nodata; after, until, and exps (JSON): files to open."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ObsReader:
        return ObsReader(schema, self.options)


def read_window(
    spark: SparkSession, path: str, after: datetime | None = None, until: datetime | None = None, exps: list[str] | None = None, columns: list[str] | None = None, **options: str
) -> DataFrame:
    """Rows in (after, until] of the experiments: only their files are opened, and only the records of the columns decoded.

    A time without a zone is in UTC. None means all; rows of no known experiment pass only without exps.
    """
    spark.dataSource.register(ObsSource)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    needed = list(dict.fromkeys([*(columns or kinds), "time", "exp"]))
    reader = spark.read.format(NAME).schema(", ".join(f"{c} {kinds[c]}" for c in needed)).options(**options)
    edges = {k: v.replace(tzinfo=v.tzinfo or UTC) for k, v in (("after", after), ("until", until)) if v is not None}
    for k, v in edges.items():
        reader = reader.option(k, v.isoformat())
    df = (reader.option("exps", json.dumps(exps)) if exps is not None else reader).load(path)
    micros = {k: F.lit(round(v.timestamp() * 1e6)) for k, v in edges.items()}
    if "after" in edges:
        df = df.where(F.unix_micros("time") > micros["after"])
    if "until" in edges:
        df = df.where(F.unix_micros("time") <= micros["until"])
    return (df if exps is None else df.where(F.col("exp").isin(exps))).select(*(columns or kinds))


def write_files(files: DataFrame, folder: str) -> int:
    """Write (path, content) as files in a folder; returns how many. A task that is repeated replaces its files as a whole."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = opened(folder)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                target = posixpath.join(root, path)
                part = f"{target}.{uuid.uuid4().hex}.part"
                system.create_dir(posixpath.dirname(target), recursive=True)
                with system.open_output_stream(part) as stream:
                    stream.write(content)
                system.move(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(write, "n long").agg({"n": "sum"}).first()[0] or 0
