"""Ingest of binary and text files into tables: files are Spark's rows, decoded where they are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import null_if_nodata

#: Fixed format: the fields of each record, in their order in the files.
_OBS = [("assim", "i4"), ("species", "i4"), ("tilenum", "i4"), *((c, "f4") for c in ("lon", "lat", "obs", "obsvar", "fcst", "fcstvar", "ana", "anavar"))]
_TILE = [
    ("tile_id", "i4"), ("typ", "i4"), ("pfaf", "i4"), ("com_lon", "f4"), ("com_lat", "f4"), ("min_lon", "f4"), ("max_lon", "f4"), ("min_lat", "f4"), ("max_lat", "f4"),
    ("i_indg", "i4"), ("j_indg", "i4"), ("frac_cell", "f4"), ("frac_pfaf", "f4"), ("area", "f4"), ("elev", "f4"),
]
_GRID_INTS, _GRID_FLOATS = ["ind_base", "i_dir", "j_dir", "n_lon", "n_lat", "i_offg", "j_offg"], ["ll_lon", "ll_lat", "ur_lon", "ur_lat", "dlon", "dlat"]


def records(data: bytes, order: str = "<") -> Iterator[bytes]:
    """Sequential unformatted records: a length, the bytes, and the length again."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from(f"{order}i", data, at)
        if at + n + 8 > len(data) or struct.unpack_from(f"{order}i", data, at + 4 + n) != (n,):
            raise ValueError(f"broken record at byte {at}")
        yield data[at + 4 : at + 4 + n]
        at += n + 8


def _vectors(parts: Iterator[bytes], fields: list[tuple[str, str]], order: str) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(next(parts), order + kind).astype("i8" if kind[0] == "i" else "f8") for name, kind in fields}


def _joined(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _schema(fields: list[tuple[str, str]], extra: str = "") -> str:
    return extra + ", ".join(f"{n} {'long' if k[0] == 'i' else 'double'}" for n, k in fields)


def record(data: bytes, order: str = "<") -> bytes:
    """A sequential unformatted record."""
    n = struct.pack(f"{order}i", len(data))
    return n + data + n


def _packed(frame: pd.DataFrame, by: list[str], fields: list[tuple[str, str]], order: str, nodata: float = -9999.0) -> bytes:
    """A record for each field, rows in the order of the columns `by`; nulls are the sentinel."""
    at = np.lexsort([frame[c].to_numpy() for c in reversed(by)])
    columns = ((frame[name].to_numpy()[at], kind) for name, kind in fields)
    return b"".join(record((np.nan_to_num(v, nan=nodata) if kind[0] == "f" else v).astype(order + kind).tobytes(), order) for v, kind in columns)


def encode_obs_fcst_ana(df: DataFrame, order: str = "<", nodata: float = -9999.0) -> DataFrame:
    """(path, content): a file for each analysis time, as read_obs_fcst_ana() reads them."""

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        when = pd.Timestamp(frame["time"].iloc[0])
        head = struct.pack(f"{order}9i", len(frame), when.year, when.month, when.day, when.hour, when.minute, when.second, when.dayofyear, 0)
        body = _packed(frame, ["species", "tilenum"], _OBS, order, nodata)
        return pd.DataFrame({"path": [f"{when:%Y%m%d_%H%M}z.bin"], "content": [record(head, order) + body]})

    return df.select("time", *(n for n, _ in _OBS)).groupBy("time").applyInPandas(encode, "path string, content binary")


def encode_tiles(df: DataFrame, file: str, order: str = "<") -> DataFrame:
    """(path, content): a tile catalogue for each value of the column `file`."""

    def encode(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"{key[0]}.tilecoord.bin"], "content": [record(struct.pack(f"{order}i", len(frame)), order) + _packed(frame, ["tile_id"], _TILE, order)]})

    return df.select(file, *(n for n, _ in _TILE)).groupBy(file).applyInPandas(encode, "path string, content binary")


def encode_grids(df: DataFrame, file: str, order: str = "<") -> DataFrame:
    """(path, content): the global and the domain grid (column scope) for each value of the column `file`."""

    def encode(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.set_index("scope").loc[["global", "domain"]]
        parts = [r.gridtype.encode("ascii").ljust(40, b"\x00") + struct.pack(f"{order}7i6f", *(int(r[c]) for c in _GRID_INTS), *(float(r[c]) for c in _GRID_FLOATS)) for _, r in rows.iterrows()]
        return pd.DataFrame({"path": [f"{key[0]}.tilegrids.bin"], "content": [b"".join(record(p, order) for p in parts)]})

    return df.select(file, "scope", "gridtype", *_GRID_INTS, *_GRID_FLOATS).groupBy(file).applyInPandas(encode, "path string, content binary")


def species_text(df: DataFrame) -> DataFrame:
    """(value): the text of a catalogue of species, of which there are few; read_species() reads it."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "a":
            return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
        if kind == "b":
            return F.when(c, "T").otherwise("F")
        return F.concat(F.lit('"'), c, F.lit('"')) if kind == "t" else c.cast("string")

    lines = df.select("species", F.concat_ws("\n", *(cell(n, k) for n, k in _SPECIES)).alias("__lines"))
    listed = lines.agg(F.count("*").cast("string").alias("__n"), F.array_sort(F.collect_list(F.struct("species", "__lines"))).alias("__all"))
    return listed.select(F.concat_ws("\n", F.col("__n"), F.array_join(F.col("__all.__lines"), "\n")).alias("value"))


_NULLABLE = ("obsvar", "fcst", "fcstvar", "ana", "anavar")


def read_obs_fcst_ana(spark: SparkSession, path: str, exp: str, glob: str = "*.bin", order: str = "<", nodata: float = -9999.0) -> DataFrame:
    """One file per analysis time; sentinels become null, except in obs."""
    return decode_obs_fcst_ana(_files(spark, path, glob), exp, order, nodata)


def decode_obs_fcst_ana(files: DataFrame, exp: str, order: str = "<", nodata: float = -9999.0) -> DataFrame:
    """The rows of files (path, content)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, rows = [], 0
            for content in batch["content"]:
                parts = records(content, order)
                n, *when = struct.unpack(f"{order}9i", next(parts))
                vectors = _vectors(parts, _OBS, order)
                if any(len(v) != n for v in vectors.values()):
                    raise ValueError(f"{[len(v) for v in vectors.values()]} values, {n} announced")
                held.append({"time": np.full(n, np.datetime64(datetime(*when[:6]), "us")), **vectors})
                rows += n
                if rows > 100_000:
                    yield _joined(held)
                    held, rows = [], 0
            if held:
                yield _joined(held)

    raw = files.select("path", "content").mapInPandas(decode, _schema(_OBS, "time timestamp_ntz, "))
    cleaned = {c: null_if_nodata(F.col(c), nodata) for c in _NULLABLE}
    return raw.withColumns({**cleaned, "assim": F.col("assim") != 0, "time": F.col("time").cast("timestamp"), "exp": F.lit(exp)})


def write_obs_by_month(df: DataFrame, path: str) -> None:
    df.withColumn("month", F.date_format("time", "yyyy-MM")).write.mode("overwrite").partitionBy("exp", "month").parquet(path)


def read_tiles(spark: SparkSession, path: str, glob: str = "*tilecoord.bin", order: str = "<") -> DataFrame:
    return decode_tiles(_files(spark, path, glob), order)


def decode_tiles(files: DataFrame, order: str = "<") -> DataFrame:
    """The rows of files (path, content)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                parts = records(content, order)
                next(parts)
                yield pd.DataFrame(_vectors(parts, _TILE, order))

    return files.select("path", "content").mapInPandas(decode, _schema(_TILE))


def read_grids(spark: SparkSession, path: str, glob: str = "*tilegrids.bin", order: str = "<") -> DataFrame:
    """The global and the domain grid."""
    return decode_grids(_files(spark, path, glob), order)


def decode_grids(files: DataFrame, order: str = "<") -> DataFrame:
    """The rows of files (path, content)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for scope, part in zip(("global", "domain"), records(content, order), strict=False):
                    ints, floats = struct.unpack_from(f"{order}7i", part, 40), struct.unpack_from(f"{order}6f", part, 68)
                    name = part[:40].decode("ascii").strip("\x00 ")
                    out.append({"scope": scope, "gridtype": name, **dict(zip(_GRID_INTS, ints, strict=True)), **dict(zip(_GRID_FLOATS, floats, strict=True))})
                yield pd.DataFrame(out)

    schema = "scope string, gridtype string, " + ", ".join([*(f"{c} int" for c in _GRID_INTS), *(f"{c} double" for c in _GRID_FLOATS)])
    return files.select("path", "content").mapInPandas(decode, schema)


#: Fixed format: lines of a species in the catalogue: name and kind (t text, d number, i whole number, b flag, a numbers).
_SPECIES = [
    ("descr", "t"), ("species", "i"), ("orbit", "i"), ("pol", "i"), ("n_ang", "i"), ("ang", "a"), ("freq", "d"), ("fov", "d"), ("fov_units", "t"), ("assim", "b"), ("scale", "b"),
    ("getinnov", "b"), ("rtm_id", "i"), ("bias_npar", "i"), ("bias_trel", "i"), ("bias_tcut", "i"), ("nodata", "d"), ("varname", "t"), ("units", "t"), ("path", "t"), ("name", "t"),
    ("maskpath", "t"), ("maskname", "t"), ("scalepath", "t"), ("scalename", "t"), ("flistpath", "t"), ("flistname", "t"), ("errstd", "d"), ("std_normal_max", "d"), ("zeromean", "b"),
    ("coarsen_pert", "b"), ("xcorr", "d"), ("ycorr", "d"), ("adapt", "i"),
]
_KINDS = {"t": "string", "d": "double", "i": "int", "b": "boolean", "a": "array<double>"}


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """The text catalogue: a count, then one line a property. A whole file is one row; each species becomes one."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.split("value", "\r?\n").alias("l")).withColumn("k", F.explode(F.sequence(F.lit(0), F.trim(F.col("l")[0]).cast("int") - 1)))

    def cell(at: int, kind: str) -> Column:
        v = F.trim(F.element_at("l", F.col("k") * len(_SPECIES) + at + 2))
        if kind == "a":
            return F.transform(F.split(v, r"\s+"), lambda x: x.cast("double"))
        if kind == "b":
            return F.upper(v).rlike(r"^\.?T")
        return F.regexp_replace(v, '^"|"$', "").cast("string") if kind == "t" else v.cast("double").cast(_KINDS[kind])

    return lines.where("k >= 0").select(*(cell(i, k).alias(n) for i, (n, k) in enumerate(_SPECIES)))


OBS_LOG = "analysis_time string, descr string, reader string, n_obs int, file string"


def read_obs_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBS_LOG).option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)


def obs_log(df: DataFrame) -> DataFrame:
    """Counts per analysis time, species, reader and file."""
    counts = df.groupBy("analysis_time", "descr", "reader", "file").agg(F.count("*").cast("int").alias("n_obs"))
    return counts.select(F.date_format("analysis_time", "yyyyMMdd_HHmmss'z'").alias("analysis_time"), "descr", "reader", "n_obs", "file")


def files_in_window(listing: DataFrame, low: str, high: str, patterns: dict[str, int], first_year: int = 2007, last_year: int = 2100) -> DataFrame:
    """Files whose name holds a time in (low, high]. patterns: a part of the name, and where its 14 digits begin (from 1).

    Names that fit no pattern, or hold no valid time, go.
    """
    digits = F.coalesce(*(F.when(F.contains("name", F.lit(p)), F.substring("name", at, 14)) for p, at in patterns.items()))
    ts = F.try_to_timestamp(F.when(digits.rlike(r"^[0-9]{14}$"), digits), F.lit("yyyyMMddHHmmss"))
    named = listing.withColumn("ts", ts).where(F.year("ts").between(first_year, last_year))
    return named.where((F.col("ts") > F.lit(low).cast("timestamp")) & (F.col("ts") <= F.lit(high).cast("timestamp")))


def listed_over(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Names in the listings of two days, each once: a window that begins before midnight needs both."""
    return previous.select("name").unionByName(current.select("name")).distinct()


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """A text list of tile ids to exclude or include; lines that aren't numbers go."""
    return spark.read.text(path).select(F.expr("try_cast(split(trim(value), '[ ,]+')[0] AS BIGINT)").alias("tile")).where("tile IS NOT NULL")
