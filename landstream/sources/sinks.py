"""Sinks: monthly sums that skip finished months, statistics, diagnostics, climatologies, and a guard of configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_monthly_sums(sums: DataFrame, path: str) -> list[str]:
    """Write months that the manifest lacks, each as a partition, then add them to it; the months that were written.

    Rows go by month before they are written, large months in parts, so that files don't grow with tasks times months.
    """
    spark = sums.sparkSession
    dated = sums.withColumn("month", F.date_format("month", "yyyy-MM-dd"))
    done = _read(spark, f"{path}/manifest")
    if done is not None:
        dated = dated.join(done.select("month"), "month", "left_anti")
    dated.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/sums")
    written = spark.read.parquet(f"{path}/sums").select(F.date_format(F.col("month").cast("date"), "yyyy-MM-dd").alias("month")).distinct()
    if done is not None:
        written = written.join(done.select("month"), "month", "left_anti")
    months = sorted(r[0] for r in written.collect())  # one row a month
    if months:
        spark.createDataFrame([(m,) for m in months], "month string").write.mode("append").parquet(f"{path}/manifest")
    return months


def config_guard(spark: SparkSession, path: str, config: dict) -> None:
    """Refuse to go on in a folder whose sums were made with another configuration; note it in a new one."""
    text = json.dumps(config, sort_keys=True)
    held = _read(spark, f"{path}/config")
    if held is None:
        spark.createDataFrame([(text,)], "config string").coalesce(1).write.parquet(f"{path}/config")
    elif (old := held.first()["config"]) != text:
        raise ValueError(f"{path} was made with another configuration: {old}")


def write_stats(stats: DataFrame, path: str, fill: float | None = None) -> None:
    (stats if fill is None else stats.na.fill(fill)).write.mode("overwrite").parquet(path)


def write_diagnostics(df: DataFrame, path: str) -> None:
    """By species, then tile: ranges of the order become files."""
    df.repartitionByRange("species", "tile").sortWithinPartitions("species", "tile").write.mode("overwrite").parquet(path)


def write_climatology(clim: DataFrame, path: str, fractions: list[str], arrays: list[str] = ()) -> None:
    """Fractions above 1 become 1; deviations and numbers stay."""
    out = clim.withColumns({c: F.least(F.col(c), F.lit(1.0)) for c in fractions} | {c: F.transform(c, lambda x: F.least(x, F.lit(1.0))) for c in arrays})
    out.write.mode("overwrite").parquet(path)


def write_constants(tiles: DataFrame, columns: list[str], path: str) -> None:
    tiles.select("tile", *columns).write.mode("overwrite").parquet(path)


def write_state(state: DataFrame, path: str, version: int) -> None:
    """A version of a keyed state, such as the observations' bias; older versions stay."""
    state.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The last version that is there."""
    all_ = spark.read.parquet(path)
    last = all_.agg(F.max("version")).first()[0]
    return all_.where(F.col("version") == last).drop("version")
