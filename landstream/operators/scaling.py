"""Climatological rescaling of observations, and the statistics that it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import LatLonGrid
from ..functions.numeric import clip, polyval, ratio as divide
from .ranges import dealt, tasks


def scale_zscore(obs: DataFrame, parameters: DataFrame, keys: list[str], mean_only: bool = False) -> DataFrame:
    """Standard normal deviates: mean_mod + std_mod / std_obs * (obs - mean_obs); the error scales alike.

    A missing or invalid parameter gives a null obs.
    """
    p = parameters.select(*keys, "mean_obs", "std_obs", "mean_mod", "std_mod")
    valid = (F.col("mean_obs") > 0) & (F.col("mean_mod") > 0) & (F.col("std_obs") > 0) & (F.col("std_mod") >= 0)
    ratio = F.lit(1.0) if mean_only else divide(F.col("std_mod"), F.col("std_obs"))
    out = obs.join(p, keys, "left").withColumns({"obs": F.when(valid, F.col("mean_mod") + ratio * (F.col("obs") - F.col("mean_obs"))), "errstd": F.when(valid, ratio * F.col("errstd"))})
    return out.drop("mean_obs", "std_obs", "mean_mod", "std_mod")


def scale_zscore_grid(obs: DataFrame, parameters: DataFrame, grid: LatLonGrid) -> DataFrame:
    """scale_zscore by pentad and cell, kept within the model's range. parameters: pentad, i, j, o_mean ... m_max."""
    i, j = grid.cell(F.col("lon"), F.col("lat"))
    valid = (F.col("o_mean") > 0) & (F.col("m_mean") > 0) & (F.col("o_std") > 0) & (F.col("m_std") >= 0)
    ratio = divide(F.col("m_std"), F.col("o_std"))
    scaled = clip(F.col("m_mean") + ratio * (F.col("obs") - F.col("o_mean")), F.col("m_min"), F.col("m_max"))
    out = obs.withColumns({"i": i, "j": j}).join(parameters, ["pentad", "i", "j"], "left")
    return out.select(*obs.columns, F.when(valid, scaled).alias("scaled"), F.when(valid, ratio * F.col("errstd")).alias("scaled_errstd"))


def scale_cdf(obs: DataFrame, parameters: DataFrame, edge_min: float, edge_max: float) -> DataFrame:
    """A polynomial between min_obs and max_obs, straight lines from there to the edges, null beyond.

    A std_obs of 0 gives no error.
    """
    out = obs.join(parameters, "tile", "left")
    x = F.col("obs")
    y = polyval(F.col("coeff"), clip(x, F.col("min_obs"), F.col("max_obs")))
    below = divide(y - edge_min, F.col("min_obs") - edge_min) * (x - edge_min) + edge_min
    above = divide(edge_max - y, edge_max - F.col("max_obs")) * (x - F.col("max_obs")) + y
    value = F.when(x < F.col("min_obs"), below).when(x > F.col("max_obs"), above).otherwise(y)
    valid = x.between(edge_min, edge_max) & F.col("coeff").isNotNull()
    value = F.when(valid & value.between(edge_min, edge_max), value)
    return out.select(*obs.columns, value.alias("scaled"), F.when(valid, divide(F.col("std_mod"), F.col("std_obs")) * F.col("errstd")).alias("scaled_errstd"))


def daily_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and day of year, all years pooled: number, sums and squares of obs and mod, extremes of mod."""
    both = df.where(F.col("obs").isNotNull() & F.col("mod").isNotNull())
    doy = F.dayofyear("time").alias("doy")
    return both.groupBy(*keys, doy).agg(
        F.count("*").alias("n"), F.sum("obs").alias("so"), F.sum(F.col("obs") ** 2).alias("soo"), F.sum("mod").alias("sm"), F.sum(F.col("mod") ** 2).alias("smm"),
        F.min("mod").alias("m_min"), F.max("mod").alias("m_max"),
    )


def stats_of_sums(sums: DataFrame, keys: list[str], least: int) -> DataFrame:
    sd = lambda s, ss: F.sqrt(F.greatest(F.col(ss) / F.col("n") - (F.col(s) / F.col("n")) ** 2, F.lit(0.0)))
    ok = F.col("n") >= least
    values = {"o_mean": F.col("so") / F.col("n"), "o_std": sd("so", "soo"), "m_mean": F.col("sm") / F.col("n"), "m_std": sd("sm", "smm"), "m_min": F.col("m_min"), "m_max": F.col("m_max")}
    return sums.select(*keys, "n", *(F.when(ok, v).alias(k) for k, v in values.items()))


def scaling_stats(df: DataFrame, keys: list[str], days: int, least: int) -> DataFrame:
    """Statistics of obs and mod per key and pentad, over a window of days around each pentad's middle, all years pooled.

    Days are summed first; each daily sum then goes to the few pentads whose window holds it. Rows move once, by keys: daily sums and
    their copies stay in the task of their key.
    """
    from .climatology import to_pentads

    spread = to_pentads(daily_sums(dealt(df, keys, tasks(df)), keys), days)
    merged = spread.groupBy(*keys, "pentad").agg(*(F.sum(c).alias(c) for c in ("n", "so", "soo", "sm", "smm")), F.min("m_min").alias("m_min"), F.max("m_max").alias("m_max"))
    return stats_of_sums(merged, [*keys, "pentad"], least)


def scaling_stats_combined(df: DataFrame, keys: list[str], species: str, days: int, least: int) -> DataFrame:
    """scaling_stats per species, and with all species pooled (species null), in one pass of daily sums.

    Rows move once, by keys without the species, so that the species of a key are pooled where they are.
    """
    from .climatology import to_pentads

    spread = to_pentads(daily_sums(dealt(df, keys, tasks(df)), [*keys, species]), days)
    columns = ["n", "so", "soo", "sm", "smm"]
    both = spread.withColumn("__species", F.explode(F.array(F.col(species), F.lit(None)))).drop(species).withColumnRenamed("__species", species)
    merged = both.groupBy(*keys, species, "pentad").agg(*(F.sum(c).alias(c) for c in columns), F.min("m_min").alias("m_min"), F.max("m_max").alias("m_max"))
    return stats_of_sums(merged, [*keys, species, "pentad"], least)
