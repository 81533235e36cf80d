"""Climatologies: sliding and circular windows over the year, percentiles, and eight-day slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import eight_day_slot, pentad
from ..functions.numeric import ratio
from .order_stats import order_statistics

PENTADS, SLOTS, DAYS = 73, 46, 365


def around(center: Column, reach: int, size: int) -> Column:
    """The places within reach of one on a circle of `size` places, from 1."""
    return F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.pmod(center - 1 + d, F.lit(size)) + 1)


def to_pentads(daily: DataFrame, days: int) -> DataFrame:
    """Daily rows (doy) once for each pentad whose middle day is within days // 2, around the year's end too.

    A pentad's middle is day 5 p - 2, and these middles divide the circle of 365 days evenly; day 366 counts as day 365.
    """
    day, half = F.least(F.col("doy"), F.lit(DAYS)), days // 2
    hits = F.sequence(F.ceil((day - half + 2) / 5), F.floor((day + half + 2) / 5))
    spread = daily.withColumn("pentad", F.explode(hits))
    return spread.withColumn("pentad", (F.pmod(F.col("pentad") - 1, F.lit(PENTADS)) + 1).cast("int"))


def clim_stats(df: DataFrame, keys: list[str], value: str, k: int = 5, least: int = 1) -> DataFrame:
    """Mean, sample deviation, extremes and number per key and pentad, over a circular window of k pentads; nulls don't count.

    Each pentad is summed up by itself, and windows add up k sums in place of k copies of each sample; squares are about the
    pentads' own means.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*keys, pentad(F.col("time")).alias("pentad"))
    sums = own.agg(F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("c"))
    w = Window.partitionBy(*keys, "pentad")
    pooled = sums.withColumn("pentad", F.explode(around(F.col("pentad"), k // 2, PENTADS)))
    pooled = pooled.withColumn("mean", F.sum(F.col("m") * F.col("c")).over(w) / F.sum("c").over(w))
    squares = F.sum(F.col("ss") + F.col("c") * (F.col("m") - F.col("mean")) ** 2)
    stats = pooled.groupBy(*keys, "pentad").agg(F.first("mean").alias("mean"), F.sqrt(F.try_divide(squares, F.nullif(F.sum("c") - 1, F.lit(0)))).alias("stdv"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("c").alias("n"))
    return stats.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("mean", "stdv", "min", "max")})


def clim_percentiles(df: DataFrame, keys: list[str], value: str, percents: list[int], k: int = 5) -> DataFrame:
    """Values at rank round(p / 100 * N), at least 1, of circular windows of k pentads: exact, by order_statistics()."""
    placed = df.withColumn("pentad", pentad(F.col("time")))
    ranks = {f"p{p:02d}": lambda n, p=p: F.greatest(F.floor((n * p + 50) / 100), F.lit(1)) for p in percents}
    return order_statistics(placed, keys, value, ranks, "pentad", around(F.col("pentad"), k // 2, PENTADS))


def day_spine(df: DataFrame, keys: list[str], days: int = DAYS) -> DataFrame:
    """Every key with every day of the year, so that missing days count in windows."""
    return df.select(*keys).distinct().withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(days))))


def sliding_day_stats(daily: DataFrame, keys: list[str], width: int, least: int, inner: int = 0) -> DataFrame:
    """Trailing windows of daily sums (n, s, ss), labelled by their middle day, where the window is full; pentad output days only.

    inner: days in the middle that need at least least / 2.5 samples by themselves.
    """
    full = day_spine(daily, keys).join(daily, [*keys, "doy"], "left")
    w = Window.partitionBy(*keys).orderBy("doy")
    over = lambda c, a, b: F.coalesce(F.sum(c).over(w.rangeBetween(a, b)), F.lit(0))
    half = (width - inner) // 2
    out = full.select(
        *keys, F.col("doy"), *(over(c, 1 - width, 0).alias(c) for c in ("n", "s", "ss")), (over("n", 1 - width + half, -half) if inner else F.lit(None).cast("long")).alias("inner_n")
    )
    middle = F.col("doy") - width // 2
    ok = F.col("n") >= least
    if inner:
        ok = ok & (F.col("inner_n") >= least / 2.5)
    mean = ratio(F.col("s"), F.col("n"))
    sd = F.sqrt(F.greatest(ratio(F.col("ss"), F.col("n")) - mean * mean, F.lit(0.0)))
    out = out.where(F.col("doy") >= width).withColumn("middle", middle).where((F.col("middle") + 2) % 5 == 0)
    return out.select(*keys, ((F.col("middle") + 2) / 5).cast("int").alias("pentad"), "n", F.when(ok, mean).alias("mean"), F.when(ok, sd).alias("stdv"))


def clim_8day(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Means of the eight-day slots; negative values count as 0."""
    return df.groupBy(*keys, eight_day_slot(F.col("time")).alias("slot")).agg(F.avg(F.greatest(value, F.lit(0.0))).alias(value))


def circular_slot_mean(slots: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of each slot and its two neighbours, around the year's end."""
    return slots.withColumn("slot", F.explode(around(F.col("slot"), 1, SLOTS))).groupBy(*keys, "slot").agg(F.avg(value).alias(value))


def pass_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ascending and descending passes in one field: the mean of what is there."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def clim_at(points: DataFrame, clim: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A pentad climatology at dates, linear between the pentads' middles, around the year's end."""
    doy = F.least(F.dayofyear("time"), F.lit(DAYS))
    before = F.floor((doy + 2) / 5)
    share = (doy - (before * 5 - 2)) / 5
    placed = points.withColumns({"__share": share, "__p0": (F.pmod(before - 1, F.lit(PENTADS)) + 1).cast("int"), "__p1": (F.pmod(before, F.lit(PENTADS)) + 1).cast("int")})
    for n in ("0", "1"):
        placed = placed.join(clim.select(*keys, F.col("pentad").alias(f"__p{n}"), F.col(value).alias(f"__v{n}")), [*keys, f"__p{n}"], "left")
    return placed.select(*points.columns, (F.col("__v0") * (1 - F.col("__share")) + F.col("__v1") * F.col("__share")).alias(value))


def to_wetness(df: DataFrame, tiles: DataFrame, value: str) -> DataFrame:
    """Contents as a share of the porosity; null where that is 0."""
    return df.join(tiles.select("tile", "porosity"), "tile").withColumn(value, ratio(F.col(value), F.col("porosity"))).drop("porosity")


def clamp_fractions(clim: DataFrame, columns: list[str]) -> DataFrame:
    """Fractions above 1 become 1; deviations and numbers stay."""
    return clim.withColumns({c: F.least(F.col(c), F.lit(1.0)) for c in columns})


def daily_composite(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(F.to_date("time").alias("day"), *keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))
