"""Ensemble statistics, perturbations, and recentring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip_abs, ratio
from ..sources.paths import shared
from .order_stats import order_statistics


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over members; the deviation is null for one member."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdv"), F.count(value).alias("n"))


def pred_mean_var(df: DataFrame, keys: list[str], value: str = "pred", inflation: float = 1.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.var_samp(value) * (inflation * inflation)).alias("var"))


def moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Sample covariance and deviations, and the third central moment (divided by N) of x."""
    m1, m2, m3 = F.avg(x), F.avg(F.col(x) ** 2), F.avg(F.col(x) ** 3)
    return df.groupBy(*keys).agg(F.covar_samp(x, y).alias("cov"), F.stddev_samp(x).alias("std_x"), F.stddev_samp(y).alias("std_y"), (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1).alias("third"))


def five_number(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Smallest, lower quartile, median, upper quartile, largest, by order statistics: of N sorted values those at ceil(N/4),
    ceil(N/2), and N + 1 - ceil(N/4)."""
    quarter = lambda n: F.ceil(n / 4)
    ranks = {"min": lambda n: F.lit(1), "q1": quarter, "median": lambda n: F.ceil(n / 2), "q3": lambda n: n + 1 - quarter(n), "max": lambda n: n}
    return order_statistics(df, keys, value, ranks).drop("n")


def center_members(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Subtract the mean over members where there are more than two and the field asks for it (column zeromean)."""
    w = Window.partitionBy(*keys)
    return df.withColumn(value, F.when(F.col("zeromean") & (F.count("*").over(w) > 2), F.col(value) - F.avg(value).over(w)).otherwise(F.col(value)))


def scale_to_std(df: DataFrame, keys: list[str], value: str, std: float) -> DataFrame:
    """Members scaled to a standard deviation; null where they have none to scale."""
    return df.withColumn(value, ratio(F.col(value) * std, F.stddev_samp(value).over(Window.partitionBy(*keys))))


def perturb_fields(df: DataFrame, roots: list[list[float]], fields: list[str], kinds: list[int], means: list[float], stds: list[float], most: float) -> DataFrame:
    """Correlated perturbations from independent ones: rotate by a correlation root, clip, shift and scale, exp for log-normal."""
    out = {}
    for i, f in enumerate(fields):
        z = clip_abs(sum(F.col(g) * F.lit(float(r)) for g, r in zip(fields, roots[i], strict=True)), most)
        x = F.lit(means[i]) + F.lit(stds[i]) * z
        out[f] = F.exp(x) if kinds[i] == 1 else x
    return df.withColumns(out)


def obs_perturbations(obs: DataFrame, noise: DataFrame, keys: list[str]) -> DataFrame:
    """Standard normal noise by cell and member, times the observation's error."""
    return obs.join(noise, keys).withColumn("pert", F.col("eps") * F.sqrt("obsvar"))


def average_members(df: DataFrame, keys: list[str], members: int, values: list[str]) -> DataFrame:
    """Means over members of records that all members have."""
    return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values), F.countDistinct("ens").alias("__m")).where(F.col("__m") == members).drop("__m")


def recenter(df: DataFrame, central: DataFrame, keys: list[str], additive: list[str], precip: list[str], radiation: str) -> DataFrame:
    """Move members so that their mean is the central record. Precipitation fields share one ratio to their summed mean, and
    radiation has its own; a ratio to nothing is 0."""
    w = Window.partitionBy(*keys)
    c = {v: f"__c_{v}" for v in [*additive, *precip, radiation]}
    joined = df.join(central.select(*keys, *(F.col(v).alias(n) for v, n in c.items())), keys)
    total = sum(F.col(v) for v in precip)
    mean_total, mean_rad = F.avg(total).over(w), F.avg(radiation).over(w)
    wet = F.when(mean_total > 1e-10, total / mean_total).otherwise(0.0)
    sun = F.when(mean_rad != 0, F.col(radiation) / mean_rad).otherwise(0.0)
    values = {v: F.col(v) + (F.col(c[v]) - F.avg(v).over(w)) for v in additive}
    values |= {v: wet * F.col(c[v]) for v in precip} | {radiation: sun * F.col(c[radiation])}
    return joined.select(*keys, "ens", *(x.alias(v) for v, x in values.items()))


def unique_groups(df: DataFrame, columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Rows with the number of their group: sorted, a row begins a new one if any column is apart from the row before by more
    than the relative tolerance. A null is only near a null.

    Distinct rows are sorted by ranges, each of which is numbered for itself; a table of one row a range carries the last row
    and the number of groups over to the next. The ranges are written once, so that they hold for all uses.
    """
    names = [f"__c{i}" for i in range(len(columns))]
    spark, path = df.sparkSession, shared(df.sparkSession, "ranges")
    ranged = df.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).distinct().repartitionByRange(*names)
    ranged.withColumn("__range", F.spark_partition_id()).write.parquet(path)
    row = F.struct(*names)
    rows = spark.read.parquet(path)
    last = rows.groupBy("__range").agg(F.max(row).alias("__last"))
    before = last.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__before"))
    order = Window.partitionBy("__range").orderBy(*names)
    rows = rows.join(before, "__range").withColumn("__before", F.coalesce(F.lag(row).over(order), "__before"))
    apart = F.col("__before").isNull()
    for n in names:
        old = F.col("__before")[n]
        near = (F.col(n).isNull() & old.isNull()) | F.coalesce(F.abs(F.col(n) - old) <= tolerance * F.abs(old), F.lit(False))
        apart = apart | ~near
    rows = rows.withColumn("__new", apart.cast("long")).withColumn("__inside", F.sum("__new").over(order))
    ahead = rows.groupBy("__range").agg(F.sum("__new").alias("__n"))
    ahead = ahead.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    numbered = rows.join(ahead, "__range").select(*names, (F.col("__ahead") + F.col("__inside")).alias("__group"))
    same = F.lit(True)
    for c, n in zip(columns, names, strict=True):
        same = same & df[c].eqNullSafe(numbered[n])
    return df.join(numbered, same).withColumnRenamed("__group", "group").drop(*names)
