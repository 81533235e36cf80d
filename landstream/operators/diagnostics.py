"""Diagnostics of observations, forecasts and analyses: mergeable monthly sums, statistics over time and space, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio

VARIABLES = ["obs", "obsvar", "fcst", "fcstvar", "ana", "anavar"]


def cross_mask(first: DataFrame, *others: DataFrame, obs_from: int = 0) -> DataFrame:
    """Keys whose obs is present in all experiments; fcst and ana come from the first, obs and obsvar from the one named."""
    keys = ["time", "tile", "species"]
    out = first.where(F.col("obs").isNotNull())
    for k, other in enumerate(others, 1):
        other = other.where(F.col("obs").isNotNull())
        if k == obs_from:
            out = out.drop("obs", "obsvar").join(other.select(*keys, "obs", "obsvar"), keys)
        else:
            out = out.join(other.select(*keys), keys, "left_semi")
    return out


def assimilated(df: DataFrame, species: DataFrame) -> DataFrame:
    """Rows of species that the catalogue assimilates stay only if they were assimilated."""
    flags = species.select("species", F.col("assim").alias("__assim"))
    return df.join(flags, "species").where(~F.col("__assim") | F.col("assim")).drop("__assim")


def monthly_sums(df: DataFrame, exact_norm: bool = True) -> DataFrame:
    """Per month, tile and species: number, sums, sums of squares and of products."""
    products = [F.sum(F.col(a) * F.col(b)).alias(n) for n, a, b in (("oxf_sum", "obs", "fcst"), ("oxa_sum", "obs", "ana"), ("fxa_sum", "fcst", "ana"))]
    sums = [x for v in VARIABLES for x in (F.sum(v).alias(f"{v}_sum"), F.sum(F.col(v) * F.col(v)).alias(f"{v}_sum2"))]
    if exact_norm:
        norm = ratio(F.col("obs") - F.col("fcst"), F.sqrt(F.col("obsvar") + F.col("fcstvar")))
        products += [F.sum(norm).alias("norm_sum"), F.sum(norm * norm).alias("norm_sum2")]
    month = F.trunc("time", "month").alias("month")
    return df.groupBy(month, "tile", "species").agg(F.count("*").alias("n"), *sums, *products)


def merge_sums(sums: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add partial sums; keys default to tile and species."""
    keys = keys or ["tile", "species"]
    values = [c for c in sums.columns if c == "n" or c.endswith(("_sum", "_sum2"))]
    return sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values))


def missing_months(sums: DataFrame, first: str, last: str) -> DataFrame:
    """Months of a period that have no sums; a merge over the period wants none."""
    spark = sums.sparkSession
    wanted = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 MONTH)) AS month")
    return wanted.join(sums.select("month").distinct(), "month", "left_anti")


def _var(total: str, squares: str) -> Column:
    mean = ratio(F.col(total), F.col("n"))
    return F.greatest(ratio(F.col(squares), F.col("n")) - mean * mean, F.lit(0.0))


def difference_stats(sums: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Means and population deviations of O, F, A, O-F and O-A, and O-F normalised by mean variances."""
    mean = {v: ratio(F.col(f"{v}_sum"), F.col("n")) for v in VARIABLES}

    def stdv(a: str, b: str, cross: str) -> Column:
        cov = ratio(F.col(cross), F.col("n")) - mean[a] * mean[b]
        return F.sqrt(F.greatest(_var(f"{a}_sum", f"{a}_sum2") + _var(f"{b}_sum", f"{b}_sum2") - 2 * cov, F.lit(0.0)))

    omf, omf_sd = mean["obs"] - mean["fcst"], stdv("obs", "fcst", "oxf_sum")
    scale = F.sqrt(mean["obsvar"] + mean["fcstvar"])
    stats = {
        "o_mean": mean["obs"], "o_stdv": F.sqrt(_var("obs_sum", "obs_sum2")), "f_mean": mean["fcst"], "f_stdv": F.sqrt(_var("fcst_sum", "fcst_sum2")),
        "a_mean": mean["ana"], "a_stdv": F.sqrt(_var("ana_sum", "ana_sum2")), "omf_mean": omf, "omf_stdv": omf_sd,
        "oma_mean": mean["obs"] - mean["ana"], "oma_stdv": stdv("obs", "ana", "oxa_sum"), "omf_norm_mean": ratio(omf, scale), "omf_norm_stdv": ratio(omf_sd, scale),
    }
    return sums.select(*keys, "n", *(F.when(F.col("n") >= least, c).alias(k) for k, c in stats.items()))


def temporal_stats(sums: DataFrame, least: int = 1) -> DataFrame:
    return difference_stats(merge_sums(sums), ["tile", "species"], least)


def temporal_stats_exact_norm(sums: DataFrame) -> DataFrame:
    """O-F normalised one by one before it is averaged."""
    merged = merge_sums(sums)
    return merged.select("tile", "species", "n", ratio(F.col("norm_sum"), F.col("n")).alias("omf_norm_mean"), F.sqrt(_var("norm_sum", "norm_sum2")).alias("omf_norm_stdv"))


def spatial_stats(sums: DataFrame) -> DataFrame:
    """All tiles of a month pooled, so that each observation weighs the same."""
    return difference_stats(merge_sums(sums, ["month", "species"]), ["month", "species"])


def species_weighted_mean(stats: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means over species weighted by number; deviations are averaged too, not pooled."""
    return stats.groupBy(*keys).agg(*(ratio(F.sum(F.col(v) * F.col("n")), F.sum(F.when(F.col(v).isNotNull(), F.col("n")))).alias(v) for v in values), F.sum("n").alias("n"))


def mask_min_n(df: DataFrame, least: int, values: list[str], n: str = "n") -> DataFrame:
    return df.withColumns({v: F.when(F.col(n) >= least, F.col(v)) for v in values})


def qa_summary(df: DataFrame, keys: list[str], fields: list[str], weight: str) -> DataFrame:
    """Per field: weighted mean, weighted population deviation, extremes, number and mean weight; nulls go together.

    Weights that sum to 0 give no mean and no deviation.
    """
    long = df.unpivot([*keys, weight], fields, "field", "value").where(F.col("value").isNotNull() & F.col(weight).isNotNull())
    w, x = F.col(weight), F.col("value")
    sums = long.groupBy(*keys, "field").agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"), F.min(x).alias("min"), F.max(x).alias("max"), F.count("*").alias("n")
    )
    mean = ratio(F.col("swx"), F.col("sw"))
    return sums.select(
        *keys, "field", mean.alias("mean"), F.when(F.col("sw") != 0, F.sqrt(F.greatest(ratio(F.col("swxx"), F.col("sw")) - mean * mean, F.lit(0.0)))).alias("stdv"), "min", "max", "n",
        (F.col("sw") / F.col("n")).alias("mean_weight"),
    )


def qa_innovations(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    omf = F.col("obs") - F.col("fcst")
    return qa_summary(df.withColumns({"omf": omf, "omf_norm": ratio(omf, F.sqrt(F.col("obsvar") + F.col("fcstvar")))}), keys, ["omf", "omf_norm"], weight)


def catalogue_mismatches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ordinals at which two experiments' species catalogues disagree in description or length; wants to be empty."""
    b = second.select("ordinal", F.col("descr").alias("descr2"))
    return first.select("ordinal", "descr").join(b, "ordinal", "full_outer").where(~F.col("descr").eqNullSafe(F.col("descr2")))
