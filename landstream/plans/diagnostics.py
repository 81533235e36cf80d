"""Queries of the diagnostics product: cross-mask, monthly sums, statistics over time and space, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import observations as O
from ..operators.ranges import dealt, tasks
from .fixtures import OBS, OBS1, ORDER, frame, sql
from .register import Registry

R = Registry()
KEYS = ["time", "tile", "species"]
STATS = "o_mean o_stdv f_mean f_stdv a_mean a_stdv omf_mean omf_stdv oma_mean oma_stdv omf_norm_mean omf_norm_stdv"
QA = "mean stdv min max mean_weight"
_VARS = "assim, obs, obsvar, fcst, fcstvar, ana, anavar"


def size(spark: SparkSession, sf: str) -> int:
    return tasks(frame(spark, sf, OBS))


def last_rows(spark: SparkSession, sf: str, *texts: str) -> tuple[DataFrame, ...]:
    """The last row of each key of some experiments, dealt alike, so that they are sorted once and meet without another shuffle."""
    n = size(spark, sf)
    return tuple(O.last_by(dealt(frame(spark, sf, text), KEYS, n), KEYS, ORDER) for text in texts)


def experiments(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    return tuple(df.select(*KEYS, "assim", *D.VARIABLES) for df in last_rows(spark, sf, OBS, OBS1))


def species(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, True, "one"), (2, True, "two"), (3, False, "three")], "species int, assim boolean, varname string")


def masked(spark: SparkSession, sf: str) -> DataFrame:
    a, b = experiments(spark, sf)
    return D.cross_mask(a, b)


def sums(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums; what merges the months of a tile and species stays in its task."""
    rows = D.assimilated(masked(spark, sf), species(spark))
    return D.monthly_sums(dealt(rows, ["tile", "species"], size(spark, sf)))


def _dedupe(text: str) -> str:
    order = ", ".join(f"{c} DESC" for c in ORDER)
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time, tile, species ORDER BY {order}) AS rn FROM {sql(text)}) WHERE rn = 1)"


MASKED = f"(SELECT a.time, a.tile, a.species, {', '.join('a.' + v for v in _VARS.split(', '))} FROM {_dedupe(OBS)} a JOIN {_dedupe(OBS1)} b USING (time, tile, species))"
_SUMS = ", ".join(f"sum({v}) AS {v}_sum, sum({v} * {v}) AS {v}_sum2" for v in D.VARIABLES)
SUMS = f"""(SELECT CAST(date_trunc('month', time) AS DATE) AS month, tile, species, count(*) AS n, {_SUMS}, sum(obs * fcst) AS oxf_sum, sum(obs * ana) AS oxa_sum,
 sum(fcst * ana) AS fxa_sum, sum((obs - fcst) / sqrt(obsvar + fcstvar)) AS norm_sum, sum((obs - fcst) * (obs - fcst) / (obsvar + fcstvar)) AS norm_sum2
 FROM {MASKED} WHERE assim OR species = 3 GROUP BY ALL)"""
_VALUES = [f"{v}{s}" for v in D.VARIABLES for s in ("_sum", "_sum2")] + ["oxf_sum", "oxa_sum", "fxa_sum", "norm_sum", "norm_sum2"]


def merge_sql(keys: str) -> str:
    return f"(SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'sum({c}) AS {c}' for c in _VALUES)} FROM {SUMS} GROUP BY {keys})"


def stats_sql(source: str, keys: str) -> str:
    var = lambda v: f"greatest({v}_sum2 / n - ({v}_sum / n) * ({v}_sum / n), 0)"
    sd = lambda a, b, x: f"sqrt(greatest({var(a)} + {var(b)} - 2 * ({x} / n - ({a}_sum / n) * ({b}_sum / n)), 0))"
    scale, omf = "sqrt((obsvar_sum + fcstvar_sum) / n)", "(obs_sum - fcst_sum) / n"
    return f"""SELECT {keys}, n, obs_sum / n AS o_mean, sqrt({var('obs')}) AS o_stdv, fcst_sum / n AS f_mean, sqrt({var('fcst')}) AS f_stdv, ana_sum / n AS a_mean,
 sqrt({var('ana')}) AS a_stdv, {omf} AS omf_mean, {sd('obs', 'fcst', 'oxf_sum')} AS omf_stdv, (obs_sum - ana_sum) / n AS oma_mean, {sd('obs', 'ana', 'oxa_sum')} AS oma_stdv,
 {omf} / {scale} AS omf_norm_mean, {sd('obs', 'fcst', 'oxf_sum')} / {scale} AS omf_norm_stdv FROM {source}"""


@R.add(f"SELECT * FROM {MASKED}", " ".join(D.VARIABLES))
def cross_mask(spark, sf):
    return masked(spark, sf)


@R.add(f"SELECT * FROM {SUMS}", " ".join(_VALUES))
def monthly_sums(spark, sf):
    return sums(spark, sf)


@R.add(f"SELECT * FROM {merge_sql('tile, species')}", " ".join(_VALUES))
def merge_sums(spark, sf):
    return D.merge_sums(sums(spark, sf))


@R.add(stats_sql(merge_sql("tile, species"), "tile, species"), STATS)
def temporal_stats(spark, sf):
    return D.temporal_stats(sums(spark, sf))


@R.add(f"SELECT tile, species, n, norm_sum / n AS omf_norm_mean, sqrt(greatest(norm_sum2 / n - (norm_sum / n) * (norm_sum / n), 0)) AS omf_norm_stdv FROM {merge_sql('tile, species')}", "omf_norm_mean omf_norm_stdv")
def temporal_stats_exact_norm(spark, sf):
    return D.temporal_stats_exact_norm(sums(spark, sf))


@R.add(stats_sql(merge_sql("month, species"), "month, species"), STATS)
def spatial_stats(spark, sf):
    return D.spatial_stats(sums(spark, sf))


@R.add(
    f"""SELECT month, sum(omf_mean * n) / sum(n) AS omf_mean, sum(omf_stdv * n) / sum(n) AS omf_stdv, CAST(sum(n) AS BIGINT) AS n
    FROM ({stats_sql(merge_sql('month, species'), 'month, species')}) GROUP BY month""", "omf_mean omf_stdv")
def species_weighted_mean(spark, sf):
    return D.species_weighted_mean(D.spatial_stats(sums(spark, sf)), ["month"], ["omf_mean", "omf_stdv"])


@R.add(f"SELECT tile, species, n, CASE WHEN n >= 60 THEN omf_mean END AS omf_mean, CASE WHEN n >= 60 THEN omf_stdv END AS omf_stdv FROM ({stats_sql(merge_sql('tile, species'), 'tile, species')})", "omf_mean omf_stdv")
def mask_min_n(spark, sf):
    stats = D.temporal_stats(sums(spark, sf)).select("tile", "species", "n", "omf_mean", "omf_stdv")
    return D.mask_min_n(stats, 60, ["omf_mean", "omf_stdv"])


@R.add(f"SELECT m AS month FROM (SELECT CAST(unnest(generate_series(DATE '1994-06-01', DATE '2002-06-01', INTERVAL 1 MONTH)) AS DATE) AS m) WHERE m NOT IN (SELECT month FROM {SUMS})")
def missing_months(spark, sf):
    return D.missing_months(sums(spark, sf), "1994-06-01", "2002-06-01")


def _qa_sql(fields: str, weight: str, source: str) -> str:
    return f"""SELECT species, field, sum(w * value) / NULLIF(sum(w), 0) AS mean, CASE WHEN sum(w) <> 0 THEN sqrt(greatest(sum(w * value * value) / NULLIF(sum(w), 0) - (sum(w * value) / NULLIF(sum(w), 0)) * (sum(w * value) / NULLIF(sum(w), 0)), 0)) END AS stdv,
 min(value) AS min, max(value) AS max, count(*) AS n, sum(w) / count(*) AS mean_weight
 FROM (SELECT species, {weight} AS w, field, value FROM {source} UNPIVOT (value FOR field IN ({fields}))) WHERE value IS NOT NULL AND w IS NOT NULL GROUP BY species, field"""


@R.add(_qa_sql("obs, fcst, ana", "obsvar", f"(SELECT species, CASE WHEN species = 2 THEN 0 ELSE obsvar END AS obsvar, NULLIF(obs, 13) AS obs, fcst, ana FROM {sql(OBS)})"), QA)
def qa_summary(spark, sf):
    """All weights of one species are 0."""
    df = frame(spark, sf, OBS).withColumns({"obs": F.nullif("obs", F.lit(13.0)), "obsvar": F.when(F.col("species") == 2, 0.0).otherwise(F.col("obsvar"))})
    return D.qa_summary(df, ["species"], ["obs", "fcst", "ana"], "obsvar")


@R.add(_qa_sql("omf, omf_norm", "obsvar", f"(SELECT species, w AS obsvar, obs - fcst AS omf, (obs - fcst) / NULLIF(sqrt(v), 0) AS omf_norm FROM (SELECT *, CASE WHEN tile % 9 = 0 THEN 0 ELSE obsvar END AS w, CASE WHEN tile % 9 = 0 THEN 0 ELSE obsvar + fcstvar END AS v FROM {sql(OBS)}))"), QA)
def qa_innovations(spark, sf):
    """Some tiles have no variance."""
    exact = F.col("tile") % 9 == 0
    df = frame(spark, sf, OBS).withColumns({c: F.when(exact, 0.0).otherwise(F.col(c)) for c in ("obsvar", "fcstvar")})
    return D.qa_innovations(df, ["species"], "obsvar")


@R.add(f"SELECT time, tile, species, count(*) AS n FROM {sql(OBS)} GROUP BY ALL HAVING count(*) > 1")
def duplicate_guard(spark, sf):
    return O.duplicates(frame(spark, sf, OBS), KEYS)


@R.add(f"SELECT o.time, o.tile, o.species, o.obs FROM {sql(OBS)} o WHERE o.species IN (1, 2)")
def select_species(spark, sf):
    return O.select_species(frame(spark, sf, OBS), species(spark), ["one", "two", "three"]).select(*KEYS, "obs")


@R.add(f"SELECT time, tile, species, obs FROM {sql(OBS)} WHERE species IN (1, 3) AND assim AND tile IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def select_obs(spark, sf):
    tiles = spark.read.parquet(f"{sf}/supplier.parquet").where("s_nationkey < 10").select(F.col("s_suppkey").alias("tile"))
    return O.select_obs(frame(spark, sf, OBS), tiles, [1, 3], True).select(*KEYS, "obs")


@R.add(f"SELECT time, tile, species, obs FROM {sql(OBS)} WHERE NOT ((obs - fcst) * (obs - fcst) > 25 * 2 * obsvar AND species <> 2)")
def gate_innovation(spark, sf):
    return O.gate_innovation(frame(spark, sf, OBS).withColumn("bias_ok", F.col("species") != 2)).select(*KEYS, "obs")


@R.add(f"SELECT species, first_row, count(*) AS n FROM (SELECT species, min(rn) OVER (PARTITION BY species) AS first_row FROM (SELECT species, row_number() OVER (ORDER BY species, tile) AS rn FROM {sql(OBS)})) GROUP BY ALL")
def first_index(spark, sf):
    return O.first_index(frame(spark, sf, OBS)).groupBy("species", "first_row").agg(F.count("*").alias("n"))


@R.add(f"SELECT tile, avg(obs) AS obs, count(obs) AS n FROM {sql(OBS)} GROUP BY tile", "obs")
def snow_obs_mean(spark, sf):
    return O.snow_obs_mean(frame(spark, sf, OBS))


@R.add(f"""SELECT species, CASE WHEN bad THEN NULL ELSE obsvar END AS obsvar, CASE WHEN bad THEN NULL ELSE fcstvar END AS fcstvar, count(*) AS n
 FROM (SELECT species, NULLIF(obsvar, 1) AS obsvar, fcstvar, NULLIF(obsvar, 1) IS NULL OR fcstvar IS NULL AS bad FROM {sql(OBS)}) GROUP BY ALL""", "obsvar fcstvar")
def null_group(spark, sf):
    df = frame(spark, sf, OBS).withColumn("obsvar", F.nullif("obsvar", F.lit(1.0)))
    return O.null_group(df, ["obsvar", "fcstvar"]).groupBy("species", "obsvar", "fcstvar").agg(F.count("*").alias("n"))


@R.add(f"""SELECT a.species, a.tile, a.n, CASE WHEN a.std > 2.5 THEN a.std * a.std ELSE e.errstd * e.errstd END AS obsvar, a.assim AND e.assim AS assim
 FROM (SELECT species, tile, count(*) AS n, max(obsvar) AS std, bool_and(assim) AS assim FROM {sql(OBS)} GROUP BY ALL) a
 JOIN (VALUES (1, 0.5::DOUBLE, TRUE), (2, 1.5::DOUBLE, TRUE), (3, 2.0::DOUBLE, FALSE)) e(species, errstd, assim) USING (species)""", "obsvar")
def collect_obs(spark, sf):
    base = frame(spark, sf, OBS).groupBy("species", "tile").agg(F.count("*").alias("n"), F.max("obsvar").alias("std"), F.bool_and("assim").alias("assim"))
    base = base.withColumn("std", F.when(F.col("std") > 2.5, F.col("std")))
    parts = [base.where(F.col("species") == s) for s in (1, 2, 3)]
    catalogue = spark.createDataFrame([(1, 0.5, True), (2, 1.5, True), (3, 2.0, False)], "species int, errstd double, assim boolean")
    return O.collect_obs(parts, catalogue).select("species", "tile", "n", "obsvar", "assim")


_CAT = "(SELECT row_number() OVER (ORDER BY k) AS ordinal, k AS descr FROM (SELECT DISTINCT event_type AS k FROM events {}))"


@R.add(f"SELECT ordinal, a.descr, b.descr AS descr2 FROM {_CAT.format('')} a FULL JOIN {_CAT.format("WHERE event_type > 'd'")} b USING (ordinal) WHERE a.descr IS DISTINCT FROM b.descr")
def match_species_catalogues(spark, sf):
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf}/events.parquet")
    number = F.row_number().over(Window.orderBy("descr")).cast("long").alias("ordinal")
    listed = lambda df: df.select(F.col("event_type").alias("descr")).distinct().select(number, "descr")
    return D.catalogue_mismatches(listed(events), listed(events.where("event_type > 'd'")))


@R.add(f"SELECT DISTINCT tile FROM {sql(OBS)} ORDER BY tile")
def sorted_unique_tiles(spark, sf):
    return frame(spark, sf, OBS).select("tile").distinct().orderBy("tile")


@R.add(f"SELECT time, tile, species, count(*) AS n FROM (SELECT time, tile, species FROM {sql(OBS)} INTERSECT SELECT time, tile, species FROM {sql(OBS1)}) GROUP BY ALL ORDER BY tile, species, time")
def common_keys(spark, sf):
    """Keys of both experiments, in the order that results don't depend on the layout: tile, then species."""
    a, b = (frame(spark, sf, text).select(*KEYS) for text in (OBS, OBS1))
    return a.intersect(b).groupBy(*KEYS).agg(F.count("*").alias("n")).orderBy("tile", "species", "time")
