"""Queries of climatologies and of rescaling by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import LatLonGrid
from ..operators import climatology as C
from ..operators import scaling as Z
from .fixtures import OBS, POINTS, SERIES, TILES, frame, sql
from .register import Registry

R = Registry()
S, P, T = sql(SERIES), sql(POINTS), sql(TILES)
_LEAP = "(year(time) % 4 = 0 AND (year(time) % 100 <> 0 OR year(time) % 400 = 0))"
PENTAD = f"CAST(floor((dayofyear(time) - CASE WHEN {_LEAP} AND dayofyear(time) >= 59 THEN 2 ELSE 1 END) / CAST(5 AS DOUBLE)) + 1 AS INT)"
SLOT = f"CAST(floor((dayofyear(time) - CASE WHEN {_LEAP} AND dayofyear(time) >= 60 THEN 2 ELSE 1 END) / CAST(8 AS DOUBLE)) + 1 AS INT)"
POOLED = f"(SELECT tile, value, (p0 - 1 + d + 73) % 73 + 1 AS pentad FROM (SELECT tile, value, {PENTAD} AS p0, CAST(unnest([-2, -1, 0, 1, 2]) AS INT) AS d FROM {S}))"


def series(spark, sf):
    return frame(spark, sf, SERIES)


@R.add(
    f"""SELECT tile, pentad, CASE WHEN n >= 3 THEN mean END AS mean, CASE WHEN n >= 3 THEN stdv END AS stdv, CASE WHEN n >= 3 THEN min END AS min, CASE WHEN n >= 3 THEN max END AS max, n FROM
    (SELECT tile, pentad, avg(value) AS mean, stddev_samp(value) AS stdv, min(value) AS min, max(value) AS max, count(*) AS n FROM {POOLED} GROUP BY ALL)""", "mean stdv min max"
)
def clim_stats(spark, sf):
    return C.clim_stats(series(spark, sf), ["tile"], "value", 5, 3)


_RANKED = f"(SELECT tile, pentad, value, row_number() OVER (PARTITION BY tile, pentad ORDER BY value) AS r, count(*) OVER (PARTITION BY tile, pentad) AS n FROM {POOLED})"
_PCT = [1, 5, 25, 50, 75, 95, 99]


@R.add(
    f"SELECT tile, pentad, n, {', '.join(f'max(CASE WHEN r = greatest(({p} * n + 50) // 100, 1) THEN value END) AS p{p:02d}' for p in _PCT)} FROM {_RANKED} GROUP BY tile, pentad, n",
    " ".join(f"p{p:02d}" for p in _PCT),
)
def clim_percentiles(spark, sf):
    return C.clim_percentiles(series(spark, sf), ["tile"], "value", _PCT, 5)


_DAILY = f"(SELECT tile, dayofyear(time) AS doy, count(*) AS n, sum(value / 1000) AS s, sum(value / 1000 * value / 1000) AS ss FROM {S} GROUP BY ALL)"


def _sliding(width: int, least: int, inner: int) -> str:
    half = (width - inner) // 2
    over = lambda c, a, b: f"coalesce(sum({c}) OVER (PARTITION BY tile ORDER BY doy ROWS BETWEEN {a} PRECEDING AND {b}), 0)"
    inner_n = over("n", width - 1 - half, f"{half} PRECEDING") if inner else "0"
    ok = f"n >= {least}" + (f" AND inner_n >= {least} / CAST(2.5 AS DOUBLE)" if inner else "")
    return f"""SELECT tile, CAST((middle + 2) / 5 AS INT) AS pentad, CAST(n AS BIGINT) AS n, CASE WHEN {ok} THEN s / n END AS mean, CASE WHEN {ok} THEN sqrt(greatest(ss / n - (s / n) * (s / n), 0)) END AS stdv FROM
    (SELECT tile, doy - {width // 2} AS middle, doy, {over('n', width - 1, 'CURRENT ROW')} AS n, {over('s', width - 1, 'CURRENT ROW')} AS s, {over('ss', width - 1, 'CURRENT ROW')} AS ss, {inner_n} AS inner_n
      FROM (SELECT DISTINCT tile, unnest(generate_series(1, 365)) AS doy FROM {S}) LEFT JOIN {_DAILY} USING (tile, doy)) WHERE doy >= {width} AND (middle + 2) % 5 = 0"""


def daily(spark, sf):
    v = F.col("value") / 1000
    return series(spark, sf).groupBy("tile", F.dayofyear("time").alias("doy")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * F.col("value") / 1000).alias("ss"))


@R.add(_sliding(31, 5, 0), "mean stdv")
def sliding_day_stats(spark, sf):
    return C.sliding_day_stats(daily(spark, sf), ["tile"], 31, 5)


@R.add(_sliding(95, 20, 31), "mean stdv")
def sliding_day_stats_inner(spark, sf):
    return C.sliding_day_stats(daily(spark, sf), ["tile"], 95, 20, 31)


_SLOTS = f"(SELECT tile, {SLOT} AS slot, avg(greatest(value - 100000, 0)) AS value FROM {S} GROUP BY ALL)"


def slots(spark, sf):
    return C.clim_8day(series(spark, sf).withColumn("value", F.col("value") - 100000), ["tile"], "value")


@R.add(f"SELECT * FROM {_SLOTS}", "value")
def clim_8day(spark, sf):
    return slots(spark, sf)


@R.add(f"SELECT tile, slot, avg(value) AS value FROM (SELECT tile, (slot - 1 + d + 46) % 46 + 1 AS slot, value FROM (SELECT *, CAST(unnest([-1, 0, 1]) AS INT) AS d FROM {_SLOTS})) GROUP BY ALL", "value")
def circular_slot_mean(spark, sf):
    return C.circular_slot_mean(slots(spark, sf), ["tile"], "value")


@R.add(f"SELECT tile, slot, avg(value) AS value FROM (SELECT tile, {SLOT} AS slot, id % 2 AS pass, avg(value) AS value FROM {S} GROUP BY ALL) GROUP BY ALL", "value")
def asc_desc_mean(spark, sf):
    from ..functions.calendar import eight_day_slot

    by_pass = series(spark, sf).groupBy("tile", eight_day_slot(F.col("time")).alias("slot"), (F.col("id") % 2).alias("pass")).agg(F.avg("value").alias("value"))
    return C.pass_mean(by_pass, ["tile", "slot"], "value")


_CLIM = f"(SELECT tile, {PENTAD} AS pentad, avg(value) AS value FROM {S} GROUP BY ALL)"


@R.add(
    f"""SELECT id, a.value * (1 - share) + b.value * share AS value FROM
    (SELECT *, (doy - (before * 5 - 2)) / CAST(5 AS DOUBLE) AS share, (before - 1 + 73) % 73 + 1 AS p0, before % 73 + 1 AS p1 FROM
      (SELECT *, CAST(floor((doy + 2) / CAST(5 AS DOUBLE)) AS INT) AS before FROM (SELECT id, tile, least(dayofyear(time), 365) AS doy FROM {S}))) q
    LEFT JOIN {_CLIM} a ON q.tile = a.tile AND q.p0 = a.pentad LEFT JOIN {_CLIM} b ON q.tile = b.tile AND q.p1 = b.pentad""", "value"
)
def clim_at_date(spark, sf):
    from ..functions.calendar import pentad

    clim = series(spark, sf).groupBy("tile", pentad(F.col("time")).alias("pentad")).agg(F.avg("value").alias("value"))
    return C.clim_at(series(spark, sf).select("id", "tile", "time"), clim, ["tile"], "value").select("id", "value")


@R.add(f"SELECT t.tile, o.time, o.value / NULLIF(t.tile % 4, 0) AS value FROM {S} o JOIN {T} t ON o.tile = t.tile", "value")
def to_wetness(spark, sf):
    tiles = frame(spark, sf, TILES).select("tile", (F.col("tile") % 4).cast("double").alias("porosity"))
    return C.to_wetness(series(spark, sf), tiles, "value").select("tile", "time", "value")


@R.add(f"SELECT CAST(date_trunc('day', ts) AS DATE) AS day, user_id, avg(value) AS value, count(value) AS n FROM {P} GROUP BY ALL", "value")
def daily_composite(spark, sf):
    df = frame(spark, sf, POINTS).withColumn("time", F.col("ts"))
    return C.daily_composite(df, ["user_id"], "value")


O = sql(OBS)
_D = "least(doy, 365)"
_SCALED = f"""(SELECT *, CAST(unnest(generate_series(1, 73)) AS INT) AS pentad FROM (SELECT {{keys}}, dayofyear(time) AS doy, count(*) AS n, sum(obs) AS so, sum(obs * obs) AS soo, sum(fcst) AS sm, sum(fcst * fcst) AS smm,
 min(fcst) AS m_min, max(fcst) AS m_max FROM {O} GROUP BY ALL))"""
_NEAR = f"least(({_D} - (pentad * 5 - 2) + 365) % 365, ((pentad * 5 - 2) - {_D} + 365) % 365) <= 15"


def _scaling(keys: str, source: str) -> str:
    sd = lambda s, ss: f"sqrt(greatest({ss} / n - ({s} / n) * ({s} / n), 0))"
    values = {"o_mean": "so / n", "o_std": sd("so", "soo"), "m_mean": "sm / n", "m_std": sd("sm", "smm"), "m_min": "m_min", "m_max": "m_max"}
    return f"""SELECT {keys}, pentad, n, {', '.join(f'CASE WHEN n >= 20 THEN {v} END AS {k}' for k, v in values.items())} FROM
    (SELECT {keys}, pentad, CAST(sum(n) AS BIGINT) AS n, sum(so) AS so, sum(soo) AS soo, sum(sm) AS sm, sum(smm) AS smm, min(m_min) AS m_min, max(m_max) AS m_max FROM {source} WHERE {_NEAR} GROUP BY ALL)"""


_ZCOLS = "o_mean o_std m_mean m_std m_min m_max"


def pairs(spark, sf):
    return frame(spark, sf, OBS).select("tile", "species", "time", "obs", F.col("fcst").alias("mod"))


@R.add(_scaling("tile, species", _SCALED.format(keys="tile, species")), _ZCOLS)
def scaling_stats(spark, sf):
    return Z.scaling_stats(pairs(spark, sf), ["tile", "species"], 31, 20)


@R.add(_scaling("tile, species", f"(SELECT * FROM {_SCALED.format(keys='tile, species')} UNION ALL BY NAME SELECT * REPLACE (NULL AS species) FROM {_SCALED.format(keys='tile, species')})"), _ZCOLS)
def scaling_stats_combined(spark, sf):
    return Z.scaling_stats_combined(pairs(spark, sf), ["tile"], "species", 31, 20)


_ZP = f"(SELECT tile, avg(obs) AS mean_obs, stddev_pop(obs) AS std_obs, avg(fcst) AS mean_mod, stddev_pop(fcst) AS std_mod FROM {O} WHERE tile % 11 <> 0 GROUP BY tile)"


def z_parameters(spark, sf):
    df = frame(spark, sf, OBS).where("tile % 11 <> 0")
    return df.groupBy("tile").agg(F.avg("obs").alias("mean_obs"), F.stddev_pop("obs").alias("std_obs"), F.avg("fcst").alias("mean_mod"), F.stddev_pop("fcst").alias("std_mod"))


@R.add(
    f"""SELECT o.time, o.tile, o.species, CASE WHEN p.std_obs > 0 THEN p.mean_mod + p.std_mod / p.std_obs * (o.obs - p.mean_obs) END AS obs, CASE WHEN p.std_obs > 0 THEN p.std_mod / p.std_obs * sqrt(o.obsvar) END AS errstd
    FROM {O} o LEFT JOIN {_ZP} p ON o.tile = p.tile""", "obs errstd"
)
def scale_zscore(spark, sf):
    obs = frame(spark, sf, OBS).withColumn("errstd", F.sqrt("obsvar"))
    return Z.scale_zscore(obs, z_parameters(spark, sf), ["tile"]).select("time", "tile", "species", "obs", "errstd")


@R.add(
    f"""SELECT p.obs_id, CASE WHEN g.o_mean > 0 AND g.m_mean > 0 AND g.o_std > 0 THEN greatest(least(g.m_mean + g.m_std / g.o_std * (p.value - g.o_mean), g.m_max), g.m_min) END AS scaled,
    CASE WHEN g.o_mean > 0 AND g.m_mean > 0 AND g.o_std > 0 THEN g.m_std / g.o_std END AS scaled_errstd
    FROM (SELECT *, ts AS time, {PENTAD.replace('time', 'ts')} AS pentad, CAST(ceil((lon + 180) / 10) AS INT) AS i, CAST(ceil((lat + 90) / 10) AS INT) AS j FROM {P}) p LEFT JOIN
    (SELECT pentad, i, j, avg(value) AS o_mean, stddev_pop(value) AS o_std, avg(k) AS m_mean, stddev_pop(k) AS m_std, CAST(min(k) AS DOUBLE) AS m_min, CAST(max(k) AS DOUBLE) AS m_max FROM
      (SELECT *, {PENTAD.replace('time', 'ts')} AS pentad, CAST(ceil((lon + 180) / 10) AS INT) AS i, CAST(ceil((lat + 90) / 10) AS INT) AS j FROM {P}) GROUP BY ALL) g ON p.pentad = g.pentad AND p.i = g.i AND p.j = g.j""", "scaled scaled_errstd"
)
def scale_zscore_grid(spark, sf):
    from ..functions.calendar import pentad

    grid = LatLonGrid()
    i, j = grid.cell(F.col("lon"), F.col("lat"))
    df = frame(spark, sf, POINTS).withColumns({"pentad": pentad(F.col("ts")), "obs": F.col("value"), "errstd": F.lit(1.0)})
    stats = df.groupBy("pentad", i.alias("i"), j.alias("j")).agg(
        F.avg("value").alias("o_mean"), F.stddev_pop("value").alias("o_std"), F.avg("k").alias("m_mean"), F.stddev_pop("k").alias("m_std"), F.min("k").cast("double").alias("m_min"), F.max("k").cast("double").alias("m_max")
    )
    return Z.scale_zscore_grid(df, stats, grid).select("obs_id", "scaled", "scaled_errstd")


_Y = "((0.01 * c + 0.5) * c + 2)"


@R.add(
    f"""SELECT obs_id, CASE WHEN y BETWEEN 0 AND 100 THEN y END AS scaled, CASE WHEN x BETWEEN 0 AND 100 AND tile % 5 <> 0 THEN CAST(1.5 AS DOUBLE) END AS scaled_errstd FROM
    (SELECT obs_id, tile, x, CASE WHEN NOT x BETWEEN 0 AND 100 THEN NULL WHEN x < lo THEN {_Y} / NULLIF(lo, 0) * x WHEN x > hi THEN (100 - {_Y}) / NULLIF(100 - hi, 0) * (x - hi) + {_Y} ELSE {_Y} END AS y FROM
      (SELECT *, least(greatest(x, lo), hi) AS c FROM (SELECT obs_id, user_id AS tile, value - 1 AS x, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 5 END AS lo, CASE WHEN user_id % 7 = 0 THEN 100 ELSE 60 END AS hi FROM {P})))""", "scaled scaled_errstd"
)
def scale_cdf(spark, sf):
    """Some tiles have no deviation, and some have extremes on the edges."""
    df = frame(spark, sf, POINTS).select("obs_id", F.col("user_id").alias("tile"), (F.col("value") - 1).alias("obs"), F.lit(1.0).alias("errstd"))
    parameters = df.select("tile").distinct().withColumns({"std_obs": F.when(F.col("tile") % 5 == 0, 0.0).otherwise(2.0), "std_mod": F.lit(3.0), "min_obs": F.when(F.col("tile") % 3 == 0, 0.0).otherwise(5.0), "max_obs": F.when(F.col("tile") % 7 == 0, 100.0).otherwise(60.0), "coeff": F.array(F.lit(0.01), F.lit(0.5), F.lit(2.0))})
    return Z.scale_cdf(df, parameters, 0.0, 100.0).select("obs_id", "scaled", "scaled_errstd")
