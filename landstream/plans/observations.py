"""Queries of observation preparation: quality control, super-observations, suppression, file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.grid import LatLonGrid
from ..functions.numeric import null_if_nodata
from ..operators import observations as O
from ..operators.spatial import with_cell
from ..sources import ingest
from ..sources.paths import shared
from .fixtures import POINTS, frame, sql
from .register import Registry

R = Registry()
GRID = LatLonGrid()
P = sql(POINTS)


def points(spark, sf):
    return frame(spark, sf, POINTS)


@R.add(f"SELECT obs_id, CASE WHEN abs(v + 9999) >= 0.9999 THEN v END AS value FROM (SELECT obs_id, CASE WHEN k % 7 = 0 THEN -9999.3 ELSE value END AS v FROM {P})", "value")
def null_if_nodata_values(spark, sf):
    v = F.when(F.col("k") % 7 == 0, F.lit(-9999.3)).otherwise(F.col("value"))
    return points(spark, sf).select("obs_id", null_if_nodata(v).alias("value"))


@R.add(f"SELECT obs_id FROM {P} WHERE ts > TIMESTAMP '2024-01-05 12:00:00' AND ts <= TIMESTAMP '2024-01-06 12:00:00'")
def in_window(spark, sf):
    low, high = (F.lit(t).cast("timestamp") for t in ("2024-01-05 12:00:00", "2024-01-06 12:00:00"))
    return points(spark, sf).where(O.in_window(F.col("ts"), low, high)).select("obs_id")


@R.add(
    f"""SELECT obs_id, value / 100 AS sm FROM {P} WHERE value BETWEEN 0 AND 100 AND k % 3 = 0 AND k % 5 IN (0, 4) AND CAST(90 + k % 20 AS DOUBLE) / 100 BETWEEN CAST(0.9 AS DOUBLE) AND 1
    AND k % 13 <= 10 AND k % 17 <= 10 AND species <> 4""", "sm")  # fmt: skip
def qc_ascat(spark, sf):
    k = F.col("k")
    df = points(spark, sf).withColumns({
        "sm": F.col("value"), "proc_flag": k % 3, "corr_flag": k % 5, "land_frac": (90 + k % 20).cast("double") / 100, "topo": k % 13, "wetland": k % 17, "masked": (F.col("species") == 4).cast("int"),
    })
    return O.qc_ascat(df).select("obs_id", "sm")


@R.add(f"SELECT obs_id FROM {P} WHERE k % 2 = 0 AND k % 3 = 0 AND k % 24 IN (0, 6, 12, 18)")
def qc_cygnss(spark, sf):
    k = F.col("k")
    df = points(spark, sf).withColumns({"f1": F.when(k % 2 == 0, 255).otherwise(0), "f2": F.when(k % 3 == 0, 255).otherwise(1), "hour": (k % 24).cast("double")})
    return O.qc_cygnss(df, ["f1", "f2"]).select("obs_id")


@R.add(
    f"""SELECT obs_id, 'tb_regular' AS product FROM {P} WHERE value * 5 + 90 > 100 AND value * 5 + 90 < 320 AND CAST(k % 10 AS DOUBLE) < 7 AND k % 24 >= 2
    UNION ALL SELECT obs_id, 'tb_fitted' FROM {P} WHERE value * 5 + 90 > 100 AND value * 5 + 90 < 320 AND CAST(k % 10 AS DOUBLE) < 5 AND k % 24 >= 20
    UNION ALL SELECT obs_id, 'sm' FROM {P} WHERE value / 50 > 0 AND value / 50 < 0.6 AND CAST(k % 10 AS DOUBLE) / 20 < 0.2 AND k % 24 >= 2 AND CAST(k % 7 AS DOUBLE) / 20 > 0 AND CAST(k % 7 AS DOUBLE) / 20 < 0.2"""
)
def qc_smos(spark, sf):
    v, k = F.col("value"), F.col("k")
    tb = points(spark, sf).withColumns({"value": v * 5 + 90, "std": (k % 10).cast("double"), "n": k % 24})
    sm = points(spark, sf).withColumns({"value": v / 50, "std": (k % 10).cast("double") / 20, "n": k % 24, "dqx": (k % 7).cast("double") / 20})
    parts = [O.qc_smos(df, p).select("obs_id", F.lit(p).alias("product")) for p, df in (("tb_regular", tb), ("tb_fitted", tb), ("sm", sm))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add(
    f"""SELECT obs_id, coalesce((a + b) / 2, a, b) AS tb FROM (SELECT obs_id, CASE WHEN k % 2 = 0 AND value * 8 + 90 > 100 AND value * 8 + 90 < 320 THEN value * 8 + 90 END AS a,
    CASE WHEN (k + obs_id) % 2 = 0 AND value * 8 + 95 > 100 AND value * 8 + 95 < 320 THEN value * 8 + 95 END AS b FROM {P}) WHERE coalesce(a, b) IS NOT NULL""", "tb")  # fmt: skip
def qc_look_pair(spark, sf):
    df = points(spark, sf).withColumns({
        "flag_fore": F.col("k") % 2, "flag_aft": ((F.col("k") + F.col("obs_id")) % 2).cast("int"), "tb_fore": F.col("value") * 8 + 90, "tb_aft": F.col("value") * 8 + 95,
        "ts_fore": F.col("ts"), "ts_aft": F.col("ts"),
    })
    return O.qc_look_pair(df).select("obs_id", "tb")


@R.add(f"SELECT obs_id FROM {P} WHERE k % 3 = 1 AND user_id % 3 = 1")
def thin_grid(spark, sf):
    return O.thin_grid(points(spark, sf).withColumns({"row": F.col("k"), "col": F.col("user_id")})).select("obs_id")


@R.add(f"SELECT obs_id FROM (SELECT *, var_samp((value - k) * (user_id % 10)) OVER (PARTITION BY user_id) AS v FROM {P}) WHERE NOT coalesce(v > 6400, FALSE)")
def reject_file_if_spread(spark, sf):
    """Files of which some have a small spread and some a large one."""
    scale = (F.col("user_id") % 10).cast("double")
    df = points(spark, sf).withColumns({"file": F.col("user_id"), "tb_fore": F.col("value") * scale, "tb_aft": F.col("k") * scale})
    return O.reject_file_if_spread(df, "file", 80.0).select("obs_id")


@R.add(f"SELECT obs_id FROM {P} WHERE value <= 100 AND k > 20 AND k % 5 <= 2")
def qc_snow_cover(spark, sf):
    return O.qc_snow_cover(points(spark, sf).withColumns({"cover": F.col("value"), "clear_index": F.col("k"), "spatial_qa": F.col("k") % 5})).select("obs_id")


@R.add(f"SELECT obs_id FROM {P} WHERE value / 50 > 0 AND value / 50 < 1 AND k % 3 = user_id % 3")
def qc_freeze_thaw(spark, sf):
    df = points(spark, sf).withColumns({"value": F.col("value") / 50, "i": F.col("k") % 3, "tile_i": F.col("user_id") % 3, "j": F.lit(1), "tile_j": F.lit(1)})
    return O.qc_freeze_thaw(df).select("obs_id")


@R.add(f"SELECT obs_id, CASE WHEN extract(hour FROM ts) BETWEEN 3 AND 14 THEN CAST(1.3 AS DOUBLE) ELSE 2.1 END AS errstd FROM {P} WHERE value * 6 + 180 > 200 AND value * 6 + 180 < 370", "errstd")
def qc_skin_temperature(spark, sf):
    return O.qc_skin_temperature(points(spark, sf).withColumns({"value": F.col("value") * 6 + 180, "analysis_time": F.col("ts")})).select("obs_id", "errstd")


@R.add(f"SELECT obs_id FROM {P} WHERE value > 0 AND k % 4 <> 0 AND k % 2 = 0")
def qc_amsre(spark, sf):
    flag = F.when(F.col("k") % 4 == 0, 64).when(F.col("k") % 2 == 0, F.when(F.col("k") % 3 == 0, 128).otherwise(256)).otherwise(0)
    return O.qc_amsre(points(spark, sf).withColumn("surface_flag", flag)).select("obs_id")


@R.add(f"SELECT obs_id, CASE WHEN k % 6 <> 0 THEN value END AS value FROM {P} WHERE k % 2 = 0 AND user_id % 2 = 0 AND (k // 8) % 2 = 0", "value")
def qc_retrieval(spark, sf):
    df = points(spark, sf).withColumns({"retrieval_flag": F.col("k").cast("long"), "surface_flag": F.col("user_id"), "value": F.when(F.col("k") % 6 == 0, -9999.0).otherwise(F.col("value"))})
    return O.qc_retrieval(df).select("obs_id", "value")


def _model_sql(kind: str) -> str:
    precip, swe, ts, soil = "CAST(k AS DOUBLE) / 86400", "CASE WHEN k % 5 = 0 THEN CAST(0.01 AS DOUBLE) ELSE 0 END", "268 + CAST(k % 20 AS DOUBLE)", "275 + CAST(k % 17 AS DOUBLE)"
    return {
        "sfmc": f"{precip} > CAST(10 AS DOUBLE) / 86400 OR {swe} > 0.0001 OR {ts} < 273.36",
        "tsurf": f"{precip} > CAST(10 AS DOUBLE) / 86400 OR {swe} > 0.0001",
        "tb": f"{precip} > CAST(50 AS DOUBLE) / 86400",
        "asnow": f"{soil} > 283.16",
    }[kind]


@R.add("SELECT obs_id, " + ", ".join(f"CASE WHEN NOT ({_model_sql(x)}) THEN value END AS {x}" for x in ("sfmc", "tsurf", "tb", "asnow")) + f" FROM {P}", "sfmc tsurf tb asnow")
def qc_model(spark, sf):
    k = F.col("k")
    args = k.cast("double") / 86400, F.when(k % 5 == 0, 0.01).otherwise(0.0), 268 + (k % 20).cast("double"), 275 + (k % 17).cast("double")
    return points(spark, sf).select("obs_id", *(O.qc_model(F.col("value"), x, *args).alias(x) for x in ("sfmc", "tsurf", "tb", "asnow")))


@R.add(f"SELECT obs_id, CASE WHEN NOT (value - k > 5 OR 1 - CAST(90 + k % 10 AS DOUBLE) / 100 > 0.05) THEN value END AS obs FROM {P}", "obs")
def gate_rfi_water(spark, sf):
    df = points(spark, sf).select("obs_id", F.col("value").alias("obs"), F.col("k").cast("double").alias("tsoil"), ((90 + F.col("k") % 10).cast("double") / 100).alias("land_frac"))
    return O.gate_rfi_water(df).select("obs_id", "obs")


@R.add(f"SELECT user_id FROM {P} GROUP BY user_id HAVING count(CASE WHEN value > 0.5 THEN 1 END) = count(*)")
def keep_if_all_members(spark, sf):
    return O.keep_if_all_members(points(spark, sf).withColumn("pred", F.when(F.col("value") > 0.5, F.col("value"))), ["user_id"])


@R.add(
    f"""SELECT obs_id, CASE WHEN w <> 0 THEN 1 ELSE s END AS mode1, s AS mode2, w AS mode3, CASE WHEN w <> 0 OR v <> 0 THEN 1 ELSE s END AS mode4
    FROM (SELECT obs_id, k % 4 AS s, CASE WHEN k % 3 > 1 THEN 1 ELSE 0 END AS w, CASE WHEN species > 3 THEN 1 ELSE 0 END AS v FROM {P})"""
)
def combine_masks(spark, sf):
    k = F.col("k")
    masks = k % 4, F.when(k % 3 > 1, 1).otherwise(0), F.when(F.col("species") > 3, 1).otherwise(0)
    return points(spark, sf).select("obs_id", *(O.combine_masks(*masks, mode).alias(f"mode{mode}") for mode in (1, 2, 3, 4)))


@R.add(f"SELECT obs_id FROM {P} WHERE k % 3 = 0 AND species > 3")
def both_groups(spark, sf):
    df = points(spark, sf).select("obs_id", F.when(F.col("k") % 3 == 0, F.col("value")).alias("first"), F.when(F.col("species") > 3, F.col("value")).alias("second"))
    return O.both_groups(df, "first", "second").select("obs_id")


_WIN = "to_timestamp(ceil((epoch_us(ts) / CAST(1000000 AS DOUBLE) - 5400) / 10800) * 10800 + 5400)::TIMESTAMP"


@R.add(
    f"SELECT window_end, user_id AS tile, species, avg(value) AS value, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n FROM (SELECT *, {_WIN} AS window_end FROM {P}) GROUP BY ALL", "value lon lat"
)
def super_obs(spark, sf):
    df = points(spark, sf).withColumns({"window_end": C.window_end(F.col("ts"), 10800, 5400), "tile": F.col("user_id")})
    return O.super_obs(df, ["window_end", "tile", "species"], ["value", "lon", "lat"])


def _cell(c: str, low: int, n: int) -> str:
    return f"CAST(greatest(1, least(ceil(({c} + {low}) / 10), {n})) AS INT)"


@R.add(
    f"""SELECT p.obs_id, p.assim AND h.has IS NULL AS assim FROM (SELECT obs_id, species, k % 2 = 0 AS assim, {_cell('lon', 180, 36)} AS ci, {_cell('lat', 90, 18)} AS cj FROM {P}) p
    LEFT JOIN (SELECT DISTINCT {_cell('lon', 180, 36)} AS ci, {_cell('lat', 90, 18)} AS cj, 1 AS has FROM {P} WHERE species = 2 AND k > 97) h ON p.ci = h.ci AND p.cj = h.cj AND p.species = 1"""
)
def suppress_species(spark, sf):
    df = with_cell(points(spark, sf), GRID, "lon", "lat").withColumn("assim", F.col("k") % 2 == 0)
    df = df.withColumn("species", F.when((F.col("species") == 2) & (F.col("k") <= 97), 9).otherwise(F.col("species")))
    return O.suppress_species(df, [(1, 2), (4, 7)], [1, 2, 4]).select("obs_id", "assim")


_LOG = f"SELECT strftime(date_trunc('hour', ts), '%Y%m%d_%H%M%Sz') AS analysis_time, kind AS descr, 'reader' || (k % 2) AS reader, CAST(count(*) AS INT) AS n_obs, 'file' || (user_id % 3) AS file FROM {P} GROUP BY ALL"


@R.add(_LOG)
def obs_log(spark, sf):
    df = points(spark, sf).select(
        F.date_trunc("hour", "ts").alias("analysis_time"), F.col("kind").alias("descr"), F.concat(F.lit("reader"), F.col("k") % 2).alias("reader"), F.concat(F.lit("file"), F.col("user_id") % 3).alias("file")
    )
    return ingest.obs_log(df)


@R.add(f"SELECT descr, reader, CAST(count(DISTINCT analysis_time) AS INT) AS n_times, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM ({_LOG}) GROUP BY ALL")
def read_obs_log(spark, sf):
    """Logs written as text with blanks around their fields, as they are padded in files, and read again: observations by species and reader."""
    path = shared(spark, "obs-log")
    padded = obs_log(spark, sf).select(*(F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("analysis_time", "descr", "reader", "n_obs", "file")))
    padded.write.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    log = ingest.read_obs_log(spark, path)
    return log.groupBy("descr", "reader").agg(F.countDistinct("analysis_time").cast("int").alias("n_times"), F.sum("n_obs").alias("n_obs"))


@R.add(
    f"""SELECT name, ts FROM (SELECT 'ab_' || CASE WHEN k % 9 = 0 THEN '2024013X000000' WHEN k % 9 = 1 THEN '20061231235959' ELSE strftime(ts, '%Y%m%d%H%M%S') END || '.bin' AS name,
    date_trunc('second', ts) AS ts, k FROM {P}) WHERE k % 9 > 1 AND ts > TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-04 00:00:00'"""
)
def files_in_window(spark, sf):
    k = F.col("k")
    digits = F.when(k % 9 == 0, F.lit("2024013X000000")).when(k % 9 == 1, F.lit("20061231235959")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    names = points(spark, sf).select(F.concat(F.lit("ab_"), digits, F.lit(".bin")).alias("name"))
    return ingest.files_in_window(names, "2024-01-03 00:00:00", "2024-01-04 00:00:00", {"ab_": 4, "other_": 7}).select("name", "ts")


@R.add(
    f"""SELECT DISTINCT 'ab_' || strftime(ts, '%Y%m%d%H%M%S') || '.bin' AS name, date_trunc('second', ts) AS ts FROM {P}
    WHERE date_trunc('second', ts) > TIMESTAMP '2024-01-03 21:00:00' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-04 03:00:00'"""
)
def files_over_midnight(spark, sf):
    """The files of a window that spans midnight, from the listings of both days, which share some names."""
    names = points(spark, sf).select(F.concat(F.lit("ab_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".bin")).alias("name"), F.to_date("ts").alias("day"))
    before, now = (names.where(F.col("day").isin(*days)) for days in (("2024-01-03",), ("2024-01-03", "2024-01-04")))
    return ingest.files_in_window(ingest.listed_over(before, now), "2024-01-03 21:00:00", "2024-01-04 03:00:00", {"ab_": 4}).select("name", "ts")
