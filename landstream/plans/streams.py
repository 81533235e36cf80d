"""Queries that run streams over the event table, and jobs that write tables and read them back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..sources import ingest, sinks
from ..sources.paths import shared
from ..streaming import events as E
from ..streaming import state as T
from ..streaming import windows as W
from ..streaming.compaction import MonthlySums
from . import diagnostics as Q
from .fixtures import OBS, ORDER, POINTS, SERIES, TILES, bias_sql, frame, sql
from .register import Registry

R = Registry()
P = sql(POINTS)


#: When rows arrive: in batches of five days, one in ten a batch too late.
BATCHED = f"SELECT *, CAST(floor((epoch_us(ts) - 1704067200000000) / CAST(432000000000 AS DOUBLE)) + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS INT) AS batch FROM {P}"


def batched(spark, sf):
    days = F.floor((F.unix_micros("ts") - 1704067200000000) / 432000000000)
    return frame(spark, sf, POINTS).withColumn("batch", (days + F.when(F.col("k") % 10 == 0, 1).otherwise(0)).cast("int"))


def publish(df, path, batch="batch"):
    """Files in the order of arrival: one write, a file a batch, whose times are set to the batches' order."""
    df.repartition(batch).write.partitionBy(batch).parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    for folder in files.globStatus(jvm.org.apache.hadoop.fs.Path(path, f"{batch}=*")):  # a folder a batch
        at = 1_600_000_000_000 + int(folder.getPath().getName().split("=")[1]) * 60_000
        for file in files.listStatus(folder.getPath()):
            files.setTimes(file.getPath(), at, -1)


ARRIVALS = "obs_id LONG, ts TIMESTAMP, user_id LONG, kind STRING, value DOUBLE"


def arrivals(spark, sf, upto=None, path=None):
    """The events as a stream of files in the order of arrival, a batch a time; `upto`: only batches below that."""
    path = path or shared(spark, "arrivals")
    df = batched(spark, sf).select("obs_id", "ts", "user_id", "kind", "value", "batch")
    publish(df if upto is None else df.where(F.col("batch") < upto), path)
    return W.replay(spark, f"{path}/batch=*", ARRIVALS)


def append_sql(keys: str, time: str, start: str, end: str, late: int) -> str:
    """Windows that the watermark has passed at the end, of rows that came before their window was closed.

    A batch drops rows by the watermark that closed windows at the end of the batch before it.
    """
    us = late * 1_000_000
    return f"""(WITH a AS (SELECT *, {time} AS m, {end} AS ends, {start} AS begins FROM ({BATCHED})),
    b AS (SELECT batch, max(m) AS top FROM a GROUP BY batch),
    w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM b)
    SELECT begins, {keys}, avg(value) AS value, count(*) AS n FROM a JOIN w USING (batch)
    WHERE (seen IS NULL OR ends > seen // 1000 * 1000 - {us}) AND ends <= (SELECT max(top) FROM b) // 1000 * 1000 - {us} GROUP BY begins, {keys})"""


_CENTRE = "CAST(ceil((epoch_us(ts) / CAST(1000000 AS DOUBLE) - 5400) / 10800) * 10800 AS BIGINT)"


@R.add(
    f"SELECT to_timestamp(begins)::TIMESTAMP AS analysis_time, user_id, value, n FROM {append_sql('user_id', 'epoch_us(ts) - 1', _CENTRE, f'({_CENTRE} + 5400) * 1000000', 3000)}", "value"
)
def streaming_super_obs(spark, sf):
    stream = W.streaming_super_obs(arrivals(spark, sf), 10800, ["user_id"], ["value"])
    return W.run_to_table(stream, shared(spark, "super-obs"))


_HOUR = "CAST(epoch_us(ts) // 3600000000 AS BIGINT)"


@R.add(f"SELECT kind, to_timestamp(begins * 3600)::TIMESTAMP AS start, value, n FROM {append_sql('kind', 'epoch_us(ts)', _HOUR, f'({_HOUR} + 1) * 3600000000', 3600)}", "value")
def streaming_time_average(spark, sf):
    return W.run_to_table(W.streaming_time_average(arrivals(spark, sf), 3600, ["kind"], ["value"]), shared(spark, "time-average"))


@R.add("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, user_id, count(*) AS n, sum(value) AS value_sum, sum(value * value) AS value_sum2 FROM events GROUP BY ALL", "value_sum value_sum2")
def incremental_sums(spark, sf):
    path, keys = shared(spark, "sums"), ["day", "user_id"]
    partial = lambda df: df.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"), F.sum(F.col("value") ** 2).alias("value_sum2"))
    W.incremental_sums(arrivals(spark, sf), path, partial, keys)
    return W.merged(spark, path, keys)


def monthly_partial(df):
    return df.groupBy(F.trunc("ts", "week").alias("month"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"), F.sum(F.col("value") ** 2).alias("value_sum2"))


@R.add("SELECT CAST(date_trunc('week', ts) AS DATE) AS month, user_id, count(*) AS n, sum(value) AS value_sum, sum(value * value) AS value_sum2 FROM events GROUP BY ALL", "value_sum value_sum2")
def compacted_sums(spark, sf):
    """Sums of a stream that are compacted every other batch; weeks stand for months, as the table has one month."""
    sums = MonthlySums(spark, shared(spark, "compacted"), monthly_partial, ["month", "user_id"], every=2)
    sums.run(arrivals(spark, sf))
    return sums.read()


BIAS = T.obs_bias(10800, 864000.0, 5 * 86400)
BIAS_SCHEMA = "obs_id long, us long, obs double, bias double, assim boolean"

LATE = 3000


def bias_rows(df):
    """Rows of obs_bias; one observation in eleven is missing."""
    return df.select("user_id", "obs_id", "ts", F.unix_seconds("ts").alias("t"), F.when(F.col("obs_id") % 11 != 0, F.col("value")).alias("obs"), (F.col("value") * 0.9).alias("pred"), F.lit(True).alias("assim"))


def seen_sql(back: int = 2, joint: int = -1) -> str:
    """The watermark (microseconds, null before the first) that decides about a batch's late rows: of the batches up to the one
    `back` before it; just before `joint` a stream ended, and the batch after it knows all before."""
    us = LATE * 1_000_000
    top = "max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND {} PRECEDING)".format
    return f"SELECT batch, (CASE WHEN batch = {joint} THEN {top(1)} ELSE {top(back)} END) // 1000 * 1000 - {us} AS seen FROM (SELECT batch, max(epoch_us(ts)) AS top FROM ({BATCHED}) GROUP BY batch)"


#: The watermark at the end.
_LAST = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - {LATE * 1_000_000} FROM ({BATCHED}))"
_ROWS = "SELECT user_id, obs_id, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, CASE WHEN obs_id % 11 <> 0 THEN value END AS obs, value * 0.9 AS pred, TRUE AS assim"
_IN_TIME = f"{_ROWS} FROM ({BATCHED}) JOIN ({seen_sql()}) USING (batch) WHERE (seen IS NULL OR epoch_us(ts) > seen) AND epoch_us(ts) <= {_LAST}"


@R.add(bias_sql(_IN_TIME, "user_id", "us, obs_id", BIAS).format(columns="user_id, obs_id, us"), "obs bias")
def streaming_obs_bias(spark, sf):
    """obs_bias in event time over batches that arrive out of order: as the batch fold of the rows that came in time."""
    out = E.fold_events(bias_rows(arrivals(spark, sf)), ["user_id"], "ts", ["obs_id"], BIAS, BIAS_SCHEMA, ["obs_id", "us"])
    return W.run_to_table(out, shared(spark, "obs-bias"))


def factor_rows(df):
    v, n = F.col("value"), F.col("obs_id")
    return df.select("user_id", "obs_id", "ts", v.alias("obs"), (v * 0.9 + n % 7).alias("fcst"), (v * 0.95 + n % 5).alias("ana"), (n % 3 + 1.0).alias("fcstvar"), (n % 4 + 1.0).alias("obsvar"))


FACTORS = T.adaptive_factors(0.05, 0.05)
_FACTORS = f"""WITH RECURSIVE f AS (SELECT user_id, obs_id, epoch_us(ts) AS us, value AS obs, value * 0.9 + obs_id % 7 AS fcst, value * 0.95 + obs_id % 5 AS ana, obs_id % 3 + CAST(1 AS DOUBLE) AS fcstvar, obs_id % 4 + CAST(1 AS DOUBLE) AS obsvar
    FROM ({BATCHED}) JOIN ({seen_sql()}) USING (batch) WHERE (seen IS NULL OR epoch_us(ts) > seen) AND epoch_us(ts) <= {_LAST}),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, obs_id) AS r FROM f),
    x AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS obs_id, CAST(0 AS DOUBLE) AS ab, CAST(0 AS DOUBLE) AS hph, CAST(0 AS DOUBLE) AS oa, CAST(0 AS DOUBLE) AS rr, CAST(1 AS DOUBLE) AS p, CAST(1 AS DOUBLE) AS q FROM r WHERE r = 1
      UNION ALL SELECT user_id, r, obs_id, ab, hph, oa, rr,
        least(greatest(p * CASE WHEN hph > 0 THEN least(greatest(ab / hph, 1 / 1.01e0), 1.01e0) ELSE 1 END, 0.2e0), 5e0), least(greatest(q * CASE WHEN rr > 0 THEN least(greatest(oa / rr, 1 / 1.01e0), 1.01e0) ELSE 1 END, 0.2e0), 5e0)
      FROM (SELECT r.user_id, r.r, r.obs_id, 0.95e0 * ab + 0.05e0 * (ana - fcst) * (obs - fcst) AS ab, 0.95e0 * hph + 0.05e0 * fcstvar AS hph, 0.95e0 * oa + 0.05e0 * (obs - ana) * (obs - fcst) AS oa, 0.95e0 * rr + 0.05e0 * obsvar AS rr, p, q
        FROM x JOIN r ON r.user_id = x.user_id AND r.r = x.r + 1))
    SELECT user_id, obs_id, p AS p_factor, q AS r_factor FROM x WHERE r > 0"""


@R.add(_FACTORS, "p_factor r_factor")
def streaming_adaptive_factors(spark, sf):
    """Adaptive factors in event time."""
    out = E.fold_events(factor_rows(arrivals(spark, sf)), ["user_id"], "ts", ["obs_id"], FACTORS, "obs_id long, p_factor double, r_factor double", ["obs_id"])
    return W.run_to_table(out, shared(spark, "factors"))


@R.add(f"SELECT obs_id, batch - (SELECT min(batch) FROM ({BATCHED})) AS batch, coalesce(epoch_us(ts) <= seen, FALSE) AS late FROM ({BATCHED}) JOIN ({seen_sql()}) USING (batch)")
def streaming_late_rows(spark, sf):
    """Main and side table of a stream over arrivals: together every row once."""
    main, side = E.late_split(arrivals(spark, sf), shared(spark, "late"))
    return main.withColumn("late", F.lit(False)).unionByName(side.withColumn("late", F.lit(True))).select("obs_id", "batch", "late")


@R.add(bias_sql(_IN_TIME, "user_id", "us, obs_id", BIAS).format(columns="user_id, obs_id, us"), "obs bias")
def streaming_restart(spark, sf):
    """A stream that is stopped after half of its batches, without closing what waits, and goes on from its checkpoint: as unbroken."""
    path, files = shared(spark, "restart"), shared(spark, "arrivals")
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    df = batched(spark, sf).select("obs_id", "ts", "user_id", "kind", "value", "batch")
    was, half = spark.conf.get(setting), 3
    try:
        for begun in (False, True):
            spark.conf.set(setting, str(begun).lower())
            publish(df.where(F.col("batch") >= half if begun else F.col("batch") < half), f"{files}/{begun}")
            stream = W.replay(spark, f"{files}/*/batch=*", ARRIVALS)
            out = W.run_to_table(E.fold_events(bias_rows(stream), ["user_id"], "ts", ["obs_id"], BIAS, BIAS_SCHEMA, ["obs_id", "us"]), path)
    finally:
        spark.conf.set(setting, was)
    return out


_BREAK = 1704067200 + 10 * 86400
_AFTER = f"""SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000 * 1000 - {LATE * 1_000_000} AS seen
    FROM (SELECT batch, max(epoch_us(ts)) AS top FROM ({BATCHED}) WHERE epoch_us(ts) >= {_BREAK}000000 GROUP BY batch)"""


@R.add(
    f"""SELECT * FROM ({bias_sql(f"{_ROWS} FROM ({BATCHED}) WHERE epoch_us(ts) < {_BREAK}000000 UNION ALL {_ROWS} FROM ({BATCHED}) JOIN ({_AFTER}) USING (batch) WHERE epoch_us(ts) >= {_BREAK}000000 AND (seen IS NULL OR epoch_us(ts) > seen) AND epoch_us(ts) <= {_LAST}",
    "user_id", "us, obs_id", BIAS).format(columns="user_id, obs_id, us")}) WHERE us >= {_BREAK}000000""", "obs bias"
)
def batch_then_stream(spark, sf):
    """A batch fold over the past, its state saved and read, and a stream that starts from it: as one fold."""
    path, files = shared(spark, "handover"), shared(spark, "arrivals")
    df = batched(spark, sf).select("obs_id", "ts", "user_id", "kind", "value", "batch")
    past = bias_rows(df.where(F.unix_seconds("ts") < _BREAK))
    sinks.write_state(T.last_state(past, ["user_id"], ["ts", "obs_id"], BIAS, "user_id long"), f"{path}/state", 1)
    publish(df.where(F.unix_seconds("ts") >= _BREAK), files)
    stream = E.fold_events(bias_rows(W.replay(spark, f"{files}/batch=*", ARRIVALS)), ["user_id"], "ts", ["obs_id"], BIAS, BIAS_SCHEMA, ["obs_id", "us"], start=sinks.read_state(spark, f"{path}/state"))
    return W.run_to_table(stream, path)


@R.add(
    f"""SELECT user_id, max(n) AS waiting, max_by(bias, ROW(us, obs_id)) AS bias, CAST(max_by(t, ROW(us, obs_id)) FILTER (obs IS NOT NULL) AS DOUBLE) AS last
    FROM ({bias_sql(_IN_TIME, "user_id", "us, obs_id", BIAS).format(columns="user_id, obs_id, us, t")}) LEFT JOIN (SELECT user_id, count(*) AS n FROM ({BATCHED}) JOIN ({seen_sql()}) USING (batch)
    WHERE (seen IS NULL OR epoch_us(ts) > seen) AND epoch_us(ts) > {_LAST} GROUP BY user_id) USING (user_id) GROUP BY user_id""", "bias"
)
def stream_state(spark, sf):
    """The state of a stream, read through the state data source: each key's fold, and how many rows still wait."""
    path = shared(spark, "state")
    out = E.fold_events(bias_rows(arrivals(spark, sf)), ["user_id"], "ts", ["obs_id"], BIAS, "obs_id long, bias double", ["obs_id"])
    W.run_to_table(out.select("user_id", "obs_id", "bias"), path)
    state = E.saved_state(spark, f"{path}/log", ["user_id"], "user_id long").select("user_id", F.from_json("state", "bias double, last double, gap double").alias("s"))
    waiting = E.held_rows(spark, f"{path}/log", ["user_id"], "user_id long").groupBy("user_id").agg(F.count("*").alias("waiting"))
    return state.join(waiting, "user_id", "left").select("user_id", "waiting", "s.bias", "s.last")


@R.add(
    f"""SELECT obs_id, batch FROM ({BATCHED}) JOIN (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM (SELECT batch, max(ts) AS top FROM ({BATCHED}) GROUP BY batch)) USING (batch) WHERE ts < seen - INTERVAL 50 MINUTE"""
)
def late_rows(spark, sf):
    return W.late_rows(batched(spark, sf), 3000).select("obs_id", "batch")


@R.add(f"SELECT month, tile, species, n, obs_sum, oxf_sum FROM {Q.SUMS}", "obs_sum oxf_sum")
def write_monthly_sums(spark, sf):
    """Sums written by month, in two runs of which the second finds the first's months done."""
    path, sums = shared(spark, "monthly"), Q.sums(spark, sf)
    sinks.config_guard(spark, path, {"experiments": ["a", "b"]})
    sinks.write_monthly_sums(sums.where("year(month) < 1998"), path)
    sinks.write_monthly_sums(sums, path)
    back = spark.read.parquet(f"{path}/sums").withColumn("month", F.col("month").cast("date"))
    return back.select("month", "tile", "species", "n", "obs_sum", "oxf_sum")


@R.add(f"SELECT tile, species, obs, ana FROM {sql(OBS)}", "obs ana")
def write_diagnostics(spark, sf):
    path = shared(spark, "diagnostics")
    sinks.write_diagnostics(frame(spark, sf, OBS).select("tile", "species", "obs", "ana"), path)
    return spark.read.parquet(path)


@R.add(f"SELECT tile, least(avg(value) / 200000, 1) AS mean, stddev_samp(value) / 20000 AS stdv FROM {sql(SERIES)} GROUP BY tile", "mean stdv")
def write_climatology(spark, sf):
    path = shared(spark, "climatology")
    clim = frame(spark, sf, SERIES).groupBy("tile").agg((F.avg("value") / 200000).alias("mean"), (F.stddev_samp("value") / 20000).alias("stdv"))
    sinks.write_climatology(clim, path, ["mean"])
    return spark.read.parquet(path)


@R.add(f"SELECT tile, frac_cell, area FROM {sql(TILES)}", "frac_cell area")
def write_constants(spark, sf):
    path = shared(spark, "constants")
    sinks.write_constants(frame(spark, sf, TILES), ["frac_cell", "area"], path)
    return spark.read.parquet(path)


@R.add(Q.stats_sql(Q.merge_sql("tile, species"), "tile, species"), Q.STATS)
def write_stats(spark, sf):
    path = shared(spark, "stats")
    sinks.write_stats(D.temporal_stats(Q.sums(spark, sf)), path)
    return spark.read.parquet(path)


@R.add(f"SELECT user_id, last(value ORDER BY ts, obs_id) AS bias FROM {P} GROUP BY user_id", "bias")
def state_snapshot(spark, sf):
    """A versioned table of keyed state, of which the last version is read back."""
    path, df = shared(spark, "state"), frame(spark, sf, POINTS)
    final = df.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "obs_id")).alias("bias"))
    sinks.write_state(final.withColumn("bias", F.lit(0.0)), path, 1)
    sinks.write_state(final, path, 2)
    return sinks.read_state(spark, path)


def kept(df, path):
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@R.add(
    f"""SELECT time, assim, CAST(species AS BIGINT) AS species, tile AS tilenum, CAST(CAST(obs AS FLOAT) AS DOUBLE) AS obs, CASE WHEN assim THEN CAST(CAST(obsvar AS FLOAT) AS DOUBLE) END AS obsvar, CAST(CAST(fcst AS FLOAT) AS DOUBLE) AS fcst,
    CAST(CAST(ana AS FLOAT) AS DOUBLE) AS ana, 'x' AS exp FROM (SELECT *, row_number() OVER (PARTITION BY time, tile, species ORDER BY {", ".join(f"{c} DESC" for c in ORDER)}) AS rn FROM {sql(OBS)}) WHERE rn = 1""", "obs obsvar fcst ana", 3
)
def ingest_obs_fcst_ana(spark, sf):
    """Binary files of observations, one for each analysis time, made of the table and decoded again."""
    (df,) = Q.last_rows(spark, sf, OBS)
    rows = df.select("time", F.col("assim").cast("int").alias("assim"), "species", F.col("tile").alias("tilenum"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), "obs", F.when(F.col("assim"), F.col("obsvar")).alias("obsvar"), "fcst", "fcstvar", "ana", "anavar")
    files = kept(ingest.encode_obs_fcst_ana(rows.withColumn("time", F.col("time").cast("timestamp"))), shared(spark, "obs-files"))
    return ingest.decode_obs_fcst_ana(files, "x").select("time", "assim", "species", "tilenum", "obs", "obsvar", "fcst", "ana", "exp")


@R.add(
    f"""SELECT 'x' AS exp, time, CAST(species AS BIGINT) AS species, tile AS tilenum, CAST(CAST(obs AS FLOAT) AS DOUBLE) AS obs, CASE WHEN assim THEN CAST(CAST(obsvar AS FLOAT) AS DOUBLE) END AS obsvar
    FROM (SELECT *, row_number() OVER (PARTITION BY time, tile, species ORDER BY {", ".join(f"{c} DESC" for c in ORDER)}) AS rn FROM {sql(OBS)})
    WHERE rn = 1 AND time > TIMESTAMP '2024-01-10 00:00:00' AND time <= TIMESTAMP '2024-01-20 00:00:00'""", "obs obsvar", 3
)
def obs_files_window(spark, sf):
    """Files of two experiments on disk; the source opens those of one in a window of time, and decodes four of eleven records."""
    from ..sources import obs_source

    (df,) = Q.last_rows(spark, sf, OBS)
    rows = df.select(F.col("time").cast("timestamp").alias("time"), F.col("assim").cast("int").alias("assim"), "species", F.col("tile").alias("tilenum"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), "obs", F.when(F.col("assim"), F.col("obsvar")).alias("obsvar"), "fcst", "fcstvar", "ana", "anavar")
    both = F.explode(F.array(*(F.concat(F.lit(f"{exp}/{exp}.obs."), F.col("path")) for exp in "xy")))
    folder = shared(spark, "obs-source")
    obs_source.write_files(ingest.encode_obs_fcst_ana(rows).withColumn("path", both), folder)
    return obs_source.read_window(spark, folder, datetime(2024, 1, 10), datetime(2024, 1, 20), ["x"], ["exp", "time", "species", "tilenum", "obs", "obsvar"])


@R.add(f"SELECT tile AS tile_id, CAST(100 AS BIGINT) AS typ, com_lon, com_lat, max_lon, frac_cell, area FROM {sql(TILES)}", "com_lon com_lat max_lon frac_cell area", 3)
def ingest_tiles(spark, sf):
    """Tile catalogues of ten thousand tiles each, encoded and decoded."""
    t = frame(spark, sf, TILES)
    whole = {"tile_id": F.col("tile"), "typ": F.lit(100), "pfaf": F.lit(0), "i_indg": F.lit(1), "j_indg": F.lit(1), "frac_pfaf": F.lit(0.0)}
    files = kept(ingest.encode_tiles(t.withColumns({**whole, "block": F.floor(F.col("tile") / 10_000)}), "block"), shared(spark, "tile-files"))
    return ingest.decode_tiles(files).select("tile_id", "typ", "com_lon", "com_lat", "max_lon", "frac_cell", "area")


@R.add(
    """SELECT scope, 'LatLon' AS gridtype, CAST(CASE WHEN scope = 'global' THEN 36 ELSE n END AS INT) AS n_lon, CASE WHEN scope = 'global' THEN CAST(-180 AS DOUBLE) ELSE CAST(-180 + nation AS DOUBLE) END AS ll_lon
    FROM (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY ALL), (SELECT unnest(['global', 'domain']) AS scope)""", "ll_lon", 3
)
def ingest_grids(spark, sf):
    """The global and a domain grid of each nation, encoded and decoded."""
    n = spark.read.parquet(f"{sf}/supplier.parquet").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    df = n.withColumn("scope", F.explode(F.array(F.lit("global"), F.lit("domain"))))
    whole = F.col("scope") == "global"
    ints = {"ind_base": 1, "i_dir": 1, "j_dir": -1, "n_lat": 18, "i_offg": 0, "j_offg": 0}
    doubles = {"ll_lat": -90.0, "ur_lon": 180.0, "ur_lat": 90.0, "dlon": 10.0, "dlat": 10.0}
    df = df.withColumns({"gridtype": F.lit("LatLon"), "n_lon": F.when(whole, 36).otherwise(F.col("n")).cast("int"), "ll_lon": F.when(whole, -180.0).otherwise(-180.0 + F.col("nation")), **{c: F.lit(v) for c, v in {**ints, **doubles}.items()}})
    files = kept(ingest.encode_grids(df, "nation"), shared(spark, "grid-files"))
    return ingest.decode_grids(files).select("scope", "gridtype", "n_lon", "ll_lon")


@R.add("SELECT kind AS descr, CAST(row_number() OVER (ORDER BY kind) AS INT) AS species, n % 2 = 0 AS assim, n / 2 AS errstd, [CAST(40 AS DOUBLE), n] AS ang FROM (SELECT event_type AS kind, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL)", "errstd")
def ingest_species(spark, sf):
    """A catalogue of species as text, written and read."""
    from pyspark.sql import Window

    path = shared(spark, "species")
    kinds = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("descr")).agg(F.count("*").cast("double").alias("n"))
    df = kinds.withColumns({"species": F.row_number().over(Window.orderBy("descr")), "assim": F.col("n") % 2 == 0, "errstd": F.col("n") / 2, "ang": F.array(F.lit(40.0), F.col("n"))})
    blank = {"t": F.lit(""), "d": F.lit(0.0), "i": F.lit(0), "b": F.lit(False)}
    df = df.withColumns({name: blank[kind] for name, kind in ingest._SPECIES if name not in df.columns})
    ingest.species_text(df).write.text(path)
    return ingest.read_species(spark, path).select("descr", "species", "assim", "errstd", "ang")


@R.add(f"SELECT DISTINCT k AS tile FROM {P} WHERE k % 2 = 0 ORDER BY tile")
def tile_list(spark, sf):
    """A text list of tiles, written and read; other lines are left out."""
    path = shared(spark, "tiles")
    df = frame(spark, sf, POINTS)
    df.select(F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.lit("# odd")).alias("value")).distinct().write.text(path)
    return ingest.read_tile_list(spark, path).select(F.col("tile").cast("int").alias("tile")).orderBy("tile")
