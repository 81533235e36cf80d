"""The model's tables, derived from the driver's tables by SQL text that Spark and DuckDB both run.

Table names stand in braces. frame() runs a text in Spark; sql() turns it into a subquery for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

D = "CAST({} AS DOUBLE)".format

OBS = f"""
SELECT l_suppkey AS tile, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS species, l_shipdate AS time,
       l_linestatus = 'O' AS assim, l_quantity AS obs, {D(1)} + l_discount * {D(10)} AS obsvar,
       l_extendedprice / {D(2000)} AS fcst, {D(1)} + l_tax * {D(10)} AS fcstvar,
       (l_quantity + l_extendedprice / {D(2000)}) / {D(2)} AS ana, ({D(2)} + l_discount * {D(10)} + l_tax * {D(10)}) / {D(4)} AS anavar,
       l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax
FROM {{lineitem}}
"""
#: A total order over the rows that repeat a key.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]

OBS1 = OBS.rstrip() + "\nWHERE l_linenumber <= 4\n"

TILES = f"""
SELECT s_suppkey AS tile, {D(-180)} + CAST((s_suppkey * 37) % 360 AS DOUBLE) + {D(0.25)} AS com_lon,
       {D(-60)} + CAST((s_suppkey * 17) % 120 AS DOUBLE) + {D(0.25)} AS com_lat,
       CAST((s_suppkey % 4) + 1 AS DOUBLE) / {D(4)} AS frac_cell, CAST(100 + s_suppkey AS DOUBLE) AS area, s_acctbal AS elev,
       {D(-180)} + CAST((s_suppkey * 37) % 360 AS DOUBLE) - {D(0.25)} AS min_lon, {D(-180)} + CAST((s_suppkey * 37) % 360 AS DOUBLE) + {D(0.75)} AS max_lon,
       {D(-60)} + CAST((s_suppkey * 17) % 120 AS DOUBLE) - {D(0.25)} AS min_lat, {D(-60)} + CAST((s_suppkey * 17) % 120 AS DOUBLE) + {D(0.75)} AS max_lat
FROM {{supplier}}
"""

POINTS = f"""
SELECT event_id AS obs_id, ts, event_type AS kind,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS species,
       {D(-180)} + CAST((user_id * 37) % 360 AS DOUBLE) + CAST(event_id % 100 AS DOUBLE) / {D(100)} AS lon,
       {D(-60)} + CAST((user_id * 17) % 120 AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / {D(100)} AS lat,
       value, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM {{events}}
"""

SERIES = """
SELECT o_custkey % 50 AS tile, o_orderdate AS time, o_totalprice AS value, o_orderkey AS id FROM {orders}
"""

#: Members of an ensemble: a vector's components; tile is the label.
ENSEMBLE_SPARK = "SELECT CAST(label AS BIGINT) AS tile, vec_id AS id, m + 1 AS ens, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) AS m, x"
ENSEMBLE_DUCK = "SELECT CAST(label AS BIGINT) AS tile, vec_id AS id, CAST(unnest(generate_series(1, len(embedding))) AS INT) AS ens, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"

def bias_sql(rows: str, keys: str, order: str, fold) -> str:
    """SQL of streaming.state.obs_bias over rows (keys, order, t, obs, pred, assim), with {columns} to choose.

    Times since the last observation are windows over the rows that have one; the bias is a recursion along the row numbers.
    """
    most, known = 365 * 86400, "obs IS NOT NULL AND pred IS NOT NULL AND t IS NOT NULL"
    window = f"(PARTITION BY {keys} ORDER BY {order})"
    same = " AND ".join(f"r.{k} = x.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE rows_ AS MATERIALIZED (SELECT *, row_number() OVER {window} AS r_, {known} AS known_ FROM ({rows})),
    last_ AS (SELECT *, lag(CASE WHEN known_ THEN t END IGNORE NULLS) OVER {window} AS last FROM rows_),
    since_ AS (SELECT *, CASE WHEN NOT known_ THEN NULL WHEN last IS NULL THEN {most} ELSE least(greatest(t - last, {fold.dt}), {most}) END AS since FROM last_),
    gaps_ AS MATERIALIZED (SELECT *, coalesce(lag(since IGNORE NULLS) OVER {window}, {most}) AS gap FROM since_),
    bias_ AS (SELECT {keys}, CAST(0 AS BIGINT) AS r_, CAST(0 AS DOUBLE) AS bias FROM gaps_ WHERE r_ = 1
      UNION ALL SELECT r.{", r.".join(keys.split(", "))}, r.r_, x.bias + CASE WHEN r.known_ THEN (1 - exp(-r.since / CAST({fold.relax} AS DOUBLE))) * (r.obs - x.bias - r.pred) ELSE 0 END
      FROM bias_ x JOIN gaps_ r ON {same} AND r.r_ = x.r_ + 1)
    SELECT {{columns}}, CASE WHEN known_ THEN obs - bias END AS obs, bias, assim AND known_ AND least(since + gap, {most}) < {fold.cutoff} AS assim FROM gaps_ JOIN bias_ USING ({keys}, r_)"""


_NAME = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_NAME.findall(text))}
    df = spark.sql(text, **used)
    return df.withColumns({c: df[c].cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def sql(text: str) -> str:
    return "(" + _NAME.sub(r"\1", text) + ")"
