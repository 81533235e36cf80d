"""Queries of calendar, numeric and grid functions over whole columns."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import grid as G
from ..functions import numeric as N
from .fixtures import POINTS, SERIES, frame, sql
from .register import Registry

R = Registry()
P, S = sql(POINTS), sql(SERIES)
#: The first days of the eight-day slots, as month and day.
_SLOT_BEGINS = [f"{month:02d}{day:02d}" for month, day in ((d.month, d.day) for d in (date(2001, 1, 1) + timedelta(8 * k) for k in range(46)))]
_SLOT = f"CAST(len(list_filter({_SLOT_BEGINS}, lambda b: b <= strftime(time, '%m%d'))) AS INT)"
_LEAP = "(year(time) % 4 = 0 AND (year(time) % 100 <> 0 OR year(time) % 400 = 0))"


@R.add(
    f"""SELECT id, {_LEAP} AS leap, day(last_day(time)) AS days, CAST(floor((dayofyear(time) - CASE WHEN {_LEAP} AND dayofyear(time) >= 59 THEN 2 ELSE 1 END) / CAST(5 AS DOUBLE)) + 1 AS INT) AS pentad,
    {_SLOT} AS slot, time + INTERVAL 5400 SECOND AS later FROM {S}"""
)
def calendar_columns(spark, sf):
    t = F.col("time")
    days = C.days_in_month(F.year(t), F.month(t))
    later = C.add_seconds(t, F.lit(5400))
    return frame(spark, sf, SERIES).select("id", C.is_leap_year(F.year(t)).alias("leap"), days.cast("long").alias("days"), C.pentad(t).alias("pentad"), C.eight_day_slot(t).alias("slot"), later.alias("later"))


@R.add(f"SELECT obs_id, to_timestamp(CAST(round(value * 1000000 + 946727935.816) AS BIGINT))::TIMESTAMP AS tt12, to_timestamp(CAST(round(value * 1000000) + 946684800 AS BIGINT))::TIMESTAMP AS ut00, to_timestamp(CAST(round(value * 1000000) + 946728000 AS BIGINT))::TIMESTAMP AS ut12 FROM {P}")
def j2000_columns(spark, sf):
    s = F.col("value") * 1000000
    return frame(spark, sf, POINTS).select("obs_id", C.from_j2000(s, "TT12").alias("tt12"), C.from_j2000(F.round(s), "UT00").alias("ut00"), C.from_j2000(F.round(s), "UT12").alias("ut12"))


_SOD = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"
_W = "2 * pi() / 86400"


@R.add(f"SELECT obs_id, CAST((({_SOD} + 5400) // 10800) % 8 + 1 AS INT) AS slot, cos({_SOD} * {_W}) AS c1, sin({_SOD} * {_W}) AS s1, cos(2 * {_SOD} * {_W}) AS c2, sin(2 * {_SOD} * {_W}) AS s2 FROM {P}", "c1 s1 c2 s2")
def time_of_day_columns(spark, sf):
    _, c1, s1, c2, s2 = C.diurnal_harmonics(F.col("ts"), 5)
    return frame(spark, sf, POINTS).select("obs_id", C.tod_slot(F.col("ts"), 8).alias("slot"), c1.alias("c1"), s1.alias("s1"), c2.alias("c2"), s2.alias("s2"))


_GD = "(2 * sqrt((x / 4) * (x / 4) + (y / 3) * (y / 3)))"


@R.add(
    f"""SELECT obs_id, CASE WHEN abs(x) > 4 OR abs(y) > 3 OR {_GD} >= 2 THEN 0 WHEN {_GD} <= 0.001 THEN 1
    WHEN {_GD} <= 1 THEN 1 - CAST(5 AS DOUBLE) / 3 * {_GD} ** 2 + 0.625 * {_GD} ** 3 + 0.5 * {_GD} ** 4 - 0.25 * {_GD} ** 5
    ELSE 4 - 5 * {_GD} + CAST(5 AS DOUBLE) / 3 * {_GD} ** 2 + 0.625 * {_GD} ** 3 - 0.5 * {_GD} ** 4 + {_GD} ** 5 / 12 - CAST(2 AS DOUBLE) / 3 / {_GD} END AS taper,
    sign(x) * least(abs(x), 2.5) AS clipped, (2 * x + 3) * x + 4 AS poly, CASE WHEN k % 2 = 0 THEN value + x * 0.5 ELSE value * abs(x) ** 0.5 END AS pert, 'ens' || lpad(CAST(k AS VARCHAR), 4, '0') AS member
    FROM (SELECT *, CAST(k % 11 - 5 AS DOUBLE) AS x, CAST(k % 7 - 3 AS DOUBLE) AS y FROM {P})""", "taper clipped poly pert")  # fmt: skip
def numeric_columns(spark, sf):
    k = F.col("k")
    x, y = (k % 11 - 5).cast("double"), (k % 7 - 3).cast("double")
    df = frame(spark, sf, POINTS).withColumns({"x": x, "y": y})
    x, y = F.col("x"), F.col("y")
    pert = N.apply_pert(F.col("value"), F.when(k % 2 == 0, x).otherwise(F.abs(x)), k % 2, 0.5)
    return df.select(
        "obs_id", N.gaspari_cohn(x, y, 4.0, 3.0).alias("taper"), N.clip_abs(x, 2.5).alias("clipped"), N.polyval(F.array(F.lit(2.0), F.lit(3.0), F.lit(4.0)), x).alias("poly"), pert.alias("pert"),
        N.ens_id_string(k).alias("member"),
    )


@R.add(
    f"""SELECT obs_id, CASE WHEN k % 2 = 0 THEN sqrt(f) * (value - 1) + 1 ELSE exp(-0.5 * ln(1 + f * (exp(CAST(0.2 AS DOUBLE)) - 1)) + sqrt(ln(1 + f * (exp(CAST(0.2 AS DOUBLE)) - 1))) * (ln(value + 1) + 0.1) / 0.3) END AS pert
    FROM (SELECT *, 0.5 + CAST(k % 5 AS DOUBLE) / 4 AS f FROM {P})""", "pert")  # fmt: skip
def adapt_pert(spark, sf):
    k = F.col("k")
    mu, p = F.when(k % 2 == 0, 1.0).otherwise(-0.1), F.when(k % 2 == 0, F.col("value")).otherwise(F.col("value") + 1)
    return frame(spark, sf, POINTS).select("obs_id", N.adapt_pert(p, k % 2, 0.5 + (k % 5).cast("double") / 4, mu, F.lit(0.3)).alias("pert"))


@R.add(
    f"""SELECT obs_id, CAST(ceil((lon + 180) / 10) AS INT) AS ci, CAST(ceil((lat + 90) / 10) AS INT) AS cj, 25 * 180 / (pi() * 6371) / cos(radians(lat)) AS dx, 25 * 180 / (pi() * 6371) AS dy FROM {P}""", "dx dy"
)
def latlon_cells(spark, sf):
    i, j = G.LatLonGrid().cell(F.col("lon"), F.col("lat"))
    dx, dy = G.km_to_deg(25.0, F.col("lat"))
    return frame(spark, sf, POINTS).select("obs_id", i.alias("ci"), j.alias("cj"), dx.alias("dx"), dy.alias("dy"))


def _ease_sql(grid: str) -> str:
    n = lambda x: f"{x!r}e0" if "e" not in repr(x) else repr(x)
    scale, cols, rows = G.EASE2[grid]
    e, r = G.ECCENTRICITY, n(G.RADIUS)
    q = f"({n(1 - G._E2)} * (s / (1 - {n(G._E2)} * s * s) - {n(1 / (2 * e))} * ln((1 - {n(e)} * s) / (1 + {n(e)} * s))))"
    if grid[0] == "M":
        x, y, here = f"{r} * {n(G._KZ)} * radians(lon)", f"{r} * {q} / (2 * {n(G._KZ)})", "TRUE"
        col = f"least(greatest(round({n((cols - 1) / 2)} + {x} / {n(scale)}), 0), {cols - 1})"
    else:
        sign = 1 if grid[0] == "N" else -1
        rho = f"({r} * sqrt(greatest({n(G._POLE)} - ({sign}) * {q}, 0)))"
        x, y, here = f"{rho} * sin(radians(lon))", f"(-({sign}) * {rho} * cos(radians(lon)))", f"lat * ({sign}) >= 0"
        col = f"round({n((cols - 1) / 2)} + {x} / {n(scale)})"
    return f"""SELECT obs_id, '{grid}' AS grid, CASE WHEN {here} THEN CAST(round({n((rows - 1) / 2)} - {y} / {n(scale)}) AS INT) END AS "row", CASE WHEN {here} THEN CAST({col} AS INT) END AS col
    FROM (SELECT *, sin(radians(lat)) AS s FROM {P})"""


@R.add(" UNION ALL ".join(map(_ease_sql, G.EASE2)))
def ease2_cells(spark, sf):
    """Cells of each point in all grids, by one pass over the points."""
    cells = []
    for grid in G.EASE2:
        row, col = G.ease2_cell(F.col("lat"), F.col("lon"), grid)
        cells.append(F.struct(F.lit(grid).alias("grid"), row.alias("row"), col.alias("col")))
    return frame(spark, sf, POINTS).select("obs_id", F.inline(F.array(*cells)))


@R.add(f"SELECT obs_id, (2 * value + 1) * lon AS value, (2 * lon + 1) * value AS lon FROM {P}", "value lon")
def record_arithmetic(spark, sf):
    """A record times a constant plus one, then times another record, field by field."""
    df = frame(spark, sf, POINTS).withColumns({"other_value": F.col("lon"), "other_lon": F.col("value")})
    grown = N.elementwise(df, ["value", "lon"], lambda x: 2 * x + 1)
    return N.combine(grown, ["value", "lon"], "other_", lambda x, y: x * y).select("obs_id", "value", "lon")


@R.add(f"SELECT obs_id, CASE WHEN value <= 6 THEN 3 WHEN value <= 22.5 THEN 9 ELSE 36 END AS resolution FROM {P}", "resolution")
def closest_resolution(spark, sf):
    return frame(spark, sf, POINTS).select("obs_id", N.closest(F.col("value"), [3.0, 9.0, 36.0]).alias("resolution"))
