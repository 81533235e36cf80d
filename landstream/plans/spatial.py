"""Queries of spatial joins and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import EASE2, ECCENTRICITY, RADIUS, EaseGrid, LatLonGrid, neighbours
from ..operators import spatial as S
from .fixtures import POINTS, TILES, frame, sql
from .register import Registry, round_double

R = Registry()
GRID = LatLonGrid()
P, T = sql(POINTS), sql(TILES)


def cell(c: str, low: int, n: int) -> str:
    return f"CAST(greatest(1, least(ceil(({c} + {low}) / 10), {n})) AS INT)"


TC = f"(SELECT *, {cell('com_lon', 180, 36)} AS ci, {cell('com_lat', 90, 18)} AS cj FROM {T})"


def points(spark, sf):
    return frame(spark, sf, POINTS)


def tiles(spark, sf):
    return frame(spark, sf, TILES)


@R.add(f"SELECT ci, cj, count(*) AS n, list_sort(list(tile)) AS tiles FROM {TC} GROUP BY ci, cj")
def tiles_by_cell(spark, sf):
    return S.tiles_by_cell(tiles(spark, sf), GRID)


_ASSIGN = f"""(SELECT p.obs_id, t.tile, abs(p.lon - t.com_lon) <= {{x}} AND abs(p.lat - t.com_lat) <= {{y}}
 OR (p.lon BETWEEN t.min_lon AND t.max_lon AND p.lat BETWEEN t.min_lat AND t.max_lat) AS ok,
 row_number() OVER (PARTITION BY p.obs_id ORDER BY abs(p.lon - t.com_lon) + abs(p.lat - t.com_lat), t.tile) AS rn
 FROM (SELECT *, {cell('lon', 180, 36)} AS ci, {cell('lat', 90, 18)} AS cj FROM {P} WHERE lon > -180 AND lon < 180 AND lat > -90 AND lat < 90) p JOIN {TC} t USING (ci, cj))"""


@R.add(f"SELECT obs_id, tile FROM {_ASSIGN.format(x=2, y=2)} WHERE rn = 1 AND ok")
def assign_tile(spark, sf):
    return S.assign_tile(points(spark, sf), tiles(spark, sf), GRID, 2.0).select("obs_id", "tile")


@R.add(f"SELECT p.lon, p.lat, a.tile, count(*) AS n FROM {_ASSIGN.format(x=2, y=2)} a JOIN {P} p USING (obs_id), (SELECT unnest([1, 2])) WHERE rn = 1 AND ok GROUP BY ALL", "lon lat")
def assign_tile_repeated(spark, sf):
    """Observations that are equal in all columns stay as many as they were."""
    places = points(spark, sf).select("lon", "lat")
    return S.assign_tile(places.unionByName(places), tiles(spark, sf), GRID, 2.0).groupBy("lon", "lat", "tile").agg(F.count("*").alias("n"))


@R.add(f"SELECT obs_id, tile FROM {_ASSIGN.format(x='150 * 180 / (pi() * 6371) / cos(radians(p.lat))', y='150 * 180 / (pi() * 6371)')} WHERE rn = 1 AND ok")
def assign_tile_fov(spark, sf):
    return S.assign_tile_fov(points(spark, sf), tiles(spark, sf), GRID, 300.0, "km").select("obs_id", "tile")


_ELLIPSE = f"(SELECT u.obs_id, t.tile, t.area, ((t.com_lon - u.lon) / 15) ** 2 + ((t.com_lat - u.lat) / 9) ** 2 AS d2 FROM {P} u JOIN {TC} t ON ((t.com_lon - u.lon) / 15) ** 2 + ((t.com_lat - u.lat) / 9) ** 2 <= 1)"


@R.add(f"SELECT obs_id, tile, d2 FROM {_ELLIPSE}", "d2", early=True)
def tiles_in_ellipse(spark, sf):
    found = S.in_ellipse(points(spark, sf).select("obs_id", "lon", "lat"), tiles(spark, sf).select("tile", *S.PLACE), 15.0, 9.0, finish=round_double)
    return found.select("obs_id", "tile", "d2")


@R.add(f"SELECT u.obs_id, t.tile FROM {P} u JOIN {TC} t ON (t.com_lon - u.lon) ** 2 + (t.com_lat - u.lat) ** 2 <= 144")
def neighbours_in_radius(spark, sf):
    return S.in_ellipse(points(spark, sf).select("obs_id", "lon", "lat"), tiles(spark, sf).select("tile", *S.PLACE), 12.0, 12.0).select("obs_id", "tile")


_STATE = f"(SELECT tile, ens, CASE WHEN (tile * ens) % 97 <> 0 THEN CAST((tile * 7 + ens * 13) % 31 AS DOUBLE) END AS x FROM {T}, (SELECT unnest(generate_series(1, 8)) AS ens))"


@R.add(
    f"""SELECT obs_id, CAST(ens AS INT) AS ens, CASE WHEN count(x) = count(*) THEN sum(w * x) / sum(w) END AS pred FROM
    (SELECT u.obs_id, t.tile, t.area AS w FROM {P} u JOIN {T} t ON ((t.com_lon - u.lon) / 10) ** 2 + ((t.com_lat - u.lat) / 10) ** 2 <= 1) JOIN {_STATE} USING (tile) GROUP BY ALL""", "pred"
)
def predict_obs(spark, sf):
    t = tiles(spark, sf)
    state = t.select("tile", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("ens"))
    state = state.withColumn("x", F.when((F.col("tile") * F.col("ens")) % 97 != 0, ((F.col("tile") * 7 + F.col("ens") * 13) % 31).cast("double")))
    return S.predict_obs(points(spark, sf).select("obs_id", "lon", "lat"), t, state, 10.0)


_KM = "(40 * 180 / (pi() * 6371))"
_D2 = f"(((t.com_lon - u.lon) * cos(radians(u.lat)) / {_KM}) ** 2 + ((t.com_lat - u.lat) / {_KM}) ** 2)"


@R.add(
    f"""SELECT obs_id, CAST(ens AS INT) AS ens, CASE WHEN count(x) = count(*) THEN sum(w * x) / sum(w) END AS pred FROM
    (SELECT u.obs_id, t.tile, t.area * exp(-2 * {_D2}) AS w FROM {P} u JOIN {T} t ON {_D2} <= 1) JOIN {_STATE} USING (tile) GROUP BY ALL""", "pred"
)
def predict_obs_km(spark, sf):
    """Fields of view in kilometres: twice as far, with a Gaussian weight."""
    t = tiles(spark, sf)
    state = t.select("tile", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("ens"))
    state = state.withColumn("x", F.when((F.col("tile") * F.col("ens")) % 97 != 0, ((F.col("tile") * 7 + F.col("ens") * 13) % 31).cast("double")))
    return S.predict_obs(points(spark, sf).select("obs_id", "lon", "lat"), t, state, 20.0, "km")


@R.add(f"SELECT t.tile, p.obs_id FROM {T} t JOIN {P} p ON abs(p.lon - t.com_lon) <= 3 AND abs(p.lat - t.com_lat) <= 3 AND p.species IN (1, 3)")
def local_obs(spark, sf):
    return S.local_obs(tiles(spark, sf), points(spark, sf), 3.0, 3.0, [1, 3]).select("tile", "obs_id")


def ease_cell(grid: str, lon: str = "lon", lat: str = "lat") -> tuple[str, str]:
    """(column, row) of a cylindrical equal-area grid, by its formulas."""
    scale, cols, rows = EASE2[grid]
    e, s = f"CAST({ECCENTRICITY!r} AS DOUBLE)", f"sin(radians({lat}))"
    k = f"(cos(radians(30)) / sqrt(1 - {e} * {e} * sin(radians(30)) * sin(radians(30))))"
    q = f"((1 - {e} * {e}) * ({s} / (1 - {e} * {e} * {s} * {s}) - 1 / (2 * {e}) * ln((1 - {e} * {s}) / (1 + {e} * {s}))))"
    col = f"CAST(least(greatest(round({(cols - 1) / 2} + {RADIUS} * {k} * radians({lon}) / CAST({scale!r} AS DOUBLE)), 0), {cols - 1}) AS INT)"
    return col, f"CAST(round({(rows - 1) / 2} - {RADIUS} * {q} / (2 * {k}) / CAST({scale!r} AS DOUBLE)) AS INT)"


def _ease(grid: str, edge: str = ">") -> str:
    i, j = ease_cell(grid)
    return f"SELECT obs_id, value, user_id, {i} AS ci, {j} AS cj FROM {P} WHERE lon {edge} -180 AND lon < 180"


def ease_tiles(spark, sf, grid):
    """Cells that some points of two thirds of the users are in, as tiles: id, centre, and a box of no size."""
    col, row = grid.cell(F.col("lon"), F.col("lat"))
    cells = points(spark, sf).where("user_id % 3 <> 0").where(grid.inside(F.col("lon"), F.col("lat"))).select(col.alias("i"), row.alias("j")).distinct()
    lon, lat = grid.centre(F.col("i"), F.col("j"))
    t = cells.select((F.col("j").cast("long") * EASE2[grid.name][1] + F.col("i")).alias("tile"), lon.alias("com_lon"), lat.alias("com_lat"))
    return t.select("tile", "com_lon", "com_lat", F.col("com_lon").alias("min_lon"), F.col("com_lon").alias("max_lon"), F.col("com_lat").alias("min_lat"), F.col("com_lat").alias("max_lat"))


def _ease_sql(grid: str) -> str:
    cols = EASE2[grid][1]
    return f"SELECT obs_id, CAST(cj AS BIGINT) * {cols} + ci AS tile FROM ({_ease(grid)}) SEMI JOIN (SELECT DISTINCT ci, cj FROM ({_ease(grid)}) WHERE user_id % 3 <> 0) USING (ci, cj)"


@R.add(_ease_sql("M36"))
def assign_tile_ease36(spark, sf):
    grid = EaseGrid("M36")
    return S.assign_tile(points(spark, sf), ease_tiles(spark, sf, grid), grid, 1.0).select("obs_id", "tile")


@R.add(_ease_sql("M09"))
def assign_tile_ease9(spark, sf):
    grid = EaseGrid("M09")
    return S.assign_tile(points(spark, sf), ease_tiles(spark, sf, grid), grid, 1.0).select("obs_id", "tile")


@R.add(f"SELECT ci, cj, count(*) AS n, list_sort(list(tile)) AS tiles FROM (SELECT DISTINCT ci, cj, CAST(cj AS BIGINT) * {EASE2['M09'][1]} + ci AS tile FROM ({_ease('M09')}) WHERE user_id % 3 <> 0) GROUP BY ci, cj")
def tiles_by_cell_ease(spark, sf):
    grid = EaseGrid("M09")
    return S.tiles_by_cell(ease_tiles(spark, sf, grid), grid)


@R.add(
    f"""SELECT ci // 4 AS gi, cj // 4 AS gj, arg_min(g, CAST(cj AS BIGINT) * 10000 + ci) AS representative, avg(g) AS mean, coalesce(stddev_samp(g), 0) AS stdv, coalesce(stddev_samp(g), 0) > 0.01 AS uneven
    FROM (SELECT ci, cj, avg(value) AS g FROM ({_ease('M09', '>=')}) GROUP BY ALL) GROUP BY ALL""", "representative mean stdv"
)
def coarsen_cells_ease(spark, sf):
    """Cells of the 9 km grid nest in those of the 36 km grid, four each way."""
    df = S.with_cell(points(spark, sf), EaseGrid("M09"), "lon", "lat").groupBy("ci", "cj").agg(F.avg("value").alias("g"))
    return S.coarsen_cells(df, 4, "g", first=0)


@R.add(
    f"""WITH c AS MATERIALIZED (SELECT ci, cj, avg(value) AS g FROM ({_ease('M36', '>=')}) GROUP BY ALL) SELECT a.ci, a.cj, avg(b.g) AS g FROM c a JOIN c b
    ON abs(a.cj - b.cj) <= 1 AND least(abs(a.ci - b.ci), {EASE2['M36'][1]} - abs(a.ci - b.ci)) <= 1 GROUP BY a.ci, a.cj""", "g"
)
def neighbour_mean_ease(spark, sf):
    """Mean over a cell and its neighbours, around the globe."""
    grid = EaseGrid("M36")
    df = S.with_cell(points(spark, sf), grid, "lon", "lat").groupBy("ci", "cj").agg(F.avg("value").alias("g"))
    spread = df.select("g", F.explode(neighbours(grid, F.col("ci"), F.col("cj"))).alias("c")).groupBy(F.col("c.i").alias("ci"), F.col("c.j").alias("cj")).agg(F.avg("g").alias("g"))
    return df.select("ci", "cj").join(spread, ["ci", "cj"]).select("ci", "cj", "g")


_NEAR = f"(SELECT t.tile, p.value, row_number() OVER (PARTITION BY t.tile ORDER BY sqrt((p.lon - t.com_lon) ** 2 + (p.lat - t.com_lat) ** 2), p.value) AS rn FROM {T} t JOIN {P} p ON sqrt((p.lon - t.com_lon) ** 2 + (p.lat - t.com_lat) ** 2) <= 1.5)"


@R.add(f"SELECT t.tile AS id, n.value FROM {T} t LEFT JOIN (SELECT * FROM {_NEAR} WHERE rn = 1) n ON n.tile = t.tile", "value")
def nearest_point_grid(spark, sf):
    cells = tiles(spark, sf).select(F.col("tile").alias("id"), "com_lon", "com_lat")
    return S.nearest_point(cells, points(spark, sf).select("lon", "lat", "value"), 1.5)


@R.add(f"SELECT a.obs_id, CAST(ens AS INT) AS ens, x AS pred FROM (SELECT obs_id, tile FROM {_ASSIGN.format(x=0, y=0)} WHERE rn = 1) a JOIN {_STATE} USING (tile)", "pred")
def predict_obs_point(spark, sf):
    """A field of view of 0 is the observation's own tile."""
    t = tiles(spark, sf)
    state = t.select("tile", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("ens"))
    state = state.withColumn("x", F.when((F.col("tile") * F.col("ens")) % 97 != 0, ((F.col("tile") * 7 + F.col("ens") * 13) % 31).cast("double")))
    return S.predict_obs(points(spark, sf).select("obs_id", "lon", "lat"), t, state, 0.0, grid=GRID)


_V = f"(SELECT *, CASE WHEN tile % 5 <> 0 THEN elev END AS v FROM {TC})"


def valued(spark, sf):
    return S.with_cell(tiles(spark, sf), GRID, "com_lon", "com_lat").withColumn("v", F.when(F.col("tile") % 5 != 0, F.col("elev")))


@R.add(f"SELECT ci, cj, sum(v * w) / NULLIF(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS v FROM (SELECT *, CASE WHEN ci % 4 = 0 THEN 0 ELSE frac_cell END AS w FROM {_V}) GROUP BY ci, cj", "v")
def tile_to_grid(spark, sf):
    """Some cells have no weight."""
    return S.tile_to_grid(valued(spark, sf).withColumn("frac_cell", F.when(F.col("ci") % 4 == 0, 0.0).otherwise(F.col("frac_cell"))), "v")


@R.add(f"SELECT ci, cj, arg_max(elev, tile) AS elev FROM {TC} GROUP BY ci, cj", "elev")
def tile_to_grid_last(spark, sf):
    return S.tile_to_grid_last(valued(spark, sf), "elev")


@R.add(f"SELECT ci, cj, avg(v) AS v FROM {_V} GROUP BY ci, cj", "v")
def tile_to_latlon(spark, sf):
    return S.tile_to_latlon(valued(spark, sf).drop("ci", "cj"), "v", GRID)


_CELLS = f"(SELECT {cell('lon', 180, 36)} AS ci, {cell('lat', 90, 18)} AS cj, avg(value) AS g FROM {P} GROUP BY ALL)"


def cells(spark, sf):
    return S.with_cell(points(spark, sf), GRID, "lon", "lat").groupBy("ci", "cj").agg(F.avg("value").alias("g"))


@R.add(f"SELECT t.tile, c.g FROM {TC} t LEFT JOIN {_CELLS} c USING (ci, cj)", "g")
def grid_to_tile(spark, sf):
    return S.grid_to_tile(valued(spark, sf), cells(spark, sf)).select("tile", "g")


@R.add(f"SELECT c.ci, c.cj, CASE WHEN t.ci IS NOT NULL THEN c.g END AS g FROM {_CELLS} c LEFT JOIN (SELECT DISTINCT ci, cj FROM {TC}) t ON c.ci = t.ci AND c.cj = t.cj", "g")
def mask_grid_to_tiles(spark, sf):
    return S.mask_to_tiles(cells(spark, sf), valued(spark, sf), "g")


@R.add(
    f"""SELECT CAST((ci - 1) // 4 + 1 AS INT) AS gi, CAST((cj - 1) // 4 + 1 AS INT) AS gj, arg_min(g, cj * 1000 + ci) AS representative, avg(g) AS mean, coalesce(stddev_samp(g), 0) AS stdv,
    coalesce(stddev_samp(g), 0) > 0.01 AS uneven FROM {_CELLS} GROUP BY ALL""", "representative mean stdv"
)
def coarsen_cells(spark, sf):
    return S.coarsen_cells(cells(spark, sf), 4, "g")


@R.add(
    f"""SELECT t.tile, coalesce(t.v, f.fill) AS v FROM {_V} t LEFT JOIN (SELECT a.tile, avg(c.v) AS fill FROM {_V} a JOIN (SELECT ci, cj, avg(v) AS v FROM {_V} WHERE v IS NOT NULL GROUP BY ALL) c
    ON abs(a.ci - c.ci) <= 3 AND abs(a.cj - c.cj) <= 3 WHERE a.v IS NULL GROUP BY a.tile) f ON t.tile = f.tile""", "v"
)
def fill_gaps(spark, sf):
    return S.fill_gaps(valued(spark, sf), "v", 3).select("tile", "v")


@R.add(
    f"""SELECT ci, cj, pol, avg(value) AS value, sqrt(avg(var)) AS std, avg(CASE WHEN assim THEN value END) AS assimilated, CASE WHEN min(orbit) = max(orbit) THEN min(orbit) ELSE 0 END AS orbit, 3 AS resolution
    FROM (SELECT CAST({cell('lon', 180, 36)} + di AS INT) AS ci, CAST({cell('lat', 90, 18)} + dj AS INT) AS cj, k % 2 AS pol, value, value * 2 AS var, k % 3 = 0 AS assim, k % 2 + 1 AS orbit
      FROM {P}, (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj) WHERE species = 1) GROUP BY ci, cj, pol""", "value std assimilated"
)
def spread_obs_to_cells(spark, sf):
    k = F.col("k")
    df = S.with_cell(points(spark, sf).where("species = 1"), GRID, "lon", "lat").withColumns({"pol": k % 2, "var": F.col("value") * 2, "assim": k % 3 == 0, "orbit": k % 2 + 1})
    return S.spread_to_cells(df, 3, ["pol"])


@R.add(
    f"""SELECT tile, lo AS min_lon, hi AS max_lon, CASE WHEN com_lon BETWEEN lo AND hi THEN com_lon ELSE (lo + hi) / 2 END AS com_lon FROM
    (SELECT tile, com_lon, CASE WHEN w > 10 THEN -180 ELSE min_lon END AS lo, CASE WHEN w > 10 THEN -175 ELSE hi0 END AS hi FROM
      (SELECT *, hi0 - min_lon AS w FROM (SELECT *, CASE WHEN tile % 9 = 0 THEN max_lon + 300 ELSE max_lon END AS hi0 FROM {T})))""", "min_lon max_lon com_lon"
)
def repair_dateline(spark, sf):
    df = tiles(spark, sf).withColumn("max_lon", F.when(F.col("tile") % 9 == 0, F.col("max_lon") + 300).otherwise(F.col("max_lon")))
    return S.repair_dateline(df, 10.0).select("tile", "min_lon", "max_lon", "com_lon")


@R.add(f"SELECT tile FROM {T} WHERE tile % 7 <> 0 AND ((com_lon BETWEEN -60 AND 60 AND com_lat BETWEEN -30 AND 30) OR tile % 5 = 0)")
def select_domain(spark, sf):
    t = tiles(spark, sf)
    return S.select_domain(t, (-60.0, 60.0, -30.0, 30.0), t.where("tile % 7 = 0"), t.where("tile % 5 = 0")).select("tile")


@R.add(f"SELECT min(ci) AS min_ci, max(ci) AS max_ci, min(cj) AS min_cj, max(cj) AS max_cj, min(com_lon) AS min_com_lon, max(com_lon) AS max_com_lon, min(com_lat) AS min_com_lat, max(com_lat) AS max_com_lat FROM {TC}", "min_com_lon max_com_lon min_com_lat max_com_lat")
def min_extent(spark, sf):
    return S.min_extent(valued(spark, sf))


@R.add(f"SELECT count(DISTINCT (ci, cj)) AS n FROM (SELECT {cell('lon', 180, 36)} AS ci, {cell('lat', 90, 18)} AS cj FROM {P})")
def count_cells(spark, sf):
    return S.with_cell(points(spark, sf), GRID, "lon", "lat").agg(F.countDistinct("ci", "cj").alias("n"))


@R.add(
    f"""SELECT t.obs_id, CASE WHEN t.class < 12 THEN t.class ELSE u.usual END AS used, CAST(CASE WHEN t.class < 12 THEN t.class ELSE u.usual END AS DOUBLE) / 4 AS p
    FROM (SELECT obs_id, k % 16 AS class, {cell('lon', 180, 36)} AS ci FROM {P}) t LEFT JOIN
    (SELECT ci, arg_max(class, n * 100 - class) AS usual FROM (SELECT ci, class, count(*) AS n FROM (SELECT k % 16 AS class, {cell('lon', 180, 36)} AS ci FROM {P}) WHERE class < 12 GROUP BY ALL) GROUP BY ci) u USING (ci)""", "p"
)
def class_lookup(spark, sf):
    df = S.with_cell(points(spark, sf), GRID, "lon", "lat").withColumn("class", F.col("k") % 16)
    parameters = spark.range(12).select(F.col("id").cast("int").alias("class"), (F.col("id") / 4).alias("p"))
    return S.class_lookup(df, parameters, ["ci"]).select("obs_id", "used", "p")


@R.add(
    f"""SELECT a.obs_id, b.obs_id AS obs_id_b, CASE WHEN a.obs_id = b.obs_id THEN a.v ELSE sqrt(a.v * b.v) * exp(-0.5 * (((a.lon - b.lon) / 4) ** 2 + ((a.lat - b.lat) / 4) ** 2)) END AS cov
    FROM (SELECT *, CAST(ts AS DATE) AS g, 1 + obs_id % 3 AS v, obs_id % 2 AS s FROM {P}) a JOIN (SELECT *, CAST(ts AS DATE) AS g, 1 + obs_id % 3 AS v, obs_id % 2 AS s FROM {P}) b ON a.s = b.s AND a.g = b.g AND abs(a.lon - b.lon) <= 12 AND abs(a.lat - b.lat) <= 12""", "cov", early=True
)
def obs_pairs_cov(spark, sf):
    df = points(spark, sf).select("obs_id", "lon", "lat", (1 + F.col("obs_id") % 3).cast("double").alias("obsvar"), (F.col("obs_id") % 2).cast("int").alias("species"), F.to_date("ts").alias("g"))
    return S.pair_covariance(df, ["g"], 4.0, 4.0, finish=round_double).select("obs_id", "obs_id_b", "cov")


_LO = "((13.5 - (hour(ts) + 1 + CAST(minute(ts) AS DOUBLE) / 60 + CAST(second(ts) AS DOUBLE) / 3600)) * 15 + 180)"
_HI = "((13.5 - (hour(ts) - 1 + CAST(minute(ts) AS DOUBLE) / 60 + CAST(second(ts) AS DOUBLE) / 3600)) * 15 + 180)"


@R.add(
    f"""SELECT obs_id FROM (SELECT obs_id, lon, {_LO} - 360 * floor({_LO} / 360) - 180 AS lo, {_HI} - 360 * floor({_HI} / 360) - 180 AS hi FROM {P})
    WHERE CASE WHEN lo <= hi THEN lon BETWEEN lo AND hi ELSE lon >= lo OR lon <= hi END"""
)
def swath_longitudes(spark, sf):
    hour = F.expr("INTERVAL 1 HOUR")
    low, high = S.swath_longitudes(F.col("ts") - hour, F.col("ts") + hour, 13.5)
    return points(spark, sf).where(S.in_swath(F.col("lon"), low, high)).select("obs_id")


_PARAM = f"(SELECT t.*, m.v FROM {TC} t LEFT JOIN (SELECT user_id AS tile, avg(value) AS v FROM {P} WHERE user_id % 3 <> 0 GROUP BY user_id) m ON m.tile = t.tile)"


@R.add(
    f"""SELECT t.tile, coalesce(t.v, f.fill) AS v FROM {_PARAM} t LEFT JOIN (SELECT a.tile, avg(c.v) AS fill FROM {_PARAM} a JOIN (SELECT ci, cj, avg(v) AS v FROM {_PARAM} WHERE v IS NOT NULL GROUP BY ALL) c
    ON abs(a.ci - c.ci) <= 2 AND abs(a.cj - c.cj) <= 2 WHERE a.v IS NULL GROUP BY a.tile) f ON t.tile = f.tile""", "v"
)
def static_field_mean(spark, sf):
    df = points(spark, sf).where("user_id % 3 <> 0").select(F.col("user_id").alias("tile"), F.col("value").alias("v"))
    return S.static_field_mean(df, S.with_cell(tiles(spark, sf), GRID, "com_lon", "com_lat"), "v", 2).select("tile", "v")


@R.add(f"SELECT tile FROM {T} WHERE com_lon BETWEEN -60 AND 60 AND com_lat BETWEEN -30 AND 30")
def in_box(spark, sf):
    return tiles(spark, sf).where(S.in_box(F.col("com_lon"), F.col("com_lat"), (-60.0, 60.0, -30.0, 30.0))).select("tile")
