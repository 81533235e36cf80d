"""Spatial joins by cell: nearest tile, ellipses, footprints, halos, and mapping between tiles and grids.

Range joins explode the covering cells of one side and join on the cell, so Spark sees an equi-join; the exact test follows. The
cells of a search are about as large as its radius, whatever that is: the search grid has levels, and each row takes the level of its
own radius (meet()), so that it meets the tiles of nine cells at most.

Rows that share a place share the search: it runs over distinct places, and rows, or sums over the rows of a place, are joined to
what their place found. So its work grows with the places, not with the product of the rows that stand at them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid, km_to_deg
from ..functions.numeric import ratio
from ..sources.paths import kept
from .ranges import dealt

#: At level k a search grid has 2^k cells around the circle of longitudes, or along the half circle of latitudes.
MAX_LEVEL = 24
#: Fields of view below this, in degrees or kilometres, are points.
LEAST_FOV = 1e-4
#: Tiles that one cell may hold as a list; a grid whose cells hold more is too coarse for these tiles.
MAX_TILES = 10_000
#: Ids in a row of a place's observations; two such rows give the square of it at a time.
PACK = 64
#: Pairs of observations that one key of a join may try in one task, and observations whose pairs a task makes on average.
BLOCK_PAIRS, PAIR_ROWS = 1 << 28, 50_000


def with_cell(df: DataFrame, grid: Grid, lon: str, lat: str, names: tuple[str, str] = ("ci", "cj")) -> DataFrame:
    i, j = grid.clamped(F.col(lon), F.col(lat))
    return df.withColumns({names[0]: i, names[1]: j})


def tiles_by_cell(tiles: DataFrame, grid: Grid) -> DataFrame:
    """Per cell: number and sorted list of tiles. Cells with more than MAX_TILES are an error, before any list is made."""
    counts = bounded_cells(tiles, grid)
    listed = with_cell(tiles, grid, "com_lon", "com_lat").join(counts, ["ci", "cj"])
    return listed.groupBy("ci", "cj", "n").agg(F.array_sort(F.collect_list("tile")).alias("tiles"))


def bounded_cells(tiles: DataFrame, grid: Grid) -> DataFrame:
    """(ci, cj, n) of the cells with tiles; one with more than MAX_TILES, or than 1 where tiles are cells, is an error."""
    counts = with_cell(tiles, grid, "com_lon", "com_lat").groupBy("ci", "cj").agg(F.count("*").alias("n"))
    most = 1 if grid.one_tile else MAX_TILES
    # As a filter: a column that nobody reads would be pruned, and the error with it.
    few = F.when(F.col("n") <= most, True).otherwise(F.raise_error(F.lit(f"a cell holds more than {most} tiles; take a finer grid")).cast("boolean"))
    return counts.where(few)


def assign_tile(obs: DataFrame, tiles: DataFrame, grid: Grid, max_dist: Column | float | tuple[Column, Column] = 0.0) -> DataFrame:
    """The tile of an observation's cell that is nearest by Manhattan distance, the smallest id of equals.

    Observations outside the grid go; so do those outside the tile's box and farther than max_dist in longitude or latitude.
    The search is of distinct places (and distances): of tiles at one centre only the smallest id can win, and each cell's
    centres are one row, so each place meets one row at most, and observations take the tile of their place, equal ones apart.
    """
    mx, my = max_dist if isinstance(max_dist, tuple) else (max_dist, max_dist)
    mx, my = (m if isinstance(m, Column) else F.lit(m) for m in (mx, my))
    here = ["lon", "lat", "__mx", "__my"]
    placed = obs.where(grid.inside(F.col("lon"), F.col("lat"))).withColumns({"__mx": mx, "__my": my})
    points = with_cell(placed.select(*here).distinct(), grid, "lon", "lat")
    box = ["min_lon", "max_lon", "min_lat", "max_lat"]
    centres = with_cell(tiles, grid, "com_lon", "com_lat").groupBy("ci", "cj", "com_lon", "com_lat").agg(F.min(F.struct("tile", *box)).alias("t"))
    parts = F.struct("t.tile", "com_lon", "com_lat", *(f"t.{c}" for c in box))
    listed = centres.join(bounded_cells(tiles, grid), ["ci", "cj"]).groupBy("ci", "cj").agg(F.collect_list(parts).alias("__tiles"))
    lon, lat, mx, my = (F.col(c) for c in here)

    def near(t: Column) -> Column:
        dx, dy = F.abs(lon - t["com_lon"]), F.abs(lat - t["com_lat"])
        boxed = lon.between(t["min_lon"], t["max_lon"]) & lat.between(t["min_lat"], t["max_lat"])
        return F.struct((dx + dy).alias("d"), t["tile"].alias("tile"), (boxed | ((dx <= mx) & (dy <= my))).alias("ok"))

    best = points.join(listed, ["ci", "cj"]).withColumn("__best", F.array_min(F.transform("__tiles", near))).where("__best.ok")
    best = best.select(*(F.col(c).alias(f"{c}_at") for c in here), F.col("__best.tile").alias("__tile"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_at")) if c.startswith("__") else F.col(c) == F.col(f"{c}_at") for c in here]  # a distance may be null
    return placed.join(best, same).select(*obs.columns, F.col("__tile").alias("tile"))


def assign_tile_fov(obs: DataFrame, tiles: DataFrame, grid: Grid, fov: float, units: str = "deg", shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """assign_tile within half a field of view, in degrees or kilometres, after an optional shift of longitude and latitude."""
    moved = obs.withColumns({"lon": F.col("lon") + shift[0], "lat": F.col("lat") + shift[1]})
    reach = km_to_deg(fov / 2, F.col("lat")) if units == "km" else (F.lit(fov / 2), F.lit(fov / 2))
    return assign_tile(moved, tiles, grid, reach)


def search_level(radius: Column | float, whole: float) -> Column | int:
    """The finest level whose cells, parts of `whole` degrees, aren't smaller than the radius."""
    if not isinstance(radius, Column):
        return min(max(math.floor(math.log2(whole / max(radius, 1e-9))), 0), MAX_LEVEL)
    level = F.floor(F.log2(F.lit(whole) / F.greatest(radius, F.lit(1e-9))))
    return F.when(radius.isNotNull(), F.greatest(F.least(level, F.lit(MAX_LEVEL)), F.lit(0)).cast("int"))


def _index(x: Column, level: Column | int, whole: float) -> tuple[Column, Column]:
    """(number of a cell, unbounded; how many cells there are)."""
    n = F.lit(float(2**level)) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(x * n / whole), n.cast("long")


def _between(low: Column, high: Column, n: Column, wrap: bool) -> Column:
    if wrap:
        return F.when(high - low + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(low, high), lambda i: F.pmod(i, n)))
    inside = lambda i: F.greatest(F.least(i, n - 1), F.lit(0))
    return F.sequence(inside(low), inside(high))


def meet(
    points: DataFrame, others: DataFrame, rx: Column | float, ry: Column | float, wrap: bool = False, on: tuple[str, ...] = (),
    names: tuple[str, str] = ("lon", "lat"), others_names: tuple[str, str] = ("com_lon", "com_lat"), join: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = DataFrame.join,
) -> DataFrame:
    """Each point with the others in the cells that the box of its radii (degrees) touches: all within, and few beyond.

    Cells aren't smaller than the radius, so a box touches three of them each way at most. Where radii are columns (kilometres
    that widen towards the poles), the levels in use are found first, a row each, with the latitudes over which they are needed; the
    others then stand once in each level that is needed at their latitude. A null radius or place meets nothing. wrap: longitudes
    go on over the dateline. join: joins both by the names of their keys.
    """
    fixed = not isinstance(rx, Column) and not isinstance(ry, Column)
    lon, lat = (F.col(c) for c in names)
    level_x, level_y = search_level(rx, 360.0), search_level(ry, 180.0)
    spread = points.withColumns({"__rx": rx if isinstance(rx, Column) else F.lit(float(rx)), "__ry": ry if isinstance(ry, Column) else F.lit(float(ry))})
    if fixed:
        keyed = others
    else:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        spread = spread.withColumns({"__lx": as_col(level_x), "__ly": as_col(level_y)})
        used = spread.where(F.col("__lx").isNotNull() & F.col("__ly").isNotNull()).groupBy("__lx", "__ly").agg(F.min(lat - F.col("__ry")).alias("a"), F.max(lat + F.col("__ry")).alias("b"))
        levels = [(r["__lx"], r["__ly"], r.a, r.b) for r in used.collect() if r.a is not None]  # a row a pair of levels, 25 x 25 at most
        listed = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for x, y, a, b in levels or [(0, 0, 1.0, 0.0)]))
        at = F.col(others_names[1])
        keyed = others.withColumn("__l", F.explode(F.filter(listed, lambda v: at.between(v["a"], v["b"]))))
        keyed = keyed.withColumns({"__lx": F.col("__l.x"), "__ly": F.col("__l.y")}).drop("__l")
        level_x, level_y = F.col("__lx"), F.col("__ly")
    reach_x = F.least(F.col("__rx"), F.lit(360.0))
    (low_i, n), (high_i, _) = _index(lon - reach_x + 180, level_x, 360.0), _index(lon + reach_x + 180, level_x, 360.0)
    (low_j, m), (high_j, _) = _index(lat - F.least(F.col("__ry"), F.lit(180.0)) + 90, level_y, 180.0), _index(lat + F.least(F.col("__ry"), F.lit(180.0)) + 90, level_y, 180.0)
    rows = _between(low_j, high_j, m, False)
    cells = F.flatten(F.transform(_between(low_i, high_i, n, wrap), lambda i: F.transform(rows, lambda j: F.struct(i.alias("i"), j.alias("j")))))
    spread = spread.withColumn("__cell", F.explode(cells)).withColumns({"__i": F.col("__cell.i"), "__j": F.col("__cell.j")}).drop("__cell")
    (i, _), (j, _) = _index(F.col(others_names[0]) + 180, level_x, 360.0), _index(F.col(others_names[1]) + 90, level_y, 180.0)
    i = F.pmod(i, n) if wrap else F.greatest(F.least(i, n - 1), F.lit(0))
    keyed = keyed.withColumns({"__i": i, "__j": F.greatest(F.least(j, m - 1), F.lit(0))})
    keys = ["__i", "__j", *([] if fixed else ["__lx", "__ly"])]
    return join(spread, keyed, [*keys, *on]).drop(*keys)


def join_in_blocks(a: DataFrame, b: DataFrame, keys: list[str], sizes: tuple[Column, Column], n: int) -> DataFrame:
    """a joined with b by keys, where rows stand for many (sizes), dealt to n tasks at least.

    A key whose pairs are more than BLOCK_PAIRS is a square of blocks: each side's rows are dealt to its edge by their hash, and
    stand once in each block of their row or column, so a crowded key spreads over many tasks and each pair still meets once.
    """
    counts = a.groupBy(*keys).agg(F.sum(sizes[0]).alias("m")).join(b.groupBy(*keys).agg(F.sum(sizes[1]).alias("n")), keys)
    edge = F.ceil(F.sqrt(F.col("m").cast("double") * F.col("n") / BLOCK_PAIRS))
    crowded = counts.withColumn("__edge", edge).where("__edge > 1").select(*keys, "__edge")

    def split(df: DataFrame, own: str, other: str) -> DataFrame:
        number = F.pmod(F.xxhash64(*(c for c in df.columns if c not in keys)), "__edge")
        edges = df.join(crowded, keys, "left").withColumn("__edge", F.coalesce("__edge", F.lit(1).cast("long")))
        return dealt(edges.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__edge") - 1))).drop("__edge"), by, n)

    by = [*keys, "__row", "__column"]
    return split(a, "__row", "__column").join(split(b, "__column", "__row"), by).drop("__row", "__column")


PLACE = ["com_lon", "com_lat"]


def placed_with(points: DataFrame, rx: Column | float, ry: Column | float) -> tuple[DataFrame, list[str]]:
    """(points with their radii `__rx` and `__ry`, the columns that tell one search from another)."""
    radii = {c: r if isinstance(r, Column) else F.lit(float(r)) for c, r in (("__rx", rx), ("__ry", ry))}
    return points.withColumns(radii), ["lon", "lat", "__rx", "__ry"]


def places_in_ellipse(placed: DataFrame, here: list[str], tiles: DataFrame, rx: Column | float, ry: Column | float, wrap: bool = False) -> DataFrame:
    """(distinct places of placed, distinct places of tiles in the ellipse, d2). See placed_with()."""
    dx = F.col("com_lon") - F.col("lon")
    if wrap:
        dx = F.pmod(dx + 180, F.lit(360.0)) - 180
    dy = F.col("com_lat") - F.col("lat")
    d2 = ratio(dx, F.col("__rx")) ** 2 + ratio(dy, F.col("__ry")) ** 2
    rx, ry = (F.col(c) if isinstance(r, Column) else r for c, r in (("__rx", rx), ("__ry", ry)))
    met = meet(placed.select(*here).distinct(), tiles.select(*PLACE).distinct(), rx, ry, wrap)
    return met.withColumn("d2", d2).where("d2 <= 1").select(*here, *PLACE, "d2")


def in_ellipse(points: DataFrame, tiles: DataFrame, rx: Column | float, ry: Column | float, wrap: bool = False, finish: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(points, tiles within the ellipse, normalised square distance). points: id columns, lon, lat. A radius of 0 holds nothing.

    The result has every pair, so its rows grow with the square of the tables, but they are written out where they are read: only
    packs of the points of a place move, once, and places that meet and packs of tiles go to them where Spark can broadcast those.
    finish: what is to be done to d2, once for each pair of places.
    """
    placed, here = placed_with(points, rx, ry)
    (own, at), (packs, to) = in_packs(placed, here, "__point"), in_packs(tiles, PLACE, "__other")
    near = places_in_ellipse(at, here, to, rx, ry, wrap).withColumn("d2", finish(F.col("d2")))
    near = kept(near.join(at.drop("__packs"), here).join(to.drop("__packs"), PLACE), "near")
    rows = own.join(near, "__point_at").join(kept(packs, "packs"), "__other_at")
    rows = rows.withColumn("__point", F.explode("__point")).withColumn("__other", F.explode("__other"))
    one = lambda c, keys, item: F.col(c) if c in keys else F.col(item)[c].alias(c)
    return rows.select(*(one(c, here, "__point") for c in points.columns), *(one(c, PLACE, "__other") for c in tiles.columns), "d2")


def in_packs(df: DataFrame, here: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """((`name`_at, `name`: the other columns of rows of one place as structs), about PACK a row, in tasks that follow the rows;
    the places: here, `name`_at, __packs). Rows without a place go. A place's number stands for it, so that rows move without it."""
    at = f"{name}_at"
    places = df.groupBy(*here).agg(F.ceil(F.count("*") / PACK).alias("__packs")).withColumn(at, F.monotonically_increasing_id())
    places, others = kept(places.dropna(subset=here), "places"), [c for c in df.columns if c not in here]
    numbered = df.join(places, here).select(at, F.pmod(F.xxhash64(*others), "__packs").alias("__pack"), *others)
    n = max(-(-df.count() // PAIR_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return numbered.repartition(n, at, "__pack").groupBy(at, "__pack").agg(F.collect_list(F.struct(*others)).alias(name)).drop("__pack"), places


def predict_obs(points: DataFrame, tiles: DataFrame, state: DataFrame, fov: float, units: str = "deg", grid: Grid | None = None) -> DataFrame:
    """Footprint mean of a state per point and member: area weights within the ellipse; in km, twice the field and a Gaussian too.

    A null tile in the footprint makes the whole prediction null, and so does an area of 0. A field below LEAST_FOV is the
    observation's own tile: points' column `tile`, or else the nearest of their cell of `grid`. points: obs_id, lon, lat; state: tile, ens, x.
    Tiles of one place have one weight but for their areas, so their sums are made once, and so are those of points of one place.
    """
    if fov < LEAST_FOV:
        own = points if "tile" in points.columns else assign_tile(points, tiles, grid, (F.lit(float("inf")), F.lit(float("inf"))))
        return own.select("obs_id", "tile").join(state, "tile").select("obs_id", "ens", F.col("x").alias("pred"))
    # in km the search reaches 2 fields, so d2 there is a quarter of the field's
    (rx, ry), fall = (km_to_deg(2 * fov, F.col("lat")), F.exp(-2 * F.col("d2"))) if units == "km" else ((fov, fov), F.lit(1.0))
    placed, here = placed_with(points.select("obs_id", "lon", "lat"), rx, ry)
    area = F.col("area")
    totals = tiles.select("tile", *PLACE, "area").join(state, "tile").groupBy(*PLACE, "ens").agg(F.sum(area * F.col("x")).alias("wx"), F.sum(area).alias("w"), F.count("x").alias("n"), F.count("*").alias("m"))
    add = lambda f: [F.sum(f * F.col("wx")).alias("wx"), F.sum(f * F.col("w")).alias("w"), F.sum("n").alias("n"), F.sum("m").alias("m")]
    sums = places_in_ellipse(placed, here, tiles, rx, ry).join(totals, PLACE).groupBy(*here, "ens").agg(*add(fall))
    sums = placed.join(sums, here).groupBy("obs_id", "ens").agg(*add(F.lit(1.0)))
    return sums.select("obs_id", "ens", F.when(F.col("n") == F.col("m"), ratio(F.col("wx"), F.col("w"))).alias("pred"))


def local_obs(tiles: DataFrame, obs: DataFrame, xc: float, yc: float, species: list[int] | None = None) -> DataFrame:
    """Observations within the box of (xc, yc) around each tile, inclusive."""
    if species:
        obs = obs.where(F.col("species").isin(*species))
    near = (F.abs(F.col("lon") - F.col("com_lon")) <= xc) & (F.abs(F.col("lat") - F.col("com_lat")) <= yc)
    pairs = meet(obs.select("lon", "lat").distinct(), tiles.select(*PLACE).distinct(), xc, yc).where(near).select("lon", "lat", *PLACE)
    return obs.join(pairs, ["lon", "lat"]).join(tiles.select("tile", *PLACE), PLACE).select(*obs.columns, "tile", *PLACE)


def nearest_point(cells: DataFrame, points: DataFrame, reach: float = 0.14) -> DataFrame:
    """Each cell's nearest point's value; null when none is within reach. cells: id, com_lon, com_lat; points: lon, lat, value.

    Of points equally near the smallest value counts, so that a place needs its smallest only; a null is the last choice.
    """
    d = F.sqrt((F.col("lon") - F.col("com_lon")) ** 2 + (F.col("lat") - F.col("com_lat")) ** 2)
    best = F.min(F.struct("d", F.col("value").isNull().alias("none"), "value")).alias("best")
    least = points.groupBy("lon", "lat").agg(F.min("value").alias("value"))
    found = meet(least, cells.select(*PLACE).distinct(), reach, reach).withColumn("d", d).where(F.col("d") <= reach).groupBy(*PLACE).agg(best)
    found = cells.join(found, PLACE).groupBy("id").agg(F.min("best").alias("best"))
    return cells.join(found, "id", "left").select("id", F.col("best.value").alias("value"))


def tile_to_grid(df: DataFrame, value: str, weight: str = "frac_cell") -> DataFrame:
    """Weighted mean by cell; nulls are in neither sum, and weights that sum to 0 give null."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy("ci", "cj").agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(w)).alias(value))


def tile_to_grid_last(df: DataFrame, value: str, order: str = "tile") -> DataFrame:
    return df.groupBy("ci", "cj").agg(F.max_by(value, order).alias(value))


def tile_to_latlon(df: DataFrame, value: str, grid: Grid) -> DataFrame:
    """Plain mean over the tiles of each cell."""
    return with_cell(df, grid, "com_lon", "com_lat").groupBy("ci", "cj").agg(F.avg(value).alias(value))


def grid_to_tile(tiles: DataFrame, cells: DataFrame) -> DataFrame:
    return tiles.join(cells, ["ci", "cj"], "left")


def mask_to_tiles(cells: DataFrame, tiles: DataFrame, value: str) -> DataFrame:
    """Cells without a tile become null."""
    has = tiles.select("ci", "cj").distinct().withColumn("__has", F.lit(True))
    return cells.join(has, ["ci", "cj"], "left").withColumn(value, F.when(F.col("__has"), F.col(value))).drop("__has")


def coarsen_cells(df: DataFrame, factor: int, value: str, most: float = 0.01, first: int = 1) -> DataFrame:
    """Cells are numbered from `first`. Coarse cells: a representative value (of the first fine cell), the mean, the deviation, and whether it is too large."""
    up = lambda c: (F.floor((F.col(c) - first) / factor) + first).cast("int")
    out = df.groupBy(up("ci").alias("gi"), up("cj").alias("gj")).agg(
        F.min_by(value, F.struct("cj", "ci")).alias("representative"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdv")
    )
    return out.withColumn("uneven", F.col("stdv") > most)


def fill_gaps(tiles: DataFrame, value: str, reach: int) -> DataFrame:
    """Null tiles get the mean of the valid cells within `reach` cells each way; edges don't wrap."""
    cells = tiles.where(F.col(value).isNotNull()).groupBy("ci", "cj").agg(F.avg(value).alias("__v"))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    gaps = tiles.where(F.col(value).isNull()).select("tile", "ci", "cj").withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    gaps = gaps.select("tile", (F.col("ci") + F.col("di")).alias("ci"), (F.col("cj") + F.col("dj")).alias("cj"))
    mean = gaps.join(cells, ["ci", "cj"]).groupBy("tile").agg(F.avg("__v").alias("__fill"))
    return tiles.join(mean, "tile", "left").withColumn(value, F.coalesce(value, "__fill")).drop("__fill")


def spread_to_cells(obs: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Each observation covers width x width fine cells; overlapping ones are averaged. Orbits that disagree give flag 0.

    obs: ci, cj, value, var, assim, orbit, and keys (such as polarisation). A null orbit (mixed in its own footprint) is an error.
    """
    steps = F.sequence(F.lit(-((width - 1) // 2)), F.lit(width // 2))
    over = obs.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    over = over.withColumns({"ci": F.col("ci") + F.col("__i"), "cj": F.col("cj") + F.col("__j"), "orbit": F.coalesce("orbit", F.raise_error(F.lit("a footprint with mixed orbits")).cast("int"))})
    flag = {1: 2, 3: 3, 4: 1}.get(width, width)
    return over.groupBy("ci", "cj", *keys).agg(
        F.avg("value").alias("value"), F.sqrt(F.avg("var")).alias("std"), F.avg(F.when(F.col("assim"), F.col("value"))).alias("assimilated"),
        F.when(F.min("orbit") == F.max("orbit"), F.min("orbit")).otherwise(0).alias("orbit"), F.lit(flag).alias("resolution"),
    )


def repair_dateline(tiles: DataFrame, dlon: float, cell_low: str = "min_lon", cell_high: str = "max_lon") -> DataFrame:
    """Boxes wider than a cell cross the dateline and move to its eastern side; centres outside their box go to its middle."""
    wide = F.col(cell_high) - F.col(cell_low) > dlon
    out = tiles.withColumns({cell_low: F.when(wide, F.lit(-180.0)).otherwise(F.col(cell_low)), cell_high: F.when(wide, F.lit(-180 + dlon / 2)).otherwise(F.col(cell_high))})
    inside = F.col("com_lon").between(F.col(cell_low), F.col(cell_high))
    return out.withColumn("com_lon", F.when(inside, F.col("com_lon")).otherwise((F.col(cell_low) + F.col(cell_high)) / 2))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides; box: lowest and highest longitude, lowest and highest latitude."""
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def select_domain(tiles: DataFrame, box: tuple[float, float, float, float], exclude: DataFrame, include: DataFrame) -> DataFrame:
    """Not excluded, and in the box or included."""
    left = tiles.join(exclude.select("tile"), "tile", "left_anti")
    named = include.select("tile", F.lit(True).alias("__in")).distinct()
    return left.join(named, "tile", "left").where(in_box(F.col("com_lon"), F.col("com_lat"), box) | F.col("__in")).drop("__in")


def min_extent(tiles: DataFrame) -> DataFrame:
    return tiles.agg(*(f(c).alias(f"{f.__name__}_{c}") for f, c in ((F.min, "ci"), (F.max, "ci"), (F.min, "cj"), (F.max, "cj"), (F.min, "com_lon"), (F.max, "com_lon"), (F.min, "com_lat"), (F.max, "com_lat"))))


def class_lookup(tiles: DataFrame, parameters: DataFrame, coarse: list[str]) -> DataFrame:
    """Parameter by class; a class without one takes the most usual valid class of the coarse cell, the smallest of equals."""
    valid = tiles.join(parameters.select("class"), "class", "left_semi")
    counts = valid.groupBy(*coarse, "class").agg(F.count("*").alias("n"))
    usual = counts.groupBy(*coarse).agg(F.max_by("class", F.struct("n", -F.col("class"))).alias("usual"))
    known = parameters.select("class", F.lit(True).alias("__known"))
    out = tiles.join(known, "class", "left").join(usual, coarse, "left")
    out = out.withColumn("used", F.when(F.col("__known"), F.col("class")).otherwise(F.col("usual")))
    return out.join(parameters.withColumnRenamed("class", "used"), "used", "left").drop("__known", "usual")


def packed(obs: DataFrame, here: list[str], name: str) -> DataFrame:
    """(here, `name`: obs_ids of the rows that are equal in `here`), about PACK a row at most, as the rows of a place are dealt by their ids.

    Lists are sorted, so that a task which runs again makes the same ones; a null id stays in its list.
    """
    places = obs.groupBy(*here).agg(F.ceil(F.count("*") / PACK).alias("__packs")).select(*(F.col(c).alias(f"{c}_at") for c in here), "__packs")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_at")) for c in here]
    numbered = obs.join(places, same).withColumn("__pack", F.pmod(F.xxhash64("obs_id"), "__packs"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("obs_id"))), lambda s: s["obs_id"])
    return numbered.groupBy(*here, "__pack").agg(ids.alias(name)).drop("__pack")


def pair_covariance(obs: DataFrame, group: list[str], xc: float, yc: float, reach: float = 3.0, finish: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Covariances of observation errors of one species within `reach` correlation lengths; the variance on the diagonal.

    The search and the formula run once for each pair of places (and variances), and so does `finish`, what is to be done to each
    covariance; the pairs of their observations are written out from packs of ids, so that the rows of the result cost a copy each.
    Packs are written once and read by both sides.
    """
    here = [*group, "species", "lon", "lat", "obsvar"]
    a = kept(packed(obs.dropna(subset=here[:-1]), here, "__ids"), "packs").withColumn("__own", finish(F.col("obsvar")))
    b = a.select(*group, "species", *(F.col(c).alias(f"{c}_b") for c in ("lon", "lat", "obsvar", "__ids")))
    dx, dy = (F.col("lon") - F.col("lon_b")) / xc, (F.col("lat") - F.col("lat_b")) / yc
    r = F.sqrt(F.col("obsvar") * F.col("obsvar_b")) * F.exp(-0.5 * (dx * dx + dy * dy))
    near = (F.abs(dx) <= reach) & (F.abs(dy) <= reach)
    blocks = partial(join_in_blocks, sizes=(F.size("__ids"), F.size("__ids_b")), n=-(-obs.count() // PAIR_ROWS))
    met = meet(a, b, reach * xc, reach * yc, on=(*group, "species"), others_names=("lon_b", "lat_b"), join=blocks).where(near)
    rows = met.withColumn("__r", r).withColumn("__r", finish(F.col("__r"))).withColumn("obs_id", F.explode("__ids")).withColumn("obs_id_b", F.explode("__ids_b"))
    return rows.select(*group, "species", "obs_id", "obs_id_b", F.when(F.col("obs_id") == F.col("obs_id_b"), F.col("__own")).otherwise(F.col("__r")).alias("cov"))


def swath_longitudes(start: Column, end: Column, local_hour: float) -> tuple[Column, Column]:
    """Longitudes at which it is the local hour at the end and at the start of a UTC window; the first exceeds the second where
    the swath crosses the dateline. Hours count from the midnight before the window's middle, below 0 and over 24 too: a place on
    the edge is in or out by the last bit, which another turn of the clock would change."""
    day = F.to_date(F.timestamp_micros(F.floor((F.unix_micros(start) + F.unix_micros(end)) / 2).cast("long")))
    hours = lambda t: F.datediff(F.to_date(t), day) * 24 + F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600

    def at(t: Column) -> Column:
        x = (F.lit(local_hour) - hours(t)) * 15 + 180
        return x - 360 * F.floor(x / 360) - 180

    return at(end), at(start)


def in_swath(lon: Column, low: Column, high: Column) -> Column:
    """Both longitudes are named once, in a struct, so that their long expressions aren't copied into each comparison."""
    inside = lambda s: F.when(s["low"] <= s["high"], lon.between(s["low"], s["high"])).otherwise((lon >= s["low"]) | (lon <= s["high"]))
    return F.exists(F.array(F.struct(low.alias("low"), high.alias("high"))), inside)


def static_field_mean(df: DataFrame, tiles: DataFrame, value: str, reach: int) -> DataFrame:
    """Long-term mean of a parameter per tile; tiles without one take their neighbourhood's."""
    mean = df.groupBy("tile").agg(F.avg(value).alias(value))
    return fill_gaps(tiles.join(mean, "tile", "left"), value, reach)
