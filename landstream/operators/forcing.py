"""Forcing preparation: repair, gap filling, bracketing and interpolation in time and space, time averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import LatLonGrid
from .ranges import carried, in_ranges, within

#: Stefan-Boltzmann constant, solar constant, least wind.
SIGMA, SOLAR, LEAST_WIND = 5.67e-8, 1360.0, 1e-4


def repair(df: DataFrame, qsat: str = "qsat") -> DataFrame:
    """Values brought into their physical ranges, in the order in which they depend on each other."""
    c = F.col
    out = df.withColumns({"rainf": F.greatest("rainf", F.lit(0.0)), "snowf": F.greatest("snowf", F.lit(0.0)), "wind": F.greatest("wind", F.lit(LEAST_WIND)), "qair": F.least(F.greatest("qair", F.lit(0.0)), c(qsat))})
    out = out.withColumns({
        "rainf_c": F.least(F.greatest("rainf_c", F.lit(0.0)), c("rainf")),
        "lwdown": F.least(F.greatest("lwdown", 0.5 * SIGMA * c("tair") ** 4), SIGMA * c("tair") ** 4), "swdown": F.least(F.greatest("swdown", F.lit(0.0)), F.lit(SOLAR)),
    })
    out = out.withColumn("pardffs", F.least(F.greatest("pardffs", F.lit(0.0)), 0.8 * c("swdown")))
    return out.withColumn("pardrct", F.least(F.greatest("pardrct", F.lit(0.0)), c("swdown") - c("pardffs")))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows with impossible temperatures or pressures."""
    return df.where(~F.col("tair").between(180, 340) | (F.col("psurf") > 115000))


def violations(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Number of repaired values per field."""
    a = before.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields)).join(after, keys)
    counts = a.select(*(F.sum((~F.col(f"__{f}").eqNullSafe(F.col(f))).cast("long")).alias(f) for f in fields))
    return counts.unpivot([], fields, "rule", "n")


def backfill_par(df: DataFrame) -> DataFrame:
    quarter = F.when(F.col("pardrct").isNull(), 0.25 * F.col("swdown"))
    return df.withColumns({"pardrct": F.coalesce("pardrct", quarter), "pardffs": F.coalesce(quarter, "pardffs")})


def fill_from_next_tile(df: DataFrame, keys: list[str], value: str, most: float = 0.5) -> DataFrame:
    """Null values take the next tile's if that is within `most` degrees; see unfilled_tiles() for those that stay null.

    Tiles stand in ranges (see ranges.py): the last of a range takes the first of the next one.
    """
    ranged = in_ranges(df, keys, ["tile"])
    place = F.struct("lon", "lat", value)
    ranged = carried(ranged, keys, ["tile"], after=place).withColumn("__next", F.coalesce(F.lead(place).over(within(keys, ["tile"])), "__after"))
    d2 = (F.col("__next.lon") - F.col("lon")) ** 2 + (F.col("__next.lat") - F.col("lat")) ** 2
    filled = F.coalesce(F.col(value), F.when(d2 <= most * most, F.col(f"__next.{value}")))
    return ranged.select(*(filled.alias(c) if c == value else F.col(c) for c in df.columns))


def unfilled_tiles(filled: DataFrame, value: str) -> DataFrame:
    """Tiles without a value after filling: what a list of tiles to exclude takes, and a strict job refuses to go on with."""
    return filled.where(F.col(value).isNull()).select("tile").distinct()


def bracket_regular(times: DataFrame, forcing: DataFrame, keys: list[str], step: int, values: list[str]) -> DataFrame:
    """Each time with the records at the start and end of its step, by two equi-joins on the step's number."""
    number = lambda t: F.floor(F.unix_seconds(t) / step)
    placed = times.withColumn("__k", number(F.col("time")))
    at = forcing.select(*keys, number(F.col("time")).alias("__k"), *(F.col(v) for v in values))
    prv = at.select(*keys, "__k", *(F.col(v).alias(f"{v}_prv") for v in values))
    nxt = at.select(*keys, (F.col("__k") - 1).alias("__k"), *(F.col(v).alias(f"{v}_nxt") for v in values))
    out = placed.join(prv, [*keys, "__k"], "left").join(nxt, [*keys, "__k"], "left")
    return out.withColumn("since", F.unix_seconds("time") - F.col("__k") * step).drop("__k")


def bracket_asof(times: DataFrame, forcing: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each time with the last record at or before it and the first after it, by one union and windows: no pairs.

    Rows stand in ranges of (keys, time), so a key may have any share of all rows (see ranges.py). Of records at one time the
    one with the largest value counts, null as the least.
    """
    both = forcing.select(*keys, "time", F.col(value).alias("__v"), F.lit(0).alias("__q")).unionByName(times.select(*keys, "time", F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__q")))
    order = ["time", "__q", "__v"]
    ranged = in_ranges(both, keys, ["time", "__q"])
    record = F.when(F.col("__q") == 0, F.struct("time", "__v"))
    w = within(keys, order)
    found = carried(ranged, keys, order, record, record).withColumns({
        "prv": F.coalesce(F.last(record, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__before"),
        "nxt": F.coalesce(F.first(record, True).over(w.rowsBetween(1, Window.unboundedFollowing)), "__after"),
    }).where("__q = 1")
    return found.select(
        *keys, "time", F.col("prv.time").alias("prv_time"), F.col("prv.__v").alias(f"{value}_prv"), F.col("nxt.time").alias("nxt_time"), F.col("nxt.__v").alias(f"{value}_nxt")
    )


def step_weight(since: Column, step: int, mode: str = "step") -> Column:
    """Weight of the later record: 0 before the middle of the step, 0.5 there, 1 after it; or truly linear."""
    if mode == "linear":
        return since / step
    return F.when(since == step // 2, 0.5).otherwise(F.floor((since - 1) / (step // 2)).cast("double"))


#: Mean sun angles below this count as none, and the least angle of the cap on radiation.
NO_SUN, LEAST_SUN = 1e-6, 0.01


def interp_time(
    df: DataFrame, step: int, states: list[str], fluxes: list[str], wind: str = "wind", radiation: tuple[str, ...] = (), mode: str = "step", capped: str = "swdown",
) -> DataFrame:
    """States between two records, fluxes of the earlier, wind of the earlier if there is no later one, radiation by sun angle.

    Columns x_prv and x_nxt, since (seconds), zth and zenav (cosine of the sun's angle now and its mean over the step). By day
    radiation scales with zth / zenav, by night it is the earlier record's, where only now is dark it is 0; the column `capped`
    stays below the solar constant times the angle; without an earlier record it is null. A sun that shines now but not on the mean is an error.
    """
    w = step_weight(F.col("since"), step, mode)
    mixed = lambda v: (1 - w) * F.col(f"{v}_prv") + w * F.col(f"{v}_nxt")
    values = {v: mixed(v) for v in states} | {v: F.col(f"{v}_prv") for v in fluxes}
    if f"{wind}_prv" in df.columns:
        values[wind] = F.when(F.col(f"{wind}_nxt").isNotNull(), mixed(wind)).otherwise(F.col(f"{wind}_prv"))
    for v in radiation:
        none = F.abs("zenav") <= NO_SUN
        zth, zenav = F.when(none, 0.0).otherwise(F.col("zth")), F.when(none, 0.0).otherwise(F.col("zenav"))
        ratio = F.when(zenav > 0, zth / zenav).otherwise(F.raise_error(F.lit("the sun shines now but not on the mean")).cast("double"))
        night = F.when(zenav <= 0, F.greatest(F.col(f"{v}_prv"), F.lit(0.0))).otherwise(0.0)
        shone = F.when(zth > 0, F.col(f"{v}_prv") * ratio).otherwise(night)
        if v == capped:
            shone = F.least(shone, SOLAR * F.greatest(F.col("zth"), F.lit(LEAST_SUN)))
        values[v] = F.when(F.col(f"{v}_prv").isNotNull(), shone)
    rest = [c for c in df.columns if not c.endswith(("_prv", "_nxt")) and c not in values]
    return df.select(*rest, *(x.alias(v) for v, x in values.items()))


def interp_bilinear(points: DataFrame, cells: DataFrame, grid: LatLonGrid, value: str, key: str) -> DataFrame:
    """Four corners by one join on the cell; null corners count as the mean of the others; without any the result is null.

    cells: ci, cj, value at cell centres.
    """
    fx, fy = (F.col("lon") - grid.ll_lon) / grid.dlon + 0.5, (F.col("lat") - grid.ll_lat) / grid.dlat + 0.5
    i0, j0 = F.floor(fx), F.floor(fy)
    corners = F.array(*(F.struct((i0 + a).cast("int").alias("ci"), (j0 + b).cast("int").alias("cj"), ((fx - i0 if a else 1 - fx + i0) * (fy - j0 if b else 1 - fy + j0)).alias("w")) for a in (0, 1) for b in (0, 1)))
    spread = points.select(key, F.explode(corners).alias("c")).select(key, "c.*")
    found = spread.join(cells.select("ci", "cj", value), ["ci", "cj"], "left")
    w, v = F.col("w"), F.col(value)
    sums = found.groupBy(key).agg(F.sum(w * v).alias("wv"), F.sum(F.when(v.isNull(), w)).alias("gap"), F.avg(v).alias("mean"))
    return points.join(sums, key).select(*points.columns, (F.col("wv") + F.coalesce("gap", F.lit(0.0)) * F.col("mean")).alias(value))


def interp_nearest(points: DataFrame, cells: DataFrame, grid: LatLonGrid, value: str) -> DataFrame:
    i, j = grid.cell(F.col("lon"), F.col("lat"))
    return points.withColumns({"ci": i, "cj": j}).join(cells.select("ci", "cj", value), ["ci", "cj"], "left").drop("ci", "cj")


def override_precip(native: DataFrame, corrected: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The corrected source's values where it has them."""
    better = corrected.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields))
    return native.join(better, keys, "left").select(*native.columns[:0], *(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in native.columns))


def time_average(df: DataFrame, keys: list[str], seconds: int, values: list[str]) -> DataFrame:
    """Means over windows of the declared frequency."""
    w = F.window("time", f"{seconds} seconds")
    return df.groupBy(*keys, w.alias("w")).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), *values, "n")


def instantaneous(df: DataFrame, seconds: int) -> DataFrame:
    return df.where(F.unix_seconds("time") % seconds == 0)


def scatter_compressed(values: DataFrame, index: DataFrame) -> DataFrame:
    """Land-only records (position, ...) to cells by an index map (position, ci, cj)."""
    return values.join(index, "position").drop("position")
