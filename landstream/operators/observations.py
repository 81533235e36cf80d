"""Observation preparation: quality control, super-observations, collection, and suppression across species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(t: Column, low: Column, high: Column, closed: str = "right") -> Column:
    return (t > low) & (t <= high) if closed == "right" else (t >= low) & (t < high)


def qc_ascat(df: DataFrame) -> DataFrame:
    """Columns sm, proc_flag, corr_flag, land_frac, topo, wetland, and masked (0: usable). sm comes out as a fraction."""
    good = (
        F.col("sm").between(0, 100) & (F.col("proc_flag") == 0) & F.col("corr_flag").isin(0, 4) & F.col("land_frac").between(0.9, 1.0)
        & (F.col("topo") <= 10) & (F.col("wetland") <= 10) & (F.col("masked") == 0)
    )
    return df.where(good).withColumn("sm", F.col("sm") / 100)


def qc_cygnss(df: DataFrame, flags: list[str], good: int = 255, slot_hours: float = 6.0, tolerance: float = 1e-3) -> DataFrame:
    """All static flags are good, and the time of day is a slot's, within a tolerance in hours."""
    keep = F.abs(F.col("hour") / slot_hours - F.round(F.col("hour") / slot_hours)) * slot_hours <= tolerance
    for c in flags:
        keep = keep & (F.col(c) == good)
    return df.where(keep)


#: Lowest and highest value, largest spread and least count of each product.
SMOS_LIMITS = {"sm": (0.0, 0.6, 0.2, 2), "tb_regular": (100.0, 320.0, 7.0, 2), "tb_fitted": (100.0, 320.0, 5.0, 20)}


def qc_smos(df: DataFrame, product: str) -> DataFrame:
    low, high, spread, count = SMOS_LIMITS[product]
    keep = (F.col("value") > low) & (F.col("value") < high) & (F.col("std") < spread) & (F.col("n") >= count)
    if product == "sm":
        keep = keep & (F.col("dqx") > 0) & (F.col("dqx") < 0.2)
    return df.where(keep)


def qc_look_pair(df: DataFrame, low: float = 100.0, high: float = 320.0) -> DataFrame:
    """Fore and aft looks: both good are averaged, value and time; one good look is used; with none the row goes."""
    good = {s: (F.col(f"flag_{s}").bitwiseAND(1) == 0) & (F.col(f"tb_{s}") > low) & (F.col(f"tb_{s}") < high) for s in ("fore", "aft")}
    tb = {s: F.when(g, F.col(f"tb_{s}")) for s, g in good.items()}
    ts = {s: F.when(g, F.unix_micros(f"ts_{s}")) for s, g in good.items()}
    both = lambda v: F.coalesce((v["fore"] + v["aft"]) / 2, v["fore"], v["aft"])
    out = df.withColumns({"tb": both(tb), "ts": F.timestamp_micros(F.floor(both(ts)).cast("long"))})
    return out.where(F.col("tb").isNotNull())


def thin_grid(df: DataFrame, spacing: int = 3, row: str = "row", col: str = "col") -> DataFrame:
    return df.where((F.pmod(F.col(row), F.lit(spacing)) == 1) & (F.pmod(F.col(col), F.lit(spacing)) == 1))


def reject_file_if_spread(df: DataFrame, file: str = "file", limit: float = 20.0) -> DataFrame:
    """All rows of a file go if the sample variance of fore minus aft exceeds limit squared. Only sums are shuffled."""
    spread = df.groupBy(file).agg(F.var_samp(F.col("tb_fore") - F.col("tb_aft")).alias("__spread")).where(F.col("__spread") > limit * limit)
    return df.join(spread.select(file), file, "left_anti")


def qc_snow_cover(df: DataFrame) -> DataFrame:
    return df.where((F.col("cover") <= 100) & (F.col("clear_index") > 20) & (F.col("spatial_qa") <= 2))


def qc_freeze_thaw(df: DataFrame) -> DataFrame:
    """Strictly between 0 and 1, in the same cell as the assigned tile."""
    return df.where((F.col("value") > 0) & (F.col("value") < 1) & (F.col("i") == F.col("tile_i")) & (F.col("j") == F.col("tile_j")))


def qc_skin_temperature(df: DataFrame) -> DataFrame:
    """200 to 370 K; the error is smaller by night, hours 3 to 14 of the analysis clock."""
    error = F.when(F.hour("analysis_time").between(3, 14), 1.3).otherwise(2.1)
    return df.where((F.col("value") > 200) & (F.col("value") < 370)).withColumn("errstd", error)


def qc_amsre(df: DataFrame) -> DataFrame:
    return df.where((F.col("value") > 0) & F.col("surface_flag").isin(128, 256))


def qc_retrieval(df: DataFrame, fill: float = -9999.0) -> DataFrame:
    """Fill values become null; retrieval and surface flags must be 0 in their lowest bits, and the interference bit unset."""
    from ..functions.numeric import null_if_nodata

    keep = (F.getbit("retrieval_flag", F.lit(0)) == 0) & (F.getbit("surface_flag", F.lit(0)) == 0) & (F.getbit("retrieval_flag", F.lit(3)) == 0)
    return df.where(keep).withColumn("value", null_if_nodata(F.col("value"), fill))


#: Fixed value: water freezes, K.
FREEZING = 273.16


def qc_model(pred: Column, kind: str, precip: Column, swe: Column, tsurf: Column, tsoil: Column) -> Column:
    """A member's prediction, null where the model's own state makes it useless. precip in kg m-2 s-1."""
    bad = {
        "sfmc": (precip > 10 / 86400) | (swe > 1e-4) | (tsurf < FREEZING + 0.2),
        "tsurf": (precip > 10 / 86400) | (swe > 1e-4),
        "tb": precip > 50 / 86400,
        "asnow": tsoil > FREEZING + 10,
    }[kind]
    return F.when(~bad, pred)


def gate_innovation(df: DataFrame, factor: float = 25.0) -> DataFrame:
    """(obs - fcst)^2 beyond factor * 2 * obsvar goes, unless the bias estimate still spins up (column bias_ok false)."""
    off = (F.col("obs") - F.col("fcst")) ** 2 > factor * 2 * F.col("obsvar")
    return df.where(~(off & F.col("bias_ok")))


def gate_rfi_water(df: DataFrame, warmer: float = 5.0, water: float = 0.05) -> DataFrame:
    """Null observations that are warmer than the soil, or whose footprint holds water."""
    bad = (F.col("obs") - F.col("tsoil") > warmer) | (1 - F.col("land_frac") > water)
    return df.withColumn("obs", F.when(~bad, F.col("obs")))


def keep_if_all_members(df: DataFrame, keys: list[str], pred: str = "pred") -> DataFrame:
    """(keys) of observations that every member predicts."""
    return df.groupBy(*keys).agg(F.count(pred).alias("n"), F.count("*").alias("m")).where("n = m").select(*keys)


def select_species(df: DataFrame, species: DataFrame, names: list[str] | None, restrict: bool = True) -> DataFrame:
    """Rows of the assimilated species with one of the names. Without restrict, no names select every species."""
    wanted = species.where("assim")
    if names or restrict:
        wanted = wanted.where(F.col("varname").isin(*(names or [])))
    return df.join(wanted.select("species"), "species", "left_semi")


def select_obs(df: DataFrame, tiles: DataFrame | None = None, species: list[int] | None = None, assim_only: bool = False) -> DataFrame:
    if tiles is not None:
        df = df.join(tiles.select("tile").distinct(), "tile", "left_semi")
    if species:
        df = df.where(F.col("species").isin(*species))
    return df.where("assim") if assim_only else df


def null_group(df: DataFrame, columns: list[str]) -> DataFrame:
    """If one column of a group is null, all are."""
    from ..functions.numeric import all_valid

    whole = all_valid(columns)
    return df.withColumns({c: F.when(whole, F.col(c)) for c in columns})


def both_groups(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows in which two alternative groups are both present; there should be none."""
    return df.where(F.col(first).isNotNull() & F.col(second).isNotNull())


def combine_masks(subsurface: Column, wetland: Column, vegetation: Column, mode: int = 4) -> Column:
    """0 usable. Mode 1: subsurface or wetland; 2: subsurface alone; 3: wetland alone; 4: any of the three.

    Where another mask is set the result is 1; elsewhere the subsurface (or only) mask's own value stays.
    """
    if mode == 3:
        return wetland
    others = {1: [wetland], 2: [], 4: [wetland, vegetation]}[mode]
    out = subsurface
    for mask in others:
        out = F.when(mask != 0, F.lit(1)).otherwise(out)
    return out


def super_obs(df: DataFrame, keys: list[str], means: list[str]) -> DataFrame:
    """Means of all observations of a key (window, tile, species), and their number."""
    return df.where(F.col("tile").isNotNull()).groupBy(*keys).agg(*(F.avg(c).alias(c) for c in means), F.count("*").alias("n"))


def collect_obs(parts: list[DataFrame], species: DataFrame) -> DataFrame:
    """All species in one table: variance from a positive std, else from the catalogue; assim if catalogue and row say so."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.join(species.select("species", "errstd", F.col("assim").alias("__assim")), "species")
    obsvar = F.when(F.col("std") > 0, F.col("std") ** 2).otherwise(F.col("errstd") ** 2)
    return out.withColumns({"obsvar": obsvar, "assim": F.col("assim") & F.col("__assim")}).drop("__assim", "errstd")


def suppress_species(df: DataFrame, pairs: list[tuple[int, int]], active: list[int]) -> DataFrame:
    """Observations of species a lose their assim flag where species b has one in the same cell; both must be assimilated."""
    pairs = [(a, b) for a, b in pairs if a in active and b in active]
    if not pairs:
        return df
    table = df.sparkSession.createDataFrame(pairs, "species int, __other int")
    held = df.groupBy("ci", "cj", F.col("species").alias("__other")).agg(F.lit(1).alias("__has")).join(table, "__other")
    held = held.groupBy("ci", "cj", "species").agg(F.max("__has").alias("__has"))
    out = df.join(held, ["ci", "cj", "species"], "left")
    return out.withColumn("assim", F.col("assim") & F.col("__has").isNull()).drop("__has")


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in a total order. An aggregate, so that it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col("__best")[c].alias(c) for c in [*order, *rest]))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that have more than one row; a guard wants none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def snow_obs_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("tile").agg(F.avg("obs").alias("obs"), F.count("obs").alias("n"))


def first_index(df: DataFrame) -> DataFrame:
    """Each row with the number at which its species begins in the order by species, then tile. Only counts are ordered."""
    counts = df.groupBy("species").agg(F.count("*").alias("n"))
    begins = counts.withColumn("first_row", F.coalesce(F.sum("n").over(Window.orderBy("species").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    return df.join(begins.select("species", "first_row"), "species")
