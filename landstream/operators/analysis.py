"""Local ensemble updates: each tile's state is corrected by the observations around it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.grid import curve
from ..sources.paths import kept
from .ranges import RANGE, in_ranges, within
from .spatial import local_obs


@dataclass(frozen=True)
class UpdateMode:
    """What a mode observes and updates. Own-tile modes have no box; `applied` is false where increments are only computed."""

    variables: tuple[str, ...]
    fields: tuple[str, ...]
    local: bool
    applied: bool = True
    with_tb: tuple[str, ...] = ()  # also updated where an observation of Tb was found
    peat: tuple[str, ...] = ()  # also updated, or only updated, where porosity is that of peat


_SOIL, _SKIN = ("srfexc", "rzexc", "catdef"), ("tc1", "tc2", "tc4")
#: Update modes by number. Mode 9 is freeze_thaw_increments(); mode 11 doesn't exist.
MODES = {
    1: UpdateMode(("sfmc", "sfds"), _SOIL, False),
    2: UpdateMode(("sfmc", "sfds"), _SOIL, True),
    3: UpdateMode(("tskin",), _SKIN, False, applied=False),
    4: UpdateMode(("tskin",), (*_SKIN, "ght1"), False),
    5: UpdateMode(("tskin",), (*_SKIN, "ght1"), False, applied=False),
    6: UpdateMode(("tb",), (*_SOIL, *_SKIN, "ght1"), False),
    7: UpdateMode(("tskin",), (*_SKIN, "ght1"), True),
    8: UpdateMode(("tb",), (*_SOIL, *_SKIN, "ght1"), True),
    10: UpdateMode(("tb",), ("srfexc", "rzexc", *_SKIN, "ght1"), True, peat=("catdef",)),
    12: UpdateMode(("tb", "sfmc", "sfds"), ("srfexc", "rzexc"), True, with_tb=(*_SKIN, "ght1"), peat=("catdef",)),
    13: UpdateMode(("tb", "sfmc", "sfds"), ("srfexc", "rzexc"), True, with_tb=(*_SKIN, "ght1"), peat=("catdef",)),
}


#: Pairs of a tile and an observation that are solved in one group.
BLOCK = 2048


def _taper(dx: np.ndarray, dy: np.ndarray, xc: float, yc: float) -> np.ndarray:
    """numeric.gaspari_cohn for arrays."""
    d = 2 * np.hypot(dx / xc, dy / yc)
    near = np.polyval([-0.25, 0.5, 0.625, -5 / 3, 0, 1], d)
    safe = np.maximum(d, 1e-9)
    far = np.polyval([1 / 12, -0.5, 0.625, 5 / 3, -5, 4], safe) - 2 / (3 * safe)
    out = np.where(d <= 1, near, np.where(d < 2, far, 0.0))
    return np.where((np.abs(dx) > xc) | (np.abs(dy) > yc), 0.0, np.where(d <= 1e-3, 1.0, out))


def _gain(dy: np.ndarray, d: np.ndarray, r: np.ndarray, txy: np.ndarray | None, tyy: np.ndarray | None, exact: bool = True) -> np.ndarray:
    """(members, members): deviations of a state times this are its increments. Otherwise than exact, the solution of least norm."""
    n = dy.shape[1]
    hph = dy @ dy.T / (n - 1)
    a = (hph * tyy if tyy is not None else hph) + r
    if exact:
        z = np.linalg.solve(a, d)
    else:
        w, u = np.linalg.eigh((a + a.T) / 2)
        some = np.abs(w) > len(w) * np.finfo(float).eps * np.abs(w).max()
        z = u[:, some] @ ((u[:, some].T @ d) / w[some][:, None])
    return (dy.T if txy is None else dy.T * txy) @ z / (n - 1)


def solve_tile(x: np.ndarray, y: np.ndarray, innovations: np.ndarray, r: np.ndarray, taper_xy: np.ndarray | None = None, taper_yy: np.ndarray | None = None, inflation: float = 1.0) -> np.ndarray:
    """Increments of a state (fields by members) from predictions y (observations by members) and perturbed innovations.

    With inflation, deviations of state and predictions are stretched before the gain, the innovations are corrected for the
    stretched deviations of the predictions, and the increments refer to the state as it was before.
    """
    dx, dy = (x - x.mean(1, keepdims=True)) * inflation, (y - y.mean(1, keepdims=True)) * inflation
    return dx @ _gain(dy, innovations - (1 - inflation) * dy, r, taper_xy, taper_yy) + (1 - 1 / inflation) * dx


def place_gain(
    y: np.ndarray, innovations: np.ndarray, v: np.ndarray, kind: np.ndarray, at: np.ndarray, centre: np.ndarray, reach: tuple[float, float],
    tapered: bool = True, corr: tuple[float, float] | None = None, inflation: float = 1.0,
) -> np.ndarray:
    """_gain() of all observations around a place; at: their longitudes and latitudes.

    Tapers and correlations are those of sites, so the observations of a site are first brought together, with the same result.
    Independent errors: sums of products of the members over the site, by the identity of Woodbury. Correlated ones: more
    observations of a site than its members and species span are turned into as many as they span; then the system is singular (equal
    species at one site are wholly correlated), and the solution is the one of least squares and least norm.
    """
    n, m = y.shape
    dy = (y - y.mean(1, keepdims=True)) * inflation
    d = innovations - (1 - inflation) * dy
    if tapered or corr:
        sites, of = np.unique(at, axis=0, return_inverse=True)
        of = of.ravel()
    else:
        sites, of = centre[None, :], np.zeros(n, int)
    between = sites[:, None, :] - sites[None, :, :]
    t = _taper(*(sites - centre).T, *reach) if tapered else np.ones(len(sites))
    tt = _taper(between[..., 0], between[..., 1], *reach) if tapered else np.ones((len(sites), len(sites)))
    order = np.argsort(of, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    if not corr:
        if len(sites) * m >= n or not (v > 0).all():
            return _gain(dy, d, np.diag(v), t[of], tt[np.ix_(of, of)])
        w = np.stack([(dy[g] / v[g, None]).T @ dy[g] for g in groups])
        b = np.stack([(dy[g] / v[g, None]).T @ d[g] for g in groups])
        size = len(sites) * m
        kw = np.einsum("ab,bij->aibj", tt, w).reshape(size, size) / (m - 1)
        kb = np.einsum("ab,bij->aij", tt, b).reshape(size, m) / (m - 1)
        q = np.linalg.solve(np.eye(size) + kw, kb).reshape(-1, m, m)
        return np.einsum("s,sij->ij", t, b - w @ q) / (m - 1)
    codes = pd.factorize(kind)[0]
    codes = np.unique(np.where(codes < 0, n + np.arange(n), codes), return_inverse=True)[1].ravel()
    e = np.zeros((n, codes.max() + 1))
    e[np.arange(n), codes] = np.sqrt(v)
    parts, exact = [], True
    for s, g in enumerate(groups):
        part = dy[g], e[g], d[g]
        if len(g) > 1:
            u, sv, _ = np.linalg.svd(np.hstack([dy[g], e[g]]), full_matrices=False)
            rank = int((sv > 1e-10 * sv[0]).sum())
            if rank < len(g):
                part, exact = tuple(u[:, :rank].T @ x for x in part), False
        parts.append((*part, np.full(len(part[0]), s)))
    c = np.exp(-0.5 * ((between[..., 0] / corr[0]) ** 2 + (between[..., 1] / corr[1]) ** 2))
    if exact:
        r = np.where((codes[:, None] == codes[None, :]) & ~np.eye(n, dtype=bool), np.sqrt(np.outer(v, v)) * c[np.ix_(of, of)], np.diag(v))
        return _gain(dy, d, r, t[of], tt[np.ix_(of, of)])
    dy, e, d, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _gain(dy, d, (e @ e.T) * c[np.ix_(of, of)], t[of], tt[np.ix_(of, of)], False)


def blocks(tiles: DataFrame, met: DataFrame, size: int = BLOCK) -> DataFrame:
    """(tile, com_lon, com_lat, n, block) of tiles that meet observations. met: tile, obs_id.

    Tiles stand along a curve that keeps neighbours together, and prefix sums of their numbers of observations cut it into blocks of
    about `size` pairs: so blocks take equal work, and an observation goes to the few blocks around it. The sums are of ranges of the
    curve first, and then within each range.
    """
    weighted = tiles.select("tile", "com_lon", "com_lat").join(met.groupBy("tile").agg(F.count("*").alias("n")), "tile")
    ranged = in_ranges(weighted.withColumn("__curve", curve(F.col("com_lon"), F.col("com_lat"))), [], ["__curve", "tile"])
    totals = ranged.groupBy(RANGE).agg(F.sum("n").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    before = F.sum("n").over(within([], ["__curve", "tile"])) - F.col("n")
    placed = ranged.join(totals.select(RANGE, ahead.alias("__ahead")), RANGE).withColumn("__before", before)
    return placed.select("tile", "com_lon", "com_lat", "n", F.floor((F.col("__ahead") + F.col("__before")) / F.lit(size)).alias("block"))


def enkf_increments(
    tiles: DataFrame, state: DataFrame, obs: DataFrame, pred: DataFrame, fields: list[str], xc: float, yc: float,
    tapered: bool = True, corr: tuple[float, float] | None = None, inflation: float = 1.0, own: bool = False,
) -> DataFrame:
    """(tile, ens, increments of fields) for tiles with observations in their box; own: with observations of the tile, by obs' column tile.

    state: tile, ens, fields; obs: obs_id, lon, lat, species, obs, obsvar; pred: obs_id, ens, pred, eps (observation noise).
    Tiles at one place see the same observations, so each place is solved once (place_gain()), and its tiles' states are multiplied.
    Places are solved in blocks of neighbours with equal work (see blocks()): only pairs of ids meet in the join by cells, then each
    block takes each of its observations once, with its members as arrays. corr: correlation lengths of observation errors within a species.
    """
    members = pred.join(obs.select("obs_id"), "obs_id", "left_semi").groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("ens", "pred", "eps"))).alias("m"))
    members = members.select("obs_id", F.col("m.pred").alias("pred"), F.col("m.eps").alias("eps"))
    spot = ["tile"] if own else ["com_lon", "com_lat"]
    places = tiles if own else tiles.groupBy(*spot).agg(F.min("tile").alias("tile"))  # a place goes by its least tile
    met = obs.select("tile", "obs_id").join(places.select("tile"), "tile", "left_semi") if own else local_obs(places, obs.select("obs_id", "lon", "lat"), xc, yc).select("tile", "obs_id")
    met = kept(met, "pairs")
    dealt = kept(blocks(places, met), "blocks")
    near = met.join(dealt.select("tile", F.col("block").alias("at")), "tile").select("at", "obs_id").distinct()
    near = near.join(obs.select("obs_id", "lon", "lat", "species", "obs", "obsvar", *([F.col("tile").alias("owner")] if own else [])).join(members, "obs_id"), "obs_id")
    placed = state.select("tile", "ens", *fields).join(tiles.select("tile", "com_lon", "com_lat"), "tile").join(dealt.select(*spot, "block"), spot)

    def solve(key: tuple, s: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("tile", "ens", *fields)})]
        if len(s) and len(o):
            s, o = s.sort_values([*spot, "tile", "ens"]), o.sort_values("obs_id")
            y_all, eps_all = np.stack(o["pred"]).astype(float), np.stack(o["eps"]).astype(float)
            lon_all, lat_all, v_all, obs_all = (o[c].to_numpy(float) for c in ("lon", "lat", "obsvar", "obs"))
            kind_all, mine = o["species"].to_numpy(), o.groupby("owner").indices if own else {}
            x_all, tile = s[fields].to_numpy(float), s["tile"].to_numpy()
            where = s[["com_lon", "com_lat"]].to_numpy(float)
            place = s.groupby(spot, sort=False).ngroup().to_numpy()
            d_all, some = np.zeros_like(x_all), np.zeros(len(s), bool)
            edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            for a, b in zip(edge, np.append(edge[1:], len(tile)), strict=True):
                cx, cy = where[a]
                at = mine.get(tile[a], []) if own else np.flatnonzero((np.abs(lon_all - cx) <= xc) & (np.abs(lat_all - cy) <= yc))
                if not len(at):
                    continue
                y = y_all[at]
                gain = place_gain(y, obs_all[at][:, None] + eps_all[at] - y, v_all[at], kind_all[at], np.column_stack([lon_all[at], lat_all[at]]), where[a], (xc, yc), tapered, corr, inflation)
                starts = a + np.flatnonzero(np.append(True, tile[a + 1 : b] != tile[a : b - 1]))
                for i, j in zip(starts, np.append(starts[1:], b), strict=True):
                    x = x_all[i:j].T
                    dx = (x - x.mean(1, keepdims=True)) * inflation
                    d_all[i:j] = (dx @ gain + (1 - 1 / inflation) * dx).T
                some[a:b] = True
            out.append(pd.DataFrame({"tile": tile, "ens": s["ens"].to_numpy(), **dict(zip(fields, d_all.T, strict=True))})[some])
        return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    schema = ", ".join(["tile long", "ens int", *(f"{f} double" for f in fields)])
    return placed.groupBy("block").cogroup(near.groupBy("at")).applyInPandas(solve, schema)


def enkf_single_obs(state: DataFrame, obs: DataFrame, pred: DataFrame, field: str) -> DataFrame:
    """The update by one observation in the tile itself, by aggregates only. obs: tile, obs, obsvar; pred: tile, ens, pred, eps.

    Without any variance there is no increment (null).
    """
    joined = state.join(pred, ["tile", "ens"])
    gain = joined.groupBy("tile").agg(F.covar_samp(field, "pred").alias("c"), F.var_samp("pred").alias("v"))
    out = joined.join(gain, "tile").join(obs, "tile")
    return out.select("tile", "ens", (ratio(F.col("c"), F.col("v") + F.col("obsvar")) * (F.col("obs") + F.col("eps") - F.col("pred"))).alias("increment"))


def update_mode(mode: int, tiles: DataFrame, state: DataFrame, obs: DataFrame, pred: DataFrame, xc: float, yc: float, peat: float = 0.85) -> DataFrame:
    """Increments of a numbered mode; obs has varname, tiles has porosity. Own-tile modes take observations assigned to the tile."""
    m = MODES[mode]
    wanted = obs.where(F.col("varname").isin(*m.variables))
    fields = [*m.fields, *m.with_tb, *m.peat]
    out = enkf_increments(tiles, state, wanted.drop("tile") if m.local else wanted, pred, fields, xc, yc, tapered=m.local, own=not m.local)
    if m.peat:
        out = out.join(tiles.select("tile", "porosity"), "tile")
        out = out.withColumns({f: F.when(F.col("porosity") >= peat, F.col(f)).otherwise(0.0) for f in m.peat}).drop("porosity")
    if m.with_tb:
        places = tiles.groupBy("com_lon", "com_lat").agg(F.min("tile").alias("tile"))
        found = local_obs(places, wanted.where("varname = 'tb'").select("lon", "lat").distinct(), xc, yc).select("com_lon", "com_lat").distinct()
        found = tiles.join(found, ["com_lon", "com_lat"]).select("tile").distinct().withColumn("__tb", F.lit(True))
        out = out.join(found, "tile", "left").withColumns({f: F.when(F.col("__tb"), F.col(f)).otherwise(0.0) for f in m.with_tb}).drop("__tb")
    return out


def apply_increments(state: DataFrame, increments: DataFrame, fields: list[str], applied: bool = True) -> DataFrame:
    if not applied:
        return state
    d = increments.select("tile", "ens", *(F.col(f).alias(f"__{f}") for f in fields))
    out = state.join(d, ["tile", "ens"], "left").withColumns({f: F.col(f) + F.coalesce(f"__{f}", F.lit(0.0)) for f in fields})
    return out.drop(*(f"__{f}" for f in fields))


#: Fixed values of the snow cover update: bias adjustments of the two cases, the largest increment and the least snow water, kg m-2.
SNOW_ALPHA, SNOW_BETA, SNOW_MOST, SNOW_LEAST = 0.60, 0.55, 5.0, 0.013


def snow_cover_increments(state: DataFrame, obs: DataFrame, alpha: float = SNOW_ALPHA, beta: float = SNOW_BETA, most: float = SNOW_MOST, least: float = SNOW_LEAST) -> DataFrame:
    """Layers of snow water after the update. state: tile, ens, asnow, wesn (array); obs: tile, obs (mean cover).

    Without a change layers stay. An analysis below `least` has no snow cover, and so no snow; a forecast below it says
    nothing of layers, and the analysis is spread over them evenly; otherwise each layer keeps its share.
    """
    fc, y = F.col("asnow"), F.col("obs")
    adds, takes = fc < y * alpha, y < beta
    incr = F.when(adds, most * (y - fc / alpha)).when(takes, -most * fc * (1 - y / beta)).otherwise(0.0)
    total = F.aggregate("wesn", F.lit(0.0), lambda a, x: a + x)
    out = state.join(obs.select("tile", "obs"), "tile").withColumns({"swe": total, "incr": incr})
    out = out.withColumn("swe_ana", F.greatest(F.col("swe") + F.col("incr"), F.lit(0.0)))
    of = lambda x: F.when(F.col("swe_ana") < least, 0.0).when(F.col("swe") < least, ratio(F.col("swe_ana"), F.size("wesn"))).otherwise(x * ratio(F.col("swe_ana"), F.col("swe")))
    layers = F.when(adds | takes, F.transform("wesn", of)).otherwise(F.col("wesn"))
    return out.select("tile", "ens", "swe", "incr", "swe_ana", layers.alias("wesn_ana"))


def freeze_thaw_increments(tiles: DataFrame, state: DataFrame, obs: DataFrame, reach: float, freezing: float = 273.16) -> DataFrame:
    """Temperature changes where observed and modelled freezing disagree. state: tile, ens, teff, asnow; obs: lon, lat, value."""
    mean = local_obs(tiles, obs, reach, reach).groupBy("tile").agg(F.avg("value").alias("ft"))
    thaw, frozen = F.col("ft") <= 0.5, (F.col("ft") > 0.5) & (F.col("asnow") <= 0.15)
    change = F.when(thaw, F.greatest(F.lit(freezing - 1) - F.col("teff"), F.lit(0.0))).when(frozen, F.least(F.lit(freezing + 1) - F.col("teff"), F.lit(0.0))).otherwise(0.0)
    return state.join(mean, "tile").select("tile", "ens", change.alias("dt"))


def increment_stats(increments: DataFrame, field: str) -> DataFrame:
    return increments.groupBy("tile").agg(F.avg(field).alias("mean"), F.stddev_samp(field).alias("stdv"))

