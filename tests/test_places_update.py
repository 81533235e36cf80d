"""Local updates by place: the observations of a site are brought together with the result of dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landstream.operators import analysis as A


def crowd(n, m, sites, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.uniform(-2, 2, (sites, 2))[rng.integers(0, sites, n)]
    return at, rng.normal(size=(n, m)), rng.normal(size=(n, m)), rng.uniform(0.3, 0.8, n), rng.integers(1, 6, n)


def dense(at, y, d, v, kind, corr, infl):
    dx, dy = at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1]
    r = np.diag(v)
    if corr:
        r = np.where((kind[:, None] == kind) & ~np.eye(len(v), dtype=bool), np.sqrt(np.outer(v, v)) * np.exp(-0.5 * ((dx / corr[0]) ** 2 + (dy / corr[1]) ** 2)), r)
    y = (y - y.mean(1, keepdims=True)) * infl
    a = y @ y.T / (y.shape[1] - 1) * A._taper(dx, dy, 3, 3) + r
    return a, (y * A._taper(at[:, 0], at[:, 1], 3, 3)[:, None]).T / (y.shape[1] - 1), d - (1 - infl) * y


@pytest.mark.parametrize("n,m,sites,corr", [(300, 4, 5, None), (9, 4, 8, None), (30, 8, 25, (1.0, 1.0)), (400, 4, 3, (1.0, 1.0))])
def test_a_place_is_solved_as_by_dense_algebra(n, m, sites, corr):
    """The last is singular: wholly correlated observations at one site contradict each other; then the pseudo-inverse counts."""
    at, y, d, v, kind = crowd(n, m, sites)
    a, left, right = dense(at, y, d, v, kind, corr, 1.2)
    want = left @ np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ right
    assert A.place_gain(y, d, v, kind, at, np.zeros(2), (3.0, 3.0), True, corr, 1.2) == pytest.approx(want, abs=1e-8)


def tables(spark, tiles, n):
    t = spark.createDataFrame([(k, x, y, 0.5) for k, (x, y) in enumerate(tiles)], "tile long, com_lon double, com_lat double, porosity double")
    ens = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ens")
    state = t.select("tile", ens).select("tile", "ens", *(F.sin(F.col("tile") * (i + 1) + F.col("ens") * (2 * i + 3)).alias(f) for i, f in enumerate(("srfexc", "rzexc", "catdef"))))
    obs = spark.range(n).select(F.col("id").alias("obs_id"), (F.col("id") % 3 / 10).alias("lon"), F.lit(0.0).alias("lat"), F.lit(1).alias("species"), (F.col("id") % 7).cast("double").alias("obs"), F.lit(0.5).alias("obsvar"), F.lit("sfmc").alias("varname"), (F.col("id") % len(tiles)).alias("tile"))
    pred = obs.select("obs_id", ens).select("obs_id", "ens", F.sin(F.col("obs_id") * 7 + F.col("ens") * 5).alias("pred"), F.lit(0.0).alias("eps"))
    return t, state, obs, pred


def test_a_place_is_solved_once_for_all_its_tiles(spark, monkeypatch):
    t, state, obs, pred = tables(spark, [(0.0, 0.0)] * 50 + [(30.0, 0.0)] * 50, 60)
    sizes = []
    kept = A.kept
    monkeypatch.setattr(A, "kept", lambda df, name: sizes.append((name, df.count())) or kept(df, name))
    assert A.enkf_increments(t, state, obs.drop("tile"), pred, ["srfexc"], 1.5, 1.5).count() == 50 * 4
    assert sizes == [("pairs", 60), ("blocks", 1)]


def test_tiles_at_one_place_keep_their_own_observations(spark):
    """The own-tile mode: a tile's increments don't change when another tile is put at its place."""
    apart, one = ([r for r in A.update_mode(1, *tables(spark, tiles, 12), 1.5, 1.5).orderBy("tile", "ens").collect()] for tiles in ([(0.0, 0.0), (30.0, 0.0)], [(0.0, 0.0), (0.0, 0.0)]))
    assert len(apart) == 8 and np.array(one) == pytest.approx(np.array(apart))
