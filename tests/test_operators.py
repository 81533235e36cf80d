"""Rules on small tables: nulls, ties, edges, and properties that hold for all inputs."""

import math
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from landstream.functions import calendar as C
from landstream.functions import grid as G
from landstream.functions import numeric as N
from landstream.operators import analysis as A
from landstream.operators import diagnostics as D
from landstream.operators import ensemble as E
from landstream.operators import forcing as W
from landstream.operators import observations as O
from landstream.operators import spatial as S
from landstream.sources import ingest, sinks
from landstream.sources.paths import shared
from landstream.streaming import state as T


def one(df):
    return df.first()[0]


def test_pentads_of_a_leap_year(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2000-01-01', DATE'2000-12-31')) AS d").select("d", C.pentad(F.col("d")).alias("p"))
    counts = {r["p"]: r["n"] for r in df.groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert sorted(counts) == list(range(1, 74)) and counts[12] == 6 and sum(counts.values()) == 366


def test_j2000(spark):
    t = spark.range(1).select(C.from_j2000(F.lit(64.184), "TT12").alias("t")).first()["t"]
    assert t == datetime(2000, 1, 1, 12, 0, 0)


@pytest.mark.parametrize("second,slot", [(0, 1), (5399, 1), (5400, 2), (80999, 8), (81000, 1), (86399, 1)])
def test_time_of_day_slots(spark, second, slot):
    assert one(spark.range(1).select(C.tod_slot(F.timestamp_seconds(F.lit(second)), 8))) == slot


def test_window_is_closed_on_the_right(spark):
    for seconds, end in ((0, 0), (1, 10800), (10800, 10800)):
        t = spark.range(1).select(C.window_end(F.timestamp_seconds(F.lit(seconds)), 10800).cast("long"))
        assert one(t) == end


def test_gaspari_cohn_is_symmetric_and_bounded(spark):
    df = spark.range(-50, 51).select((F.col("id") / 20).alias("x")).select("x", N.gaspari_cohn(F.col("x"), F.lit(0.0), 2.0, 1.0).alias("g"))
    g = {round(r["x"], 6): r["g"] for r in df.collect()}
    assert all(0 <= v <= 1 for v in g.values()) and all(g[x] == pytest.approx(g[-x]) for x in g)
    assert g[0] == 1 and g[2.0] == 0 and g[2.5] == 0
    for x in g:  # the array form is the same
        assert g[x] == pytest.approx(float(A._taper(np.array([x]), np.array([0.0]), 2.0, 1.0)[0]), abs=1e-12)


@pytest.mark.parametrize("grid", ["M36", "M09", "M03", "N36", "S09"])
def test_ease2_round_trip(spark, grid):
    _, cols, rows = G.EASE2[grid]
    df = spark.range(60).select((F.col("id") * 7919 % rows).cast("int").alias("r"), (F.col("id") * 104729 % cols).cast("int").alias("c"))
    lat, lon = G.ease2_latlon(F.col("r"), F.col("c"), grid)
    df = df.withColumns({"lat": lat, "lon": lon}).where("lat IS NOT NULL")
    row, col = G.ease2_cell(F.col("lat"), F.col("lon"), grid)
    assert df.count() > 5 and df.where((row != F.col("r")) | (col != F.col("c"))).count() == 0


def test_ease2_corner(spark):
    lat, lon = G.ease2_latlon(F.lit(-0.5), F.lit(-0.5), "M36")
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert r["lat"] == pytest.approx(85.04457, abs=1e-4) and r["lon"] == pytest.approx(-180.0, abs=1e-3)


def test_months_add_up(spark, sf_dir):
    from landstream.plans import diagnostics as Q

    masked = D.assimilated(Q.masked(spark, sf_dir), Q.species(spark))
    direct = masked.groupBy("tile", "species").agg(F.avg(F.col("obs") - F.col("fcst")).alias("m"), F.stddev_pop(F.col("obs") - F.col("fcst")).alias("s"))
    both = D.temporal_stats(D.monthly_sums(masked)).join(direct, ["tile", "species"])
    assert both.count() > 0
    assert both.where((F.abs(F.col("omf_mean") - F.col("m")) > 1e-9) | (F.abs(F.col("omf_stdv") - F.col("s")) > 1e-5)).count() == 0


def test_cross_mask_drops_nulls(spark):
    a = spark.createDataFrame([(1, 1, 1, 2.0, 3.0), (2, 1, 1, None, 3.0)], "time int, tile int, species int, obs double, fcst double")
    assert D.cross_mask(a, a).count() == 1


def test_nearest_tile_takes_the_smaller_of_equals(spark):
    obs = spark.createDataFrame([(1, 5.0, 5.0), (2, -200.0, 5.0), (3, 8.0, 8.0)], "obs_id int, lon double, lat double")
    tile = lambda t, x, y: (t, x, y, x - 0.5, x + 0.5, y - 0.5, y + 0.5)
    tiles = spark.createDataFrame([tile(8, 4.0, 5.0), tile(7, 6.0, 5.0)], "tile int, com_lon double, com_lat double, min_lon double, max_lon double, min_lat double, max_lat double")
    got = S.assign_tile(obs, tiles, G.LatLonGrid(), 1.5).collect()
    assert [(r["obs_id"], r["tile"]) for r in got] == [(1, 7)]


def test_ellipse_across_the_dateline(spark):
    p = spark.createDataFrame([(1, 179.0, 0.0)], "obs_id int, lon double, lat double")
    t = spark.createDataFrame([(1, -179.5, 0.0), (2, 178.0, 0.0)], "tile int, com_lon double, com_lat double")
    found = lambda wrap: sorted(r["tile"] for r in S.in_ellipse(p, t, 3.0, 3.0, wrap).collect())
    assert found(False) == [2] and found(True) == [1, 2]


def searched(spark, km, wrap=True):
    """(points, tiles, met, found) of a search in kilometres, points up to the poles."""
    rng = np.random.default_rng(4)
    places = [(i, float(rng.uniform(-180, 180)), float(v)) for i, v in enumerate([*rng.uniform(-90, 90, 150), 89.99, -89.99, 90.0, 88.0, -87.5, 0.0])]
    tiles = [(i, float(rng.uniform(-180, 180)), float(math.degrees(math.asin(rng.uniform(-1, 1))))) for i in range(3000)] + [(9000 + i, i * 30.0 - 180, 89.9) for i in range(12)]
    p = spark.createDataFrame(places, "obs_id int, lon double, lat double")
    t = spark.createDataFrame(tiles, "tile int, com_lon double, com_lat double")
    rx, ry = G.km_to_deg(float(km), F.col("lat"))
    met = S.meet(p, t, rx, ry, wrap).select("obs_id", "tile").collect()
    found = S.in_ellipse(p, t, rx, ry, wrap).select("obs_id", "tile").collect()
    return places, tiles, [tuple(r) for r in met], [tuple(r) for r in found]


@pytest.mark.parametrize("km", [1, 40, 300, 3000])
def test_searches_meet_few_cells_and_all_within(spark, km):
    places, tiles, met, found = searched(spark, km)
    ry = km * 180 / (math.pi * G.EARTH_KM)
    want, most = set(), 0
    for o, x, y in places:
        rx = ry / math.cos(math.radians(y))
        d = lambda a: (a + 180) % 360 - 180
        want |= {(o, t) for t, a, b in tiles if (d(a - x) / rx) ** 2 + ((b - y) / ry) ** 2 <= 1}
        # Cells are at most twice the radius wide; three of them each way, around the box.
        most += sum(abs(b - y) <= 5 * ry and abs(d(a - x)) <= 5 * rx for _, a, b in ((t, a, b) for t, a, b in tiles))
    assert set(found) == want and len(found) == len(want) and len(met) == len(set(met))
    assert want <= set(met) and len(met) <= most


def test_cells_follow_the_radius(spark):
    """A small radius doesn't search large cells: candidates are in proportion to the area."""
    _, _, wide, _ = searched(spark, 3000)
    _, _, small, _ = searched(spark, 40)
    assert len(small) < len(wide) / 200


def test_search_columns_levels_and_nulls(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, None), (3, None, 0.0, 1.0), (4, 0.0, 0.0, 0.0), (5, 0.0, 0.0, 200.0)], "obs_id int, lon double, lat double, r double")
    t = spark.createDataFrame([(1, 0.5, 0.5), (2, 90.0, 80.0), (3, None, 0.0), (4, 0.0, 0.0)], "tile int, com_lon double, com_lat double")
    got = sorted((r.obs_id, r.tile) for r in S.in_ellipse(p, t, F.col("r"), F.col("r")).collect())
    assert got == [(1, 1), (1, 4), (5, 1), (5, 2), (5, 4)]
    assert S.in_ellipse(p.where("false"), t, F.col("r"), F.col("r")).count() == 0


def test_two_tiles_in_an_equal_area_cell_are_refused(spark):
    t = spark.createDataFrame([(1, 0.1, 0.1, 0.0, 1.0, 0.0, 1.0), (2, 0.12, 0.1, 0.0, 1.0, 0.0, 1.0)], "tile int, com_lon double, com_lat double, min_lon double, max_lon double, min_lat double, max_lat double")
    p = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.1, 89.9), (3, 200.0, 0.0)], "obs_id int, lon double, lat double")
    with pytest.raises(Exception, match="more than 1 tiles"):
        S.assign_tile(p, t, G.EaseGrid("M36"), 1.0).count()
    assert [r.obs_id for r in S.assign_tile(p, t.where("tile = 1"), G.EaseGrid("M36"), 1.0).collect()] == [1]


def test_one_observation_is_the_closed_form():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 20)), rng.normal(size=(1, 20))
    d = rng.normal(size=(1, 20))
    gain = np.array([np.cov(x[i], y[0])[0, 1] for i in range(2)]) / (y[0].var(ddof=1) + 0.3)
    assert np.allclose(A.solve_tile(x, y, d, np.array([[0.3]])), gain[:, None] * d)


def test_update_mode_only_moves_what_it_may(spark):
    fields = [*A.MODES[12].fields, *A.MODES[12].with_tb, *A.MODES[12].peat]
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 0.5), (2, 40.0, 0.0, 0.9)], "tile long, com_lon double, com_lat double, porosity double")
    state = spark.createDataFrame([(t, e, *(float(e * (k + 1)) for k in range(len(fields)))) for t in (1, 2) for e in range(1, 5)], "tile long, ens int, " + ", ".join(f"{f} double" for f in fields))
    obs = spark.createDataFrame([(1, 0.1, 0.0, 1, 9.0, 0.5, "sfmc", 1), (2, 40.1, 0.0, 2, 9.0, 0.5, "tb", 2)], "obs_id long, lon double, lat double, species int, obs double, obsvar double, varname string, tile long")
    pred = spark.createDataFrame([(o, e, float(e), 0.0) for o in (1, 2) for e in range(1, 5)], "obs_id long, ens int, pred double, eps double")
    got = {(r["tile"], r["ens"]): r for r in A.update_mode(12, tiles, state, obs, pred, 2.0, 2.0).collect()}
    assert got[1, 1]["srfexc"] != 0 and got[1, 1]["tc1"] == 0 and got[1, 1]["catdef"] == 0
    assert got[2, 1]["tc1"] != 0 and got[2, 1]["catdef"] != 0
    assert A.apply_increments(state, A.update_mode(1, tiles, state, obs, pred, 2.0, 2.0), list(A.MODES[1].fields)).count() == 8


def test_centred_members(spark):
    df = spark.createDataFrame([(g, e, float(e * e), True) for g in (1, 2) for e in range(4)] + [(3, 0, 5.0, True), (3, 1, 7.0, True)], "g int, ens int, x double, zeromean boolean")
    means = {r["g"]: r["m"] for r in E.center_members(df, ["g"], "x").groupBy("g").agg(F.avg("x").alias("m")).collect()}
    assert means[1] == pytest.approx(0) and means[2] == pytest.approx(0) and means[3] == 6  # two members aren't centred


def test_step_weight(spark):
    w = lambda s: one(spark.range(1).select(W.step_weight(F.lit(s), 10800)))
    assert [w(s) for s in (1, 5399, 5400, 5401, 10800)] == [0, 0, 0.5, 1, 1]


def test_suppression_needs_both_species(spark):
    df = spark.createDataFrame([(1, 1, 1, True), (1, 1, 2, True), (2, 1, 1, True)], "ci int, cj int, species int, assim boolean")
    flags = lambda active: sorted((r["ci"], r["species"], r["assim"]) for r in O.suppress_species(df, [(1, 2)], active).collect())
    assert flags([1, 2]) == [(1, 1, False), (1, 2, True), (2, 1, True)]
    assert all(a for _, _, a in flags([1]))


def test_bias_counters():
    step = T.obs_bias(3600, 7200.0, 20000)
    state, first = step(None, {"t": 0, "obs": 2.0, "pred": 1.0, "assim": True})
    assert not first["assim"] and first["bias"] == pytest.approx(1.0)  # nothing is known yet: the bias takes it all
    state, second = step(state, {"t": 3600, "obs": 2.0, "pred": 1.0, "assim": True})
    state, third = step(state, {"t": 7200, "obs": 3.0, "pred": 1.0, "assim": True})
    assert not second["assim"] and third["assim"]
    assert third["bias"] == pytest.approx(1.0 + (1 - math.exp(-0.5)) * 1.0)


def test_state_goes_on_where_it_was_saved(spark):
    rows = [(k, t, float((k * 7 + t * 3) % 5), 1.0, True) for k in (1, 2) for t in range(0, 50000, 3600)]
    df = spark.createDataFrame(rows, "k int, t long, obs double, pred double, assim boolean")
    step, schema = T.obs_bias(3600, 7200.0, 20000), "k int, t long, obs double, bias double, assim boolean"
    whole = {(r["k"], r["t"]): r["bias"] for r in T.fold(df, ["k"], ["t"], step, schema, ["t"]).collect()}
    saved = T.last_state(df.where("t < 20000"), ["k"], ["t"], step, "k int")
    later = T.fold(df.where("t >= 20000"), ["k"], ["t"], step, schema, ["t"], saved).collect()
    assert later and all(whole[r["k"], r["t"]] == pytest.approx(r["bias"]) for r in later)


def test_adaptive_factors_stay_in_bounds():
    step, state = T.adaptive_factors(0.5, 0.5, delta=0.5, low=0.5, high=2.0), None
    for _ in range(20):
        state, out = step(state, {"obs": 10.0, "fcst": 0.0, "ana": 9.0, "fcstvar": 1.0, "obsvar": 1.0})
    assert out == {"p_factor": 2.0, "r_factor": 2.0}


def _record(data: bytes) -> bytes:
    return struct.pack("<i", len(data)) + data + struct.pack("<i", len(data))


def test_binary_observations(spark, tmp_path):
    vectors = [[1, 0], [3, 4], [7, 8], *[[float(k), -9999.0] for k in range(8)]]
    data = _record(struct.pack("<9i", 2, 2015, 4, 1, 3, 0, 0, 91, 19))
    for k, v in enumerate(vectors):
        data += _record(struct.pack("<2i" if k < 3 else "<2f", *v))
    (tmp_path / "a.bin").write_bytes(data)
    rows = ingest.read_obs_fcst_ana(spark, str(tmp_path), "x").orderBy("species").collect()
    assert [r["assim"] for r in rows] == [True, False] and rows[0]["time"] == datetime(2015, 4, 1, 3)
    assert rows[1]["obs"] == -9999.0 and rows[1]["obsvar"] is None and rows[0]["ana"] == 6.0
    (tmp_path / "b.bin").write_bytes(data[:-5])
    with pytest.raises(Exception, match="broken record"):
        ingest.read_obs_fcst_ana(spark, str(tmp_path), "x").count()


def test_binary_tiles_and_grids(spark, tmp_path):
    data = _record(struct.pack("<i", 2))
    for name, kind in ingest._TILE:
        data += _record(struct.pack("<2i" if kind == "i4" else "<2f", 1, 2))
    (tmp_path / "x.tilecoord.bin").write_bytes(data)
    grid = b"LatLon".ljust(40, b"\x00") + struct.pack("<7i6f", 1, 1, -1, 36, 18, 0, 0, -180, -90, 180, 90, 10, 10)
    (tmp_path / "x.tilegrids.bin").write_bytes(_record(grid) * 2)
    assert ingest.read_tiles(spark, str(tmp_path)).agg(F.sum("tile_id"), F.sum("area")).first()[:] == (3, 3.0)
    rows = ingest.read_grids(spark, str(tmp_path)).collect()
    assert [(r["scope"], r["gridtype"], r["j_dir"], r["dlon"]) for r in rows] == [("global", "LatLon", -1, 10.0), ("domain", "LatLon", -1, 10.0)]


def test_species_catalogue(spark, tmp_path):
    values = {"t": '"text"', "d": "1.5", "i": "2.0", "b": "T", "a": "40.0 50.0"}
    lines = ["2"] + [values[k] for _ in range(2) for _, k in ingest._SPECIES]
    (tmp_path / "obsparam.txt").write_text("\n".join(lines) + "\n")
    rows = ingest.read_species(spark, str(tmp_path / "obsparam.txt")).collect()
    assert len(rows) == 2 and rows[1]["ang"] == [40.0, 50.0] and rows[0]["assim"] is True and rows[0]["varname"] == "text" and rows[0]["species"] == 2


def test_observation_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text("20150401_030000z, SMAP_L1C, read_obs, 12, some/file.h5\n")
    r = ingest.read_obs_log(spark, str(tmp_path / "log.csv")).first()
    assert r["descr"] == "SMAP_L1C" and r["n_obs"] == 12 and r["file"] == "some/file.h5"


def test_months_are_written_once(spark):
    path = shared(spark, "sums")
    sums = spark.sql("SELECT DATE'2015-04-01' AS month, 1 AS tile, 1 AS species, 5L AS n UNION ALL SELECT DATE'2015-05-01', 1, 1, 6L")
    assert sinks.write_monthly_sums(sums.where("n = 5"), path) == ["2015-04-01"]
    assert sinks.write_monthly_sums(sums, path) == ["2015-05-01"]
    assert sinks.write_monthly_sums(sums, path) == []
    assert spark.read.parquet(f"{path}/sums").count() == 2


def test_another_configuration_is_refused(spark):
    path = shared(spark, "config")
    sinks.config_guard(spark, path, {"a": 1})
    sinks.config_guard(spark, path, {"a": 1})
    with pytest.raises(ValueError, match="another configuration"):
        sinks.config_guard(spark, path, {"a": 2})


def test_catalogues_must_agree(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "ordinal int, descr string")
    assert D.catalogue_mismatches(a, a).count() == 0
    assert D.catalogue_mismatches(a, a.where("ordinal = 1")).count() == 1


def test_empty_tables(spark, sf_dir):
    from landstream.plans import spatial as Q

    none = Q.points(spark, sf_dir).where("false")
    assert S.assign_tile(none, Q.tiles(spark, sf_dir), G.LatLonGrid(), 1.0).count() == 0
    assert O.super_obs(none.withColumn("tile", F.lit(1)), ["tile"], ["value"]).count() == 0


def test_fold_keeps_keys_apart_over_batches(spark):
    """Keys that span Arrow batches, and null keys, keep one state each; as many rows come out as go in."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, t, float(t % 4), 1.0, True) for k in (1, 2, None) for t in range(0, 40 * 3600, 3600)]
        df = spark.createDataFrame(rows, "k int, t long, obs double, pred double, assim boolean")
        got = T.fold(df, ["k"], ["t"], T.obs_bias(3600, 7200.0, 20000), "k int, t long, obs double, bias double, assim boolean", ["t"]).collect()
        assert len(got) == len(rows)
        by = {k: [r["bias"] for r in sorted(got, key=lambda r: r["t"]) if r["k"] == k] for k in (1, 2, None)}
        assert by[1] == by[2] == by[None] and len(by[1]) == 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def dense_update(tile, state, obs, pred, fields, reach, tapered, corr, inflation):
    """The update of one tile, member by member and observation by observation, in plain loops."""
    near = sorted((o for o in obs if abs(o["lon"] - tile["com_lon"]) <= reach and abs(o["lat"] - tile["com_lat"]) <= reach), key=lambda o: o["obs_id"])
    members = sorted(state)
    n = len(members)
    g = lambda dx, dy: float(A._taper(np.array([dx]), np.array([dy]), reach, reach)[0]) if tapered else 1.0
    mean = lambda xs: sum(xs) / len(xs)
    xp = {f: [inflation * (state[e][f] - mean([state[k][f] for k in members])) for e in members] for f in fields}
    yp = [[inflation * (pred[o["obs_id"], e]["pred"] - mean([pred[o["obs_id"], k]["pred"] for k in members])) for e in members] for o in near]
    w = np.zeros((len(near), len(near)))
    for i, a in enumerate(near):
        for j, b in enumerate(near):
            dx, dy = a["lon"] - b["lon"], a["lat"] - b["lat"]
            w[i, j] = sum(p * q for p, q in zip(yp[i], yp[j], strict=True)) / (n - 1) * g(dx, dy)
            if i == j:
                w[i, j] += a["obsvar"]
            elif corr and a["species"] == b["species"]:
                w[i, j] += math.sqrt(a["obsvar"] * b["obsvar"]) * math.exp(-0.5 * ((dx / corr) ** 2 + (dy / corr) ** 2))
    out = {}
    for m, e in enumerate(members):
        rhs = [o["obs"] + pred[o["obs_id"], e]["eps"] - pred[o["obs_id"], e]["pred"] - (1 - inflation) * yp[i][m] for i, o in enumerate(near)]
        b = np.linalg.solve(w, rhs)
        for f in fields:
            gain = sum(b[i] * g(o["lon"] - tile["com_lon"], o["lat"] - tile["com_lat"]) * sum(p * q for p, q in zip(xp[f], yp[i], strict=True)) for i, o in enumerate(near))
            out[e, f] = gain / (n - 1) + (1 - 1 / inflation) * xp[f][m]
    return out if near else {}


def tables(spark, sf_dir, fields, members):
    from landstream.plans import ensemble as Q

    tiles, state, obs, pred = (df.collect() for df in Q.local(spark, sf_dir, fields, members))
    by_tile = {}
    for r in state:
        by_tile.setdefault(r["tile"], {})[r["ens"]] = r
    return tiles, by_tile, obs, {(r["obs_id"], r["ens"]): r for r in pred}


def test_local_update_with_taper_correlation_and_inflation(spark, sf_dir):
    from landstream.plans import ensemble as Q

    got = {(r["tile"], r["ens"]): r for r in Q.enkf_local(spark, sf_dir).collect()}
    tiles, state, obs, pred = tables(spark, sf_dir, Q.FIELDS, 8)
    several = 0
    for t in tiles:
        want = dense_update(t, state[t["tile"]], obs, pred, Q.FIELDS, 3.0, True, 1.0, 1.2)
        several += len(want) > 0
        assert {e for e, _ in want} == {e for tile, e in got if tile == t["tile"]}
        assert all(got[t["tile"], e][f] == pytest.approx(v, abs=2e-6) for (e, f), v in want.items())
    assert several > 3


def test_all_update_modes(spark, sf_dir):
    from landstream.plans import ensemble as Q

    got = {}
    for r in Q.update_modes(spark, sf_dir).collect():
        got[r["mode"], r["tile"], r["ens"], r["field"]] = r["increment"]
    want = {}
    for mode, m in A.MODES.items():
        fields = [*m.fields, *m.with_tb, *m.peat]
        tiles, state, obs, pred = tables(spark, sf_dir, fields, 4)
        for t in tiles:
            kind = [o for o in obs if o["varname"] in m.variables]
            if m.local:
                reach, tb = 1.5, any(o["varname"] == "tb" and abs(o["lon"] - t["com_lon"]) <= 1.5 and abs(o["lat"] - t["com_lat"]) <= 1.5 for o in kind)
            else:
                reach, tb = 1e-6, False
                kind = [{**o.asDict(), "lon": t["com_lon"], "lat": t["com_lat"]} for o in kind if o["tile"] == t["tile"]]
            for (e, f), v in dense_update(t, state[t["tile"]], kind, pred, fields, reach, m.local, None, 1.0).items():
                off = (f in m.peat and t["porosity"] < 0.85) or (f in m.with_tb and not tb)
                want[mode, t["tile"], e, f] = 0.0 if off else v
    assert want.keys() == got.keys() and len({k[0] for k in want}) == len(A.MODES)
    assert all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())


def test_rows_without_a_value_change_no_state(spark):
    rows = [(1, t, None if t % 3 == 0 else float(t), 1.0, True) for t in range(10)]
    df = spark.createDataFrame(rows, "k int, t long, obs double, pred double, assim boolean")
    step, schema = T.obs_bias(1, 4.0, 20000), "k int, t long, obs double, bias double, assim boolean"
    got = {r["t"]: r for r in T.fold(df, ["k"], ["t"], step, schema, ["t"]).collect()}
    left = {r["t"]: r for r in T.fold(df.where("obs IS NOT NULL"), ["k"], ["t"], step, schema, ["t"]).collect()}
    assert all(got[t]["assim"] == r["assim"] and got[t]["bias"] == pytest.approx(r["bias"]) for t, r in left.items()) and all(got[t]["obs"] is None and not got[t]["assim"] for t in (0, 3, 6, 9))
    assert got[3]["bias"] == got[2]["bias"]
    ar = spark.createDataFrame([(1, t, None if t in (0, 2) else 1.0) for t in range(5)], "k int, time int, eps double")
    x = [r["x"] for r in sorted(T.ar1(ar, ["k"], 1.0, 2.0).collect(), key=lambda r: r["time"])]
    c = math.exp(-0.5)
    assert x[0] is None and x[1] == 1.0 and x[2] is None and x[3] == pytest.approx(c + math.sqrt(1 - c * c))


def test_scans_are_the_loops():
    rng = np.random.default_rng(5)
    a, b, m = rng.uniform(0, 1, 300), rng.normal(size=300), rng.uniform(0.5, 2, 300)
    starts, before = np.array([0, 1, 90, 200]), rng.uniform(0.5, 2, 4)
    x, y = T.affine_scan(a, b, starts, before), T.clipped_scan(m, 0.5, 2.0, starts, before)
    for k, (i, j) in enumerate(zip(starts, [1, 90, 200, 300], strict=True)):
        u = v = before[k]
        for r in range(i, j):
            u, v = a[r] * u + b[r], min(max(v * m[r], 0.5), 2.0)
            assert x[r] == pytest.approx(u) and y[r] == pytest.approx(v)


def test_groups_with_nulls_and_across_ranges(spark):
    rows = [(None, 1.0), (None, 1.00001), (1.0, None), (1.0, 2.0), (1.0, 2.0), (5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = sorted(((r["a"], r["b"], r["group"]) for r in E.unique_groups(df, ["a", "b"]).collect()), key=repr)
    assert len(got) == 6 and len({g for _, _, g in got}) == 4
    many = spark.range(2000).select((F.col("id") / 2 * 1e-5 + 1).alias("a"))
    assert E.unique_groups(many, ["a"]).agg(F.max("group")).first()[0] == 1  # a chain of near values is one group over all ranges


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from landstream.sources import paths

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="must name a folder"):
        paths.shared(Elsewhere, "x")
