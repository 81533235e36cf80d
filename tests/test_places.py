"""Searches by place: rows that share a place share its search, and results are those of the pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from landstream import catalog
from landstream.functions import grid as G
from landstream.functions.numeric import round_half_up
from landstream.operators import spatial as S
from tests.oracle import differences

BOX = "tile long, com_lon double, com_lat double, min_lon double, max_lon double, min_lat double, max_lat double, area double"


def crowd(spark):
    """Three places of 40 tiles and 30 places of 40 points."""
    spots = [(0.0, 0.0), (3.0, 1.0), (40.0, 20.0)]
    tiles = [(100 * i + k, x, y, x - 0.5, x + 0.5, y - 0.5, y + 0.5, float(k % 4)) for i, (x, y) in enumerate(spots) for k in range(40)]
    points = [(k * 30 + i, x + i % 10 / 10, y, float(k) if k % 3 else None) for k in range(40) for i, (x, y) in ((i, spots[i // 10]) for i in range(30))]
    return spark.createDataFrame(tiles, BOX), spark.createDataFrame(points, "obs_id long, lon double, lat double, value double"), tiles, points


def listed_most(spark, monkeypatch, make):
    """Rows that the search by cells gets from both sides."""
    got = []
    meet = S.meet

    def spied(points, others, *a, **k):
        got.append((points.count(), others.count()))
        return meet(points, others, *a, **k)

    monkeypatch.setattr(S, "meet", spied)
    return make(), got


def test_a_swath_edge_is_in_or_out_as_in_sql(spark, tmp_path):
    """Every twelve seconds the edges are hundredths of a degree; places stand on them, so the last bit decides."""
    rows = "SELECT i, TIMESTAMP '2024-01-01' + to_seconds(12 * i) AS ts, CAST(round((((13.5 - 12 * i / 3600.0 - side) * 15 + 180) - 360 * floor(((13.5 - 12 * i / 3600.0 - side) * 15 + 180) / 360)) * 100) AS BIGINT) % 36000 AS c FROM range(7200) t(i), (SELECT unnest([-1, 1]) AS side)"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT row_number() OVER () * 100 + c % 100 AS event_id, ts, c // 100 * 253 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '1' AS props FROM ({rows})")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert differences(spark, str(tmp_path), catalog.QUERIES["swath_longitudes"], catalog.ORACLES["swath_longitudes"], con) == ""


def test_tiles_are_assigned_to_places(spark, monkeypatch):
    t, p, tiles, points = crowd(spark)
    sizes, with_cell = [], S.with_cell
    monkeypatch.setattr(S, "with_cell", lambda df, *a, **k: sizes.append(df.count()) or with_cell(df, *a, **k))
    made = S.assign_tile(p, t, G.LatLonGrid(), 1.0)
    cell = lambda x, y: (np.ceil((x + 180) / 10), np.ceil((y + 90) / 10))
    want = {}
    for o, x, y, _ in points:
        best = min(((abs(u[1] - x) + abs(u[2] - y), u[0], u[1]) for u in tiles if cell(u[1], u[2]) == cell(x, y)), default=None)
        if best and abs(best[2] - x) <= 1:
            want[o] = best[1]
    assert len(want) > 400 and sorted((r.obs_id, r.tile) for r in made.collect()) == sorted(want.items()) and sizes[0] == 30


def test_ellipses_search_places_and_give_all_pairs(spark, monkeypatch):
    t, p, tiles, points = crowd(spark)
    found, sizes = listed_most(spark, monkeypatch, lambda: S.in_ellipse(p, t, 3.5, 2.0).select("obs_id", "tile").collect())
    want = {(o, u[0]) for o, x, y, _ in points for u in tiles if ((u[1] - x) / 3.5) ** 2 + ((u[2] - y) / 2) ** 2 <= 1}
    assert len(found) == len(want) and {tuple(r) for r in found} == want and sizes == [(30, 3)]


@pytest.mark.parametrize("units", ["deg", "km"])
def test_footprints_add_up_by_place(spark, monkeypatch, units):
    t, p, tiles, points = crowd(spark)
    state = t.select("tile", F.explode(F.array(F.lit(1), F.lit(2))).alias("ens")).withColumn("x", (F.col("tile") % 7 + F.col("ens")).cast("double"))
    got, sizes = listed_most(spark, monkeypatch, lambda: {(r.obs_id, r.ens): r.pred for r in S.predict_obs(p, t, state, 150.0 if units == "km" else 3.5, units).collect()})
    assert sizes == [(30, 3)]
    for o, x, y, _ in points:
        ry = 3.5 if units == "deg" else 300 * 180 / (np.pi * 6371)
        rx = ry if units == "deg" else ry / np.cos(np.radians(y))
        near = [(u, ((u[1] - x) / rx) ** 2 + ((u[2] - y) / ry) ** 2) for u in tiles]
        near = [(u, u[7] * (np.exp(-2 * d) if units == "km" else 1)) for u, d in near if d <= 1]
        for e in (1, 2):
            assert got[o, e] == pytest.approx(sum(w * (u[0] % 7 + e) for u, w in near) / sum(w for _, w in near))


def test_the_nearest_of_many_points_at_one_place(spark, monkeypatch):
    t, p, tiles, _ = crowd(spark)
    got, sizes = listed_most(spark, monkeypatch, lambda: S.nearest_point(t.select(F.col("tile").alias("id"), "com_lon", "com_lat"), p, 1.5).collect())
    # the first place of each ten is the tile's own; of its points k = 0 has no value, and a null is the last choice
    assert len(got) == len(tiles) and {r.value for r in got} == {1.0} and sizes == [(30, 3)]


@pytest.fixture
def small_blocks(monkeypatch):
    """Packs of few ids and keys of many blocks."""
    monkeypatch.setattr(S, "PACK", 4)
    monkeypatch.setattr(S, "BLOCK_PAIRS", 100)
    monkeypatch.setattr(S, "PAIR_ROWS", 10)


def covariances(rows):
    """All pairs, one by one. rows: (obs_id, lon, lat, obsvar, species, g)."""
    out = []
    for i, x, y, v, s, g in rows:
        for j, x2, y2, v2, s2, g2 in rows:
            if None not in (s, g, x, y, x2, y2) and (s, g) == (s2, g2) and abs(x - x2) <= 12 and abs(y - y2) <= 12:
                r = None if v is None or v2 is None else (v * v2) ** 0.5 * np.exp(-0.5 * (((x - x2) / 4) ** 2 + ((y - y2) / 4) ** 2))
                c = v if i is not None and i == j else r
                out.append((str(i), str(j), s, g, None if c is None else round(c, 9)))
    return sorted(out, key=str)


def test_covariances_by_pairs_of_places(spark, monkeypatch, small_blocks):
    """One crowded place, equal rows, rows without an id, a variance, a place, a species or a group: as pair by pair."""
    rows = [(k, 0.0, 0.0, 1.0 + k % 2, 0, "a") for k in range(40)] + [(100 + k, 5.0 * (k % 6), -3.0 * (k % 4), 2.0, k % 2, "ab"[k % 3 % 2]) for k in range(30)]
    rows += [(5, 0.0, 0.0, 2.0, 0, "a")] * 2 + [(None, 1.0, 1.0, 2.0, 0, "a")] * 2 + [(200, 1.0, 1.0, None, 0, "a"), (201, -0.0, 0.0, 1.0, 0, "a")]
    rows += [(202, None, 1.0, 1.0, 0, "a"), (203, 1.0, 1.0, 1.0, None, "a"), (204, 1.0, 1.0, 1.0, 0, None), (6, 12.0, 12.0, 3.0, 0, "a"), (7, float(np.nextafter(12, 13)), 0.0, 3.0, 0, "a")]
    df = spark.createDataFrame(rows, "obs_id long, lon double, lat double, obsvar double, species int, g string")
    got, sizes = listed_most(spark, monkeypatch, lambda: S.pair_covariance(df, ["g"], 4.0, 4.0).collect())
    assert sorted(((str(r.obs_id), str(r.obs_id_b), r.species, r.g, None if r["cov"] is None else round(r["cov"], 9)) for r in got), key=str) == covariances(rows)
    assert sizes[0][0] == sizes[0][1] < len(rows) - 3


def test_covariances_are_found_once_a_pair_of_places(spark, monkeypatch):
    """200 observations at one place meet as packs of ids: of their 40,000 pairs no more than 64 are met and computed."""
    df = spark.range(200).selectExpr("id AS obs_id", "0D AS lon", "0D AS lat", "1D AS obsvar", "0 AS species", "0 AS g")
    met, meet = [], S.meet
    monkeypatch.setattr(S, "meet", lambda *a, **k: met.append(meet(*a, **k)) or met[0])
    assert S.pair_covariance(df, ["g"], 4.0, 4.0).count() == 40_000 and met[0].count() <= 64


def test_a_crowded_key_is_many_blocks(spark, small_blocks):
    """No block of a key has more than its share of the pairs, and each pair meets once."""
    df = spark.range(100).selectExpr("0 AS k", "id AS x")
    seen, join = [], type(df).join

    def spied(a, b, *how):
        if "__row" in a.columns and "__row" in b.columns:
            seen.extend(r[0] for r in join(a, b, *how).groupBy("__row", "__column").count().select("count").collect())
        return join(a, b, *how)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "join", spied)
        got = S.join_in_blocks(df, df.withColumnRenamed("x", "y"), ["k"], (F.lit(1), F.lit(1)), 3)
    assert sorted((r.x, r.y) for r in got.collect()) == [(x, y) for x in range(100) for y in range(100)]
    assert len(seen) == 100 and max(seen) <= 400


def test_rounding_is_that_of_decimals(spark):
    values = spark.range(20_000).select(F.explode(F.array((F.col("id") * 2 + 1) / 2e6 - 0.01, F.sin(F.col("id")), F.exp(F.col("id") % 90 - 40.0))).alias("x"))
    values = values.union(spark.sql("SELECT explode(array(0D, -0D, double('nan'), double('inf'), double('-inf'), null, 1e300, 5e-7, -5e-7, 1.4999995D))"))
    assert values.where(~round_half_up(F.col("x"), 6).eqNullSafe(F.round("x", 6))).count() == 0


def test_covariances_agree_with_sql_where_copies_share_places(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT e.* REPLACE (event_id + 100000 * g AS event_id, user_id + 360 * g AS user_id) FROM '/root/testdata/sf0.001/events.parquet' e, range(6) t(g)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert differences(spark, str(tmp_path), catalog.QUERIES["obs_pairs_cov"], catalog.ORACLES["obs_pairs_cov"], con) == ""
